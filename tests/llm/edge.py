"""One small table with every awkward case: nulls, empty and blank texts, repeats, ties, long texts, columns with clashing names."""

from __future__ import annotations

import random

WORDS = "the of and river stone light Ébène naïve grün niño idiot alpha beta gamma delta".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(11)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    near = base.replace(base.split()[60], "CHANGED", 1)
    line = "This line stands in many documents, word for word."
    rows: list[tuple[int | None, str | None]] = [
        (1, base), (2, base), (3, near), (4, base.upper()), (5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "one two"), (10, "One  TWO"),
        (11, f"{line}\nown text a\n{line}"), (12, f"  {line.upper()}\t\nown text b"), (13, f"{line}\n"), (14, "short\nshort\nshort"), (15, "x" * 700), (16, "ab" * 400 + "\x00" + "é" * 150),
        (17, "mail a@b.c._d@e.f and +1 (389) 555-5010, 4111 1111 1111 1111 at 1.2.3.4.5 or 999.1.1.1"), (18, "\U0001F600 naïve 'tis don't we'll \u00a0 x\u0301 <|endoftext|> \r\n"),
        (19, prose(rng, 400)), (20, prose(rng, 30)), (21, " ".join(str(k) for k in range(3000))), (22, "1" * 2500), (23, (base + " ") * 3), (40, base),
    ]
    return rows


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "a", 1, 2, [3], 0.5, b"r") for i, t in rows], "doc_id long, text string, lang string, n_dropped int, places int, spans array<int>, score double, ids binary")


def with_nulls(spark):
    """Also null ids, and rows that share an id and a text."""
    return frame(spark, [*texts(), (None, "one two"), (None, None), (8, "one two")])


def empty(spark):
    return frame(spark, [])
