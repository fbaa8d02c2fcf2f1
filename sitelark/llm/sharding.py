"""Sharding by a Feistel permutation of global row numbers (DataFrame operations only).

Rows get numbers 0..N-1 in a fixed order. The permutation swaps the halves of a number written with two digits to the base a = ceil(sqrt(N)), and adds
a keyed function of one half to the other; where its result is N or more it is applied again (cycle walking), so it permutes 0..N-1. The
permuted number p lies in shard ``p % shards`` at slot ``p // shards``. A row's place follows from its number, N, the number of
shards and the seed alone, and so does the row at a place: ``place`` and ``row_at`` compute both without any table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .shared import dropped

#: A prime below 2**31 (products of two residues fit 63 bits), multipliers of the round function, and the rounds.
PRIME, FACTORS, ROUNDS = 2_147_483_647, (48_271, 69_621, 16_807), 6
#: Steps of cycle walking that are tried before the bound that always suffices.
WALK = 64


def round_keys(seed: int) -> list[int]:
    """The rounds' keys: powers of a generator modulo PRIME from the seed on."""
    keys, k = [], (seed * 2 + 1) % PRIME or 1
    for _ in range(ROUNDS):
        k = k * 397_204_094 % PRIME
        keys.append(k)
    return keys


def side(rows: int) -> int:
    """The least a with a * a >= rows; below 2**31, so rows up to 2**62."""
    return math.isqrt(max(rows, 1) - 1) + 1


def _mixed(half, key):
    """The round function, for ints and for columns alike."""
    first, second, third = FACTORS
    return ((half * first + key) % PRIME * ((half * second + key) % PRIME) + key) % PRIME * third % PRIME


def _once(x: int, a: int, keys: list[int]) -> int:
    left, right = divmod(x, a)
    for key in keys:
        left, right = right, (left + _mixed(right, key)) % a
    return left * a + right


def _back(x: int, a: int, keys: list[int]) -> int:
    left, right = divmod(x, a)
    for key in reversed(keys):
        left, right = (right - _mixed(left, key)) % a, left
    return left * a + right


def place(row: int, rows: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    a, keys = side(rows), round_keys(seed)
    x = _once(row, a, keys)
    while x >= rows:
        x = _once(x, a, keys)
    return x % shards, x // shards


def row_at(shard: int, slot: int, rows: int, shards: int, seed: int = 0) -> int:
    """The row number that stands at a slot of a shard."""
    a, keys = side(rows), round_keys(seed)
    x = _back(slot * shards + shard, a, keys)
    while x >= rows:
        x = _back(x, a, keys)
    return x


def _permuted(x: Column, a: int, keys: list[int]) -> Column:
    """One pass of the network over a column of numbers below a * a."""
    side_ = F.lit(a).cast("bigint")
    right = x % side_
    left = F.call_function("div", x, side_)
    ends = F.aggregate(
        F.array(*(F.lit(k).cast("bigint") for k in keys)),
        F.struct(left.alias("l"), right.alias("r")),
        lambda s, key: F.struct(s["r"].alias("l"), ((s["l"] + _mixed(s["r"], key)) % side_).alias("r")),
    )
    return F.aggregate(F.array(ends), F.lit(0).cast("bigint"), lambda _, s: s["l"] * side_ + s["r"])


def permuted(x: Column, rows: int, seed: int = 0) -> Column:
    """The permutation of 0..rows-1. A walk leaves the numbers from rows on after as many steps as there are of them, at the latest."""
    a, keys = side(rows), round_keys(seed)
    beyond, top = a * a - rows, F.lit(rows).cast("bigint")

    def walked(y: Column, most: int) -> Column:
        """At most so many steps, none for a number that is in place."""
        step = lambda z, _: F.when(z >= top, _permuted(z, a, keys)).otherwise(z)
        return F.when(y < top, y).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(most)), y, step))

    out = _permuted(x, a, keys)
    for most in dict.fromkeys((min(WALK, beyond), beyond)):
        if most:
            out = F.aggregate(F.array(out), F.lit(0).cast("bigint"), lambda _, y: walked(y, most))  # noqa: B023 - called at once
    return out


def sharded(docs: DataFrame, shards: int = 16, seed: int = 0, digest: bool = False) -> DataFrame:
    """The columns of docs (with digest: doc_id alone) with size (UTF-8 bytes of the text plus 1), text_crc32 (unsigned), row (its global number), shard and slot.

    docs: doc_id, text and others; columns with the names of the new ones are replaced. The law is ``rows``: the counts of shards are at most one
    apart and the slots of a shard are gapless from 0, so equal texts are dealt like any others. Rows are numbered by doc_id (nulls first), then
    size, text_crc32 and a 64-bit hash of the text, so a null, repeated or very common doc_id is no special case; rows that are equal in all of
    these have each its own place, which of them is which is open. A null text has size 1 and the checksum of no bytes. An empty table gives none.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    own = ("size", "text_crc32", "shard", "slot", "row")
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = ["doc_id"] if digest else [c for c in docs.columns if c not in own]
    size, crc = (F.octet_length(text) + 1).cast("bigint"), F.crc32(F.encode(text, "UTF-8"))
    hashed = docs.select(F.struct(*kept).alias("_own"), F.col("doc_id").alias("_id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text).alias("_text"))
    out, rows = numbered(hashed, [F.col("_id"), F.col("size"), F.col("text_crc32"), F.col("_text")])
    n = F.lit(shards).cast("bigint")
    placed = out.withColumn("_p", permuted(F.col("row"), rows, seed))
    return placed.select("_own.*", "size", "text_crc32", "row", (F.col("_p") % n).cast("int").alias("shard"), F.call_function("div", F.col("_p"), n).alias("slot"))


def write_shards(placed: DataFrame, path: str, slots_a_file: int = 100_000) -> None:
    """A folder a shard, each file holding the next slots_a_file slots in order: a reader finds shard and slot by name and place.

    Files are dealt by (shard, slots), so neither a shard nor a file is gathered in one task beyond slots_a_file rows.
    """
    stretch = F.floor(F.col("slot") / slots_a_file).cast("bigint")
    files = placed.withColumn("stretch", stretch)
    files.repartition("shard", "stretch").sortWithinPartitions("shard", "stretch", "slot").write.partitionBy("shard", "stretch").option("compression", "zstd").mode("overwrite").parquet(path)


def forget(placed: DataFrame) -> None:
    """Deletes the table that sharded() keeps its row numbers in, once nothing reads the result any more."""
    dropped(placed)
