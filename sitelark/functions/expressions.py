"""Column expressions of the site pipeline. All stay inside whole-stage code generation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complement of each base; U pairs like T, letters that are no base stay.
BASES, COMPLEMENT = "ACGTU", "TGCAA"


def difference(a: Column, b: Column) -> Column:
    return a - b


def site_id(chrom: Column, pos: Column, strand: Column) -> Column:
    return F.concat_ws("_", chrom, pos.cast("string"), strand)


def parsed_site_id(site: Column) -> tuple[Column, Column, Column]:
    """chrom, pos, strand of an id; the chromosome may hold underscores. Null where the id has another form."""
    form = r"^(.*)_(\d+)_([+-])$"
    part = lambda k: F.nullif(F.regexp_extract(site, form, k), F.lit(""))
    return part(1), part(2).cast("bigint"), part(3)


def bare_chromosome(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def window_bounds(pos: Column, inner: int, outer: int) -> dict[str, Column]:
    """Half-open windows around a site, the centre taken as it is (see DEVIATIONS in the README)."""
    return {"inner_start": pos - inner, "inner_end": pos + inner, "outer_start": pos - outer, "outer_end": pos + outer}


def tss_proximity(transcript_start: Column) -> Column:
    return F.coalesce(1 / (1 + transcript_start / 1000), F.lit(0.0))


def transcript_share(transcript_start: Column, transcript_length: Column) -> Column:
    """1 / (1 + start / length); infinity for a site without a transcript."""
    return F.when(transcript_start.isNull() | transcript_length.isNull(), F.lit(math.inf)).otherwise(1 / (1 + transcript_start / F.nullif(transcript_length, F.lit(0))))


def overlap_fraction(start: Column, end: Column, other_start: Column, other_end: Column, width: int = 100) -> Column:
    """Share of a site's window that a region covers; 0 for a site without a region."""
    covered = (F.least(end, other_end) - F.greatest(start, other_start)) / width
    return F.when(other_start.isNull() | other_end.isNull(), F.lit(0.0)).otherwise(F.greatest(covered, F.lit(0.0)))


def soft_clip(x: Column, limit: float = 40.0) -> Column:
    return F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-soft_clip(x)))


def normal_logpdf(x: Column, mu: Column | float, sigma: Column | float) -> Column:
    mu, sigma = (v if isinstance(v, Column) else F.lit(v) for v in (mu, sigma))
    z = (x - mu) / sigma
    return -0.5 * z * z - F.ln(sigma) - 0.5 * math.log(2 * math.pi)


def normal_pdf(x: Column, mu: Column | float, sigma: Column | float) -> Column:
    return F.exp(normal_logpdf(x, mu, sigma))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENT))


def is_gc(base: Column) -> Column:
    return base.isin("G", "C").cast("int")


def erf(x: Column) -> Column:
    """A rational approximation of the error function, within 1.5e-7."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def normal_cdf(x: Column, mu: Column, sigma: Column) -> Column:
    return 0.5 * (1 + erf((x - mu) / (sigma * math.sqrt(2))))


def places(c: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending cuts are not above c, by halving a constant array; null counts none."""
    known = F.array(*(F.lit(float(x)) for x in cuts)).cast("array<double>")

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        open_ = a["lo"] < a["hi"]
        up = open_ & F.coalesce(F.get(known, mid) <= c, F.lit(False))
        return F.struct(F.when(up, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~up, mid).otherwise(a["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), step)["lo"]


def word(c: Column, k: int, separator: str) -> Column:
    """The k-th word, from 1, of a text cut at a separator; empty if there are fewer."""
    return F.split_part(c, F.lit(separator), F.lit(k))


def without(c: Column, pattern: str) -> Column:
    """A text without all that a pattern matches."""
    return F.regexp_replace(c, pattern, "")
