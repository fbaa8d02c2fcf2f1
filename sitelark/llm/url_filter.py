"""URL filter: fixed rules first, then empirical-Bayes host reputation (DataFrame operations only).

Labelled pages give each host good and bad outcomes. Their rates are shrunk through beta-binomial priors from the suffix to
the registered domain to the host: each level's prior has its parent's posterior mean, and a strength estimated from how
much the children of all parents vary beyond binomial noise. A host is blocked if even the lower bound of its
posterior bad rate is above a limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import LOWER, UPPER
from .shared import written

#: Rules (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Standard deviations of the bound, bad rate above which a host is blocked, and limits of the estimated correlation.
Z, LIMIT = 1.645, 0.5
RHO = (0.0001, 0.5)
#: A key with more than this share of a table's rows is hot; there are fewer than 1 / HOT of them.
HOT = 1 / 2000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of rules of one length the first given wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(list(rules)), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _with_facts(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with facts, which have one row for each key. The facts of hot keys are sent (fewer than 1 / HOT rows), so that rows
    of one key are never gathered; the others are dealt out by key."""
    counts = written(rows.groupBy(key).count(), "key-counts")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("count") > HOT * total).select(key))
    few = rows.join(hot, key, "left_semi").join(F.broadcast(facts.join(hot, key, "left_semi")), key, how)
    return few.unionByName(rows.join(hot, key, "left_anti").join(facts, key, how))


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """outcomes: host, n, bad. Posterior (mean and strength-weighted counts) for all, suffixes, domains and hosts."""
    label = F.regexp_extract("host", r"([^.]*)$", 1)
    domain = F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1)
    hosts = outcomes.select("host", domain.alias("domain"), label.alias("suffix"), F.col("n").cast("double").alias("n"), F.col("bad").cast("double").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("m"))
    # each level is written, so that the next one's plan starts from its rows
    suffixes = written(_shrunk(suffixes.crossJoin(F.broadcast(whole)).withColumnRenamed("m", "prior")), "suffixes")  # whole is one row
    domains = written(_shrunk(_with_facts(domains, suffixes.select("suffix", F.col("mean").alias("prior")), "suffix")), "domains")
    hosts = written(_shrunk(_with_facts(hosts, domains.select("domain", F.col("mean").alias("prior")), "domain")), "hosts")
    return whole, suffixes, domains, hosts


def _shrunk(level: DataFrame) -> DataFrame:
    """level: n, bad, prior. Adds mean and size (a + b) of the beta posterior, with one strength for the whole level."""
    noise = F.col("prior") * (1 - F.col("prior"))
    beyond = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) - noise)
    room = F.sum(noise * (F.col("n") - 1))
    rho = F.least(F.greatest(F.coalesce(F.round(F.when(room > 0, beyond / room), 9), F.lit(RHO[1])), F.lit(RHO[0])), F.lit(RHO[1]))
    strength = level.agg((1 / rho - 1).alias("k"))
    out = level.crossJoin(F.broadcast(strength))  # strength is one row
    size = F.col("n") + F.col("k")
    return out.withColumn("mean", (F.col("bad") + F.col("k") * F.col("prior")) / size).withColumn("size", size).drop("prior", "k")


def lower_bound(mean: Column, size: Column) -> Column:
    return mean - F.lit(Z) * F.sqrt(mean * (1 - mean) / (size + 1))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """A verdict, allow or block, for every page.

    pages: page_id, url. outcomes: page_id, bad (0 or 1), labels of some pages. Other columns are ignored. rules: as RULES, a short
    list (it becomes one expression). Returns a row for each row of pages: page_id, host, path, rule (null if none fits),
    verdict, and bad_rate and bad_bound of the host's posterior. A null url, or one without ``://``, has an empty host and path.
    Hosts without labels take their domain's, suffix's or the overall posterior. Pages with a null page_id have no outcome;
    each label of a page counts. Without any labels the overall rate is one half with no evidence, and nothing is blocked.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col("page_id"), F.col("url").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.select(F.col("page_id").alias("page_id"), F.col("bad").cast("int").alias("bad")).where("bad is not null")
    counted = written(own.join(known, "page_id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")), "outcomes")
    whole, suffixes, domains, hosts = reputation(counted)
    # one row for each host that occurs
    seen = own.select("host").distinct().withColumn("domain", F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1)).withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))
    pick = lambda df, key, tag: df.select(key, F.col("mean").alias(f"m_{tag}"), F.col("size").alias(f"s_{tag}"))
    judged = written(seen.join(pick(hosts, "host", "h"), "host", "left"), "seen")
    judged = written(_with_facts(judged, pick(domains, "domain", "d"), "domain", "left"), "seen")
    judged = _with_facts(judged, pick(suffixes, "suffix", "s"), "suffix", "left").crossJoin(F.broadcast(whole))  # whole is one row
    mean, size = F.coalesce("m_h", "m_d", "m_s", "m"), F.coalesce("s_h", "s_d", "s_s", F.lit(0.0))
    judged = written(judged.select("host", mean.alias("bad_rate"), lower_bound(mean, size).alias("bad_bound")), "judged")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    method = F.when(F.round("bad_bound", 9) > LIMIT, "block").otherwise("allow")
    return _with_facts(own, judged, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bad_rate", "bad_bound")
