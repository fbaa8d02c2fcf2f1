"""The registered queries of this subpackage and, where DuckDB can say the same, their SQL.

Each callable takes (spark, sf_dir), reads its whole tables and derives the digest columns from its operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_digests
from .decontaminate import decontaminate, items_digest
from .hard_negatives import HIGH, LOW, NEGATIVES, POSITIVES, hard_negatives
from .line_dedup import line_dedup
from .near_dedup import near_duplicates
from .pii import KINDS, count_of, find_personal_data, listed
from .search import B, K1, UNIT, top_k
from .sharding import FACTORS, PRIME, round_keys, sharded
from .suffix_dedup import substring_dedup
from .token_files import token_index
from .toxicity import fit_toxicity, held_out, score_toxicity
from .url_filter import LIMIT, RHO, Z, judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The vocabularies are installed with every Python; the end id closes each document of the token files.
WORD_TOKENIZER, END_ID = "word_bpe_49k.json", 1
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = (count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS)
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")  # of the page with the same number: bad if toxic or of low quality
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.greatest("toxic", 1 - F.col("quality")).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = rf"""
WITH rest AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS r FROM pages
), own AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), hosts AS (
  SELECT host, regexp_extract(host, '([^.]*\.?[^.]*)$', 1) AS domain, regexp_extract(host, '([^.]*)$', 1) AS suffix,
         CAST(count(*) AS DOUBLE) AS n, CAST(sum(greatest(toxic, 1 - quality)) AS DOUBLE) AS bad
  FROM own JOIN labels ON doc_id = page_id WHERE greatest(toxic, 1 - quality) IS NOT NULL GROUP BY host
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), whole AS (
  SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM suffixes
), sk AS (
  SELECT 1 / least(greatest(coalesce(round(sum(n * pow(bad / n - m, 2) - m * (1 - m)) / nullif(sum(m * (1 - m) * (n - 1)), 0), 9), {RHO[1]}), {RHO[0]}), {RHO[1]}) - 1 AS k
  FROM suffixes, whole
), sp AS (
  SELECT suffix, (bad + k * m) / (n + k) AS mean, n + k AS size FROM suffixes, whole, sk
), dk AS (
  SELECT 1 / least(greatest(coalesce(round(sum(n * pow(bad / n - mean, 2) - mean * (1 - mean)) / nullif(sum(mean * (1 - mean) * (n - 1)), 0), 9), {RHO[1]}), {RHO[0]}), {RHO[1]}) - 1 AS k
  FROM domains JOIN sp USING (suffix)
), dp AS (
  SELECT domain, (bad + k * mean) / (n + k) AS mean, n + k AS size FROM domains JOIN sp USING (suffix), dk
), hk AS (
  SELECT 1 / least(greatest(coalesce(round(sum(n * pow(bad / n - mean, 2) - mean * (1 - mean)) / nullif(sum(mean * (1 - mean) * (n - 1)), 0), 9), {RHO[1]}), {RHO[0]}), {RHO[1]}) - 1 AS k
  FROM hosts JOIN dp USING (domain)
), hp AS (
  SELECT host, (bad + k * mean) / (n + k) AS mean, n + k AS size FROM hosts JOIN dp USING (domain), hk
), judged AS (
  SELECT o.page_id, o.host, o.path,
         coalesce(hp.mean, dp.mean, sp.mean, whole.m) AS mean, coalesce(hp.size, dp.size, sp.size, 0) AS size
  FROM own o CROSS JOIN whole
  LEFT JOIN hp ON hp.host = o.host
  LEFT JOIN dp ON dp.domain = regexp_extract(o.host, '([^.]*\.?[^.]*)$', 1)
  LEFT JOIN sp ON sp.suffix = regexp_extract(o.host, '([^.]*)$', 1)
), rules(v, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT DISTINCT j.host, j.path, max_by(h || p, len(h || p)) AS rule, max_by(v, len(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM judged) j JOIN rules ON (j.host = h OR ends_with(j.host, '.' || h)) AND starts_with(j.path, p)
  GROUP BY j.host, j.path
)
SELECT j.page_id, j.host, j.path, f.rule,
       coalesce(f.v, CASE WHEN round(mean - {Z} * sqrt(mean * (1 - mean) / (size + 1)), 9) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN fit f ON f.host = j.host AND f.path = j.path
"""


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, k=5)


OP4_SQL = r"""
WITH RECURSIVE ws AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM ws WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n a ON a.doc_id = p.a JOIN n b ON b.doc_id = p.b
  WHERE 100 * inter >= 85 * (a.n + b.n - inter)
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON r.doc_id = l.a
), comp AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
FROM comp c LEFT JOIN n ON n.doc_id = c.doc_id
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents"), digest=True)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return cut.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))


OP5_SQL = r"""
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM b WHERE n >= 100)
), dup AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM w) WHERE r > 1
), runs AS (
  SELECT doc_id, min(p) AS s, max(p) + 100 AS e
  FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g
        FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM dup))
  GROUP BY doc_id, g
), edges AS (
  SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM runs GROUP BY doc_id
), pieces AS (
  SELECT b.doc_id, j, substr(h, 2 * CASE WHEN j = 1 THEN 0 ELSE es[j - 1] END + 1, 2 * (coalesce(ss[j], n) - CASE WHEN j = 1 THEN 0 ELSE es[j - 1] END)) AS x
  FROM b JOIN edges ON b.doc_id = edges.doc_id, unnest(range(1, n_spans + 2)) AS t(j)
), kept AS (
  SELECT doc_id, sha256(unhex(string_agg(x, '' ORDER BY j))) AS d FROM pieces GROUP BY doc_id
)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       coalesce(kept.d, sha256(unhex(b.h))) AS kept_sha256
FROM b LEFT JOIN edges ON edges.doc_id = b.doc_id LEFT JOIN kept ON kept.doc_id = b.doc_id
"""


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items_digest(F.col("items")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
  FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
  FROM benchmark
), wins AS (
  SELECT DISTINCT item, n, array_to_string(ws[p:p + n - 1], ' ') AS w
  FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 8, 2))) AS p FROM iw WHERE len(ws) > 0)
), spots AS (
  SELECT doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM wins) WHERE len(ws) >= n)
), occ AS (
  SELECT s.doc_id, s.p, s.n, w.item FROM spots s JOIN wins w ON s.w = w.w AND s.n = w.n
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(l.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN listed l ON d.doc_id = l.doc_id
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), decided AS (
  SELECT l.doc_id, l.pos, l.line, r.k IS NOT NULL AND l.doc_id <> r.keeper AS gone FROM keyed l LEFT JOIN repeated r ON l.k = r.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM decided GROUP BY doc_id
"""

#: Every row with such an id is a query.
QUERY_STEP, TOP = 20, 10


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where(F.col("doc_id") % QUERY_STEP == 0).select(F.col("doc_id").alias("query_id"), "text")
    return top_k(docs, queries, TOP)


OP10_SQL = rf"""
WITH tf AS (
  SELECT doc_id, t, count(*) AS tf
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS t FROM documents)
  GROUP BY doc_id, t
), len AS (
  SELECT d.doc_id, coalesce(sum(tf), 0) AS n FROM documents d LEFT JOIN tf ON tf.doc_id = d.doc_id GROUP BY d.doc_id
), whole AS (
  SELECT CAST(count(*) AS DOUBLE) AS docs, CAST(sum(n) AS DOUBLE) / count(*) AS average FROM len
), idf AS (
  SELECT t, ln(1 + (max(docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, whole GROUP BY t
), scored AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         sum(CAST(round(idf * d.tf * {K1 + 1}::DOUBLE / (d.tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * n / average)) * {UNIT}) AS BIGINT)) AS points
  FROM tf q JOIN tf d ON d.t = q.t JOIN idf ON idf.t = q.t JOIN len ON len.doc_id = d.doc_id, whole
  WHERE q.doc_id % {QUERY_STEP} = 0
  GROUP BY 1, 2
)
SELECT query_id, rank, doc_id, CAST(points AS DOUBLE) / {UNIT} AS score
FROM (SELECT query_id, doc_id, points, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id) AS rank FROM scored WHERE points > 0)
WHERE rank <= {TOP}
"""

#: Rows whose vec_id is divisible by this are anchors.
ANCHOR_STEP = 50


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % ANCHOR_STEP == 0)


OP11_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, a.label = b.label AS same, b.rid, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % {ANCHOR_STEP} = 0
), pos AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) AS p FROM s WHERE same) WHERE p <= {POSITIVES}
), neg AS (
  SELECT pos.anchor_id, pos.vec_id AS positive_id, s.vec_id AS negative_id, pos.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY pos.arid, pos.p ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM pos JOIN s ON s.arid = pos.arid WHERE NOT s.same AND {LOW} * pos.score <= 100 * s.score AND 100 * s.score <= {HIGH} * pos.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {NEGATIVES}
"""

SHARDS, SHARD_SEED = 16, 0


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS, SHARD_SEED, digest=True)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_entry(bit: int) -> int:
    """What a bit of the low byte adds when a CRC-32 register moves on by a byte."""
    c = 1 << bit
    for _ in range(8):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


def _feistel_sql() -> str:
    """The network over x (to the base a), a subquery a round."""
    first, second, third = FACTORS
    out = "SELECT rid, n, a, steps, x // a AS l, x % a AS r FROM todo WHERE steps = 0 OR x >= n"
    for key in round_keys(SHARD_SEED):
        mixed = f"(((r * {first} + {key}) % {PRIME}) * ((r * {second} + {key}) % {PRIME}) + {key}) % {PRIME} * {third} % {PRIME}"
        out = f"SELECT rid, n, a, steps, r AS l, (l + {mixed}) % a AS r FROM ({out})"
    return f"SELECT rid, n, a, steps + 1 AS steps, l * a + r AS x FROM ({out})"


_NEXT = "c >> 8"
for _bit in range(8):
    _NEXT = f"xor({_NEXT}, ((xor(c, x) >> {_bit}) & 1) * {_crc_entry(_bit)})"
OP12_SQL = f"""
WITH RECURSIVE bytes AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b
  FROM documents
), own AS (
  SELECT doc_id, size, xor(CAST(4294967295 AS BIGINT), list_reduce(b, lambda c, x: {_NEXT}, CAST(4294967295 AS BIGINT))) AS text_crc32 FROM bytes
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS rid, count(*) OVER () AS n FROM own
), todo(rid, n, a, steps, x) AS (
  SELECT rid, n, CAST(ceil(sqrt(n)) AS BIGINT), 0, rid FROM numbered
  UNION ALL
  SELECT rid, n, a, steps, x FROM ({_feistel_sql()})
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {SHARDS} AS INT) AS shard, x // {SHARDS} AS slot, CAST(NULL AS INT) AS grown_shard
FROM numbered JOIN todo USING (rid) WHERE steps > 0 AND x < todo.n
"""

QUERIES = {
    "op1_pii": op1_pii,
    "op2_token_files": op2_token_files,
    "op3_url_filter": op3_url_filter,
    "op4_near_dedup": op4_near_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_line_dedup": op9_line_dedup,
    "op10_topk_search": op10_topk_search,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_shards": op12_shards,
}
ORACLES = {
    "op3_url_filter": OP3_SQL,
    "op4_near_dedup": OP4_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op8_decontaminate": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_topk_search": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_shards": OP12_SQL,
}
