"""Line dedup over levelled sorted runs of line hashes (DataFrame operations only).

A run is a Parquet table bucketed and sorted by a 128-bit line hash, with a row ``(h1, h2, n_docs, max_doc)`` for each key. When
``fan_out`` runs stand on a level they are compacted into one run of the next level, and so on upwards.

Documents arrive in batches from the largest doc_ids down. A batch's keys are merge-joined with the runs: keys that are settled there, as
they have their min_docs documents, are anti-joined away; a key that the batch brings up to min_docs is settled now, and the largest
doc_id seen so far keeps it, as no later batch can hold a larger one; all keys not settled before are added as the batch's own run.
At the end the lines of settled keys go, except in the document that keeps the key. Keys are counted before they are shuffled, so a very
common line is one row a task; texts are shuffled once, by document and text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import deleted, fresh_path, written

#: Runs of a level that are compacted into one run of the next level: by default, and in line_dedup(); batches of documents.
FAN_OUT, DEDUP_FAN_OUT, BATCHES = 4, 2, 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z in lower case; other letters stay as they are."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(text: Column, min_chars: int) -> Column:
    """For each line of a text its 128-bit hash, null where the key has fewer than min_chars code points.

    xxhash64 passes a column's hash on as the seed of the next, so the key comes last in both, under two seeds.
    """
    keys = F.transform(F.split(text, "\n", -1), line_key)
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))


class LineRuns:
    """The levels of one store of runs, under one folder of the shared directory.

    A run has a file a bucket, written by the task that holds the bucket's keys. Joins of keys with runs shuffle no run, and two runs are compacted
    bucket by bucket by a merge join; more than two at a time are shuffled. A compacted run's parts are deleted at once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan_out: int = FAN_OUT):
        self.spark, self.path, self.fan_out = spark, path or fresh_path(spark, "line-runs"), fan_out
        self.levels: list[list[str]] = []
        self.made: list[str] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def put(self, run: DataFrame, level: int = 0) -> DataFrame:
        """Writes run, whose rows of one key stand alone and in one task, as a run of a level, and gives it back as read."""
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"line_run_{uuid.uuid4().hex}"
        self.made.append(name)
        run.write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.levels[level].append(name)
        return self.spark.table(name)

    def add(self, pairs: DataFrame) -> None:
        """Adds a batch of distinct ``(h1, h2, doc_id)``, each batch with documents of its own, as a run of its keys."""
        self.put(pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc")))
        self.compact()

    def compact(self) -> None:
        """Puts the runs of each level that is full together to one of the next."""
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_out:
            parts = self.levels[level]
            self.put(self._merged(parts), level + 1)
            self.levels[level] = []
            for name in parts:
                self._drop(name)
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        if len(names) == 2:  # bucket by bucket
            one, other = (self.spark.table(name).select("h1", "h2", F.col("n_docs").alias(f"n_{k}"), F.col("max_doc").alias(f"max_{k}")) for k, name in enumerate(names))
            n = F.coalesce("n_0", F.lit(0)) + F.coalesce("n_1", F.lit(0))
            return one.hint("merge").join(other, ["h1", "h2"], "full").select("h1", "h2", n.alias("n_docs"), F.greatest("max_0", "max_1").alias("max_doc"))
        whole = self.spark.read.parquet(*(f"{self.path}/{name}" for name in names)).select("h1", "h2", "n_docs", "max_doc")
        return whole.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        deleted(self.spark, f"{self.path}/{name}")
        self.made.remove(name)

    def totals(self) -> DataFrame:
        """h1, h2, n_docs, max_doc over all runs of all levels."""
        return self._merged([name for level in self.levels for name in level])

    def met(self, keys: DataFrame) -> DataFrame:
        """keys with n_before and max_before: what the runs of all levels hold of each key (0 and null if nothing), a merge join a run."""
        out = keys.withColumn("n_before", F.lit(0).cast("long")).withColumn("max_before", F.lit(None).cast(keys.schema["max_doc"].dataType))
        for name in (name for level in self.levels for name in level):
            run = self.spark.table(name).select("h1", "h2", F.col("n_docs").alias("n_run"), F.col("max_doc").alias("max_run"))
            out = out.join(run.hint("merge"), ["h1", "h2"], "left").withColumn("n_before", F.col("n_before") + F.coalesce("n_run", F.lit(0))).withColumn("max_before", F.greatest("max_before", "max_run")).drop("n_run", "max_run")
        return out

    def forget(self) -> None:
        """Takes the runs off the catalogue and deletes them, once nothing reads them any more."""
        for name in list(self.made):
            self._drop(name)
        deleted(self.spark, self.path)


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, carry: bool = False) -> DataFrame:
    """Drops lines that repeat across documents; keeps them in the largest doc_id that holds them.

    docs: doc_id, text; other columns are ignored, or with carry kept in a struct ``rest``. Returns doc_id, text (the lines that
    stay, joined by ``\\n``), n_lines and n_dropped, a row for each row of docs. A null or empty text is one empty line. Rows that share a doc_id
    count as one document for the number of documents; a null doc_id counts as one document that never keeps a key
    for itself. Ties cannot arise: a key has one largest doc_id, and all its lines there stay. No rows in, no rows out.
    """
    spark = docs.sparkSession
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    rest = [F.struct(*others).alias("rest")] if carry and others else []
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("sub"), *rest)  # sub keeps rows of one id apart
    cuts = own.agg(F.percentile_approx("doc_id", [k / BATCHES for k in range(BATCHES - 1, 0, -1)])).first()[0] or []  # for balance only
    batch = F.when(F.col("doc_id").isNull(), BATCHES - 1).otherwise(sum((F.when(F.col("doc_id") <= c, 1).otherwise(0) for c in cuts), F.lit(0)))
    hashes = F.array_distinct(F.filter(line_hashes(F.col("text"), min_chars), lambda h: h.isNotNull()))
    folder = fresh_path(spark, "line-arrivals")  # one pass over the texts; batch b is the folder batch=b
    own.select("doc_id", "sub", batch.alias("batch"), F.explode(hashes).alias("h")).select("doc_id", "sub", "batch", "h.h1", "h.h2").write.partitionBy("batch").option("compression", "zstd").parquet(folder)
    kind = own.schema["doc_id"].dataType.simpleString()
    arrivals = spark.read.schema(f"doc_id {kind}, sub bigint, h1 bigint, h2 bigint, batch int").parquet(folder)
    runs = LineRuns(spark, fan_out=DEDUP_FAN_OUT)
    settled = f"{fresh_path(spark, 'line-settled')}"
    try:
        for b in range(BATCHES):
            if not _exists(spark, f"{folder}/batch={b}"):
                continue
            # rows may share a doc_id: distinct by document first, which spreads a common line, then counted before the shuffle by line
            keys = arrivals.where(F.col("batch") == b).select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
            met = runs.put(runs.met(keys).where(F.col("n_before") < min_docs))
            met.where(F.col("n_before") + F.col("n_docs") >= min_docs).select("h1", "h2", F.greatest("max_before", "max_doc").alias("keeper")).write.mode("append").option("compression", "zstd").parquet(settled)
            if b < BATCHES - 1:
                runs.compact()
    finally:
        runs.forget()
    if not _exists(spark, settled):
        gone = spark.createDataFrame([], f"doc_id {kind}, sub bigint, gone array<struct<h1:bigint,h2:bigint>>")
    else:
        found = spark.read.schema(f"h1 bigint, h2 bigint, keeper {kind}").parquet(settled)
        hits = arrivals.join(found, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        gone = written(hits.groupBy("doc_id", "sub").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")), "line-gone")
    deleted(spark, folder)
    deleted(spark, settled)
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.sub") == F.col("g.sub"))
    joined = own.alias("d").join(gone.hint("shuffle_hash").alias("g"), same, "left").select("d.*", F.col("g.gone"))
    lines = F.split("text", "\n", -1)
    kept = F.transform(
        F.filter(F.arrays_zip(lines.alias("line"), line_hashes(F.col("text"), min_chars).alias("h")), lambda z: z["h"].isNull() | ~F.array_contains(F.col("gone"), z["h"])),
        lambda z: z["line"],
    )
    decided = joined.withColumn("kept", F.when(F.col("gone").isNotNull(), kept)).withColumn("n_lines", F.size(lines))
    return decided.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        F.col("n_lines").cast("long"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
        *(["rest"] if rest else []),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
