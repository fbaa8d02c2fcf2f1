"""Many models at a time: which motif belongs to which protein and peak file, fits and evaluations that go on past failures, and the whole run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import lookup_or_key
from ..sources import text
from . import pipeline

STATUS = "title string, ok boolean, error string, n bigint, iters int, converged boolean, warnings string"


def jobs_table(motifs: DataFrame, names: DataFrame, peaks: DataFrame, strict: bool = True) -> DataFrame:
    """title, motif, rbp, path, peaks_path: motif files (motif, path) joined by the motif map (motif, rbp) with peak files (motif, path).

    strict: only motifs with a name and a peak file. Else a motif without a name stands for itself, and peaks_path may be null.
    """
    files = motifs.select("motif", "path")
    named = files.join(names, "motif") if strict else lookup_or_key(files, names, "motif", "rbp")
    found = named.join(peaks.select(F.col("motif").alias("rbp"), F.col("path").alias("peaks_path")), "rbp", "inner" if strict else "left")
    return found.select(F.concat_ws("_", "rbp", "motif").alias("title"), "motif", "rbp", "path", "peaks_path").orderBy("title")


def _tried(f: Callable[[], DataFrame]) -> tuple[DataFrame | None, str | None]:
    try:
        return f(), None
    except Exception as e:  # noqa: BLE001  a failure is a row of the status table
        return None, f"{type(e).__name__}: {e}".splitlines()[0][:500]


def batch_fit(spark: SparkSession, jobs: Sequence[tuple[str, str]], out: str, feature_columns: Sequence[str] = pipeline.FEATURES, score: str = "s_l", legacy: bool = False) -> DataFrame:
    """Fits a model for each (title, Parquet path) and goes on past failures; all that can be read are fitted side by side.

    Writes ``out/models`` (rows with prior and posterior, a folder title=... each) and ``out/{title}.model.json``. Returns a row
    STATUS for each job, ok or with its error: unreadable, a column missing, no usable row, or no finite likelihood.
    """
    status: dict[str, dict] = {}
    tables = []
    for title, path in jobs:

        def read(title: str = title, path: str = path) -> DataFrame:
            df = spark.read.parquet(path)
            missing = [c for c in (score, *feature_columns) if c not in df.columns]
            if missing:
                raise ValueError(f"missing columns: {', '.join(missing)}")
            keep = [c for c in ("id", "PhastCons100_percent", "score_phastcons100") if c in df.columns]
            return df.select(F.lit(title).alias("title"), *dict.fromkeys([*keep, score, *feature_columns]))

        df, error = _tried(read)
        status[title] = {"ok": False, "error": error or "no row has a finite score and finite features"}
        if df is not None:
            tables.append(df)
    if tables:
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
        rows, fitted = pipeline.model_groups(every, "title", feature_columns, score, legacy=legacy)
        numbers = {r["title"]: r["count"] for r in rows.groupBy("title").count().collect()}  # a row a model
        for title, m in fitted.items():
            fine = all(x == x and abs(x) != float("inf") for x in (*m.beta, m.mu0, m.mu1, m.final_log_likelihood))
            status[title] = {"ok": fine, "error": None if fine else "the likelihood is not finite", "n": numbers.get(title, 0), "iters": m.iters, "converged": m.converged, "warnings": "; ".join(m.warnings)}
            if fine:
                text.write_json(spark, pipeline.model_record(m), f"{out}/{title}.model.json")
        good = [t for t, s in status.items() if s["ok"]]
        rows.where(F.col("title").isin(good)).write.mode("overwrite").partitionBy("title").parquet(f"{out}/models")
    return spark.createDataFrame([(t, s["ok"], s.get("error"), s.get("n"), s.get("iters"), s.get("converged"), s.get("warnings")) for t, s in status.items()], STATUS)


#: Names of the tables that an evaluation writes.
LOGS = (("metadata", "metrics"), ("beta_coefficients", "coefficients"), ("beta_coefficients_s_l", "coefficients_sl"))


def batch_evaluate(spark: SparkSession, jobs: Sequence[tuple[str, str]], structured: str, out: str, feature_columns: Sequence[str] = pipeline.FEATURES, limit: float = 1.0) -> DataFrame:
    """Evaluates the fitted models of all (title, peaks path) of ``out`` in the same passes, and goes on past failures.

    Writes ``out/logs/metadata`` and the two coefficient tables, a folder title=... each; titles that are not evaluated keep what they have there. A
    model or peak file that cannot be read is a row with its error; if the common run fails, the titles are run one by one to find whose fault it is.
    Returns title, ok, error and, where it worked, the metrics row.
    """
    errors: dict[str, str] = {}
    ready: dict[str, tuple] = {}
    for title, peaks in jobs:

        def read(title: str = title, peaks: str = peaks) -> tuple:
            model = pipeline.model_of_record(text.read_json(spark, f"{out}/{title}.model.json"))
            mark = F.lit(title).alias(pipeline.TITLE)
            rows = spark.read.parquet(f"{out}/models/title={title}").select("*", mark)
            return model, rows, text.read_peaks(spark, peaks).select("chrom", "strand", "start", "end", mark)

        found, error = _tried(read)
        if error:
            errors[title] = error
        else:
            ready[title] = found

    def run(titles: Sequence[str]) -> DataFrame:
        rows, peaks = (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (ready[t][k] for t in titles)) for k in (1, 2))
        tables = pipeline.evaluation_groups(rows, peaks, spark.read.parquet(structured), {t: ready[t][0] for t in titles}, feature_columns, limit)
        for name, table in LOGS:
            log = tables[table].withColumnRenamed(pipeline.TITLE, "title")
            text.write_table(log.coalesce(1), f"{out}/logs/{name}", compress=False, by="title")
        return tables["metrics"].drop(pipeline.TITLE)

    measured: list[DataFrame] = []
    if ready:
        every, error = _tried(lambda: run(list(ready)))
        if error is None:
            measured = [every]
        else:
            for title in ready:
                one, error = _tried(lambda title=title: run([title]))
                if error:
                    errors[title] = error
                else:
                    measured.append(one)
    states = spark.createDataFrame([(t, t not in errors, errors.get(t)) for t, _ in jobs], "title string, ok boolean, error string")
    if not measured:
        return states
    return states.join(reduce(DataFrame.unionByName, measured).withColumnRenamed("file_title", "title"), "title", "left")


def workflow(spark: SparkSession, folder: str, names: str, peaks: str, structured: str, native: DataFrame, fixed: DataFrame, resources: dict[str, DataFrame], out: str, dense: bool = False, suffix: str = ".tsv.gz", peaks_suffix: str = ".bed", inner: int = 50, outer: int = 500, threshold: int = 8, variants: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """From scanned tables to metrics: each motif file of ``folder`` is scored, annotated, fitted and evaluated against its protein's peaks.

    The motif is a key through one plan, so tracks and resources are read once for all motifs. resources: exons, regions, expression, phastcons, phylop.
    variants: more pairs of tracks, by name; each motif is scored by each of them as well, under its title, an underscore and the variant's name. Titles
    whose annotated table (a folder title=... below ``out/annotated``) is there are not made again. If the common plan fails, the motifs are run one by
    one to find whose fault it is. Returns the status of each title: that of its last step.
    """
    found = jobs_table(text.discover(spark, f"{folder}/*{suffix}", suffix), text.read_motif_map(spark, names), text.discover(spark, f"{peaks}/*{peaks_suffix}", peaks_suffix))
    tracks = {"": (native, fixed)} | (variants or {})
    titles = {(f"{r['title']}_{v}" if v else r["title"]): (r, v) for r in found.collect() for v in tracks}  # a row a motif
    made = lambda t: text.exists(spark, f"{out}/annotated/title={t}")
    marked = lambda k: reduce(DataFrame.unionByName, (pair[k].withColumn("variant", F.lit(v)) for v, pair in tracks.items()))

    def annotate(wanted: Sequence[str]) -> DataFrame:
        parts = [text.read_sites(spark, titles[t][0]["path"]).withColumns({"title": F.lit(t), "variant": F.lit(titles[t][1])}) for t in wanted]
        scored = pipeline.accessibility(reduce(DataFrame.unionByName, parts), marked(0), marked(1), inner, outer, threshold, dense, ("title",), ("variant",)).drop("variant")
        done = pipeline.annotation(scored, **resources, by=("title",))
        order = ("title", "chrom", "pos1", "strand")
        done.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("title").parquet(f"{out}/annotated")
        return done

    errors: dict[str, str] = {}
    todo = [t for t in titles if not made(t)]
    if todo and _tried(lambda: annotate(todo))[1]:
        for t in todo:
            _, error = _tried(lambda t=t: annotate([t]))
            if error:
                errors[t] = error
    ready = [t for t in titles if t not in errors and made(t)]
    errors |= {t: "no site has enough signal and conservation" for t in titles if t not in errors and t not in ready}
    states = {s["title"]: s for s in batch_fit(spark, [(t, f"{out}/annotated/title={t}") for t in ready], out).collect()}
    measured = batch_evaluate(spark, [(t, titles[t][0]["peaks_path"]) for t in ready if states[t]["ok"]], structured, out)
    errors |= {t: s["error"] for t, s in states.items() if not s["ok"]}
    return measured.unionByName(spark.createDataFrame([(t, False, e) for t, e in errors.items()], "title string, ok boolean, error string"), allowMissingColumns=True)
