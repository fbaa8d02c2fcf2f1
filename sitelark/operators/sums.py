"""Sums by group that numpy takes of Arrow batches: one vector a group and task, merged by group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = "g int, s array<double>"


def group_numbers(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[tuple]]:
    """df with _g, the number of each row's group, and the groups in their order; rows with a null in ``by`` are left out."""
    groups = df.select(*by).dropna().distinct().orderBy(*by).collect()  # a row a group
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)
    known = df.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(groups)], f"{kinds}, _g int")
    return df.join(F.broadcast(known), list(by)), [tuple(r) for r in groups]


def group_sums(rows: DataFrame, columns: Sequence[str], f: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """The sum over each group's rows of f(group, matrix of columns), a vector of one length.

    rows: _g (int) and columns (numbers, no nulls). f sees the rows of a group a batch at a time; a task hands on one vector for each of its groups, and these
    are added by group, so no group is gathered and what is shuffled does not grow with the rows of a task.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy()
            x = np.column_stack([batch.column(k + 1).to_numpy() for k in range(len(columns))])
            order = np.argsort(g, kind="stable")
            g, x = g[order], x[order]
            edges = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                k = int(g[a])
                v = f(k, x[a:b])
                total[k] = total[k] + v if k in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["g", "s"])

    def add(part: pa.Table) -> pa.Table:
        whole = np.sum([np.array(v) for v in part["s"].to_pylist()], axis=0)
        return pa.table({"g": part["g"][:1].cast(pa.int32()), "s": pa.array([whole.tolist()], pa.list_(pa.float64()))})

    partials = rows.select("_g", *columns).mapInArrow(partial, SUMS)
    return {r["g"]: np.array(r["s"]) for r in partials.groupBy("g").applyInArrow(add, SUMS).collect()}


def packed(*parts: np.ndarray | float) -> np.ndarray:
    """All parts behind each other as one vector."""
    return np.concatenate([np.ravel(p) for p in parts])
