"""Shared steps of the operators that link rows: written intermediates, whole runs of sorted rows, connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.session import shared_folder


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs no recomputation before it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from the sorted batches of one partition."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, dtype=bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            changes[1:] |= values[1:] != values[:-1]
            if pending:
                changes[0] |= pending[-1].column(key)[-1].as_py() != values[0]
        starts = np.flatnonzero(changes)
        if len(starts):
            cut = int(starts[-1])
            done = [*pending, batch.slice(0, cut)] if cut else pending
            if done:
                yield pa.Table.from_batches(done)
            pending = [batch.slice(cut)]
        else:
            pending.append(batch)
    if pending:
        yield pa.Table.from_batches(pending)


def run_bounds(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    changes = np.zeros(table.num_rows, dtype=bool)
    changes[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        changes[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(changes), table.num_rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node that it is connected with.

    Alternates large-star and small-star steps until nothing changes; every step's edges are at most as many as before
    and are written to the shared folder. Minima are combined before the shuffle, so a node with very many edges is not gathered anywhere.
    """
    kept = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        both = kept.union(kept.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.filter("m < a")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        kept = written(small.distinct())
        now = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return kept.select(F.col("a").alias("node"), F.col("b").alias("component")).union(kept.select("b", "b").distinct())
        seen = now
