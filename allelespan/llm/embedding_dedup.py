"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and fast Hadamard transforms. One hash function gives the axis and sign of
its largest coordinate; a table's cell joins ``functions`` of them, as many as the number of vectors asks for, so that
unlike vectors seldom meet. A vector lies in its own cell of each of ``tables`` tables and also visits the cells
in which one function takes its second or third best axis (multiprobe). With more functions a pair meets less often in one table, so
the number of tables rises until a pair at the least cosine is met with the probability ``recall``, whatever the number of vectors. Two vectors are compared where one of
them visits the other's own cell, by their exact cosine in double precision.

Equal vectors are one class with a count. A pair that meets several times counts where it meets first. Pairs are counted where they are compared and never
leave the task: it returns sums per vector and a spanning forest of its links. Cells with more than ``block`` vectors
are compared block against block in tasks of their own. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.llm.arrow_columns import append_columns, let_workers_import
from allelespan.llm.linking import components, run_bounds, whole_runs, written
from allelespan.llm.word_hashes import mix

_SEED = 20250102


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    width, step = rows.shape[1], 1
    while step < width:
        pairs = rows.reshape(len(rows), -1, 2, step)
        rows = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(rows), width)
        step *= 2
    return rows / math.sqrt(width)


def cells(vectors: np.ndarray, tables: int, functions: int, probes: int) -> np.ndarray:
    """Cells of unit vectors, [vector, table, probe] as 64-bit hashes; probe 0 is the vector's own cell."""
    count, size = vectors.shape
    width = 1 << max(1, (size - 1).bit_length())
    padded = np.zeros((count, width))
    padded[:, :size] = vectors
    out = np.zeros((count, tables, 1 + probes), dtype=np.uint64)
    every = np.arange(count)
    for table in range(tables):
        choices, losses = [], []
        for function in range(functions):
            random = np.random.default_rng([_SEED, table, function, width])
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * random.choice([-1.0, 1.0], width))
            best = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, : min(3, width)]
            heights = np.take_along_axis(np.abs(turned), best, 1)
            codes = (2 * best + (np.take_along_axis(turned, best, 1) < 0)).astype(np.uint64)
            choices.append(codes)
            losses.extend((function, k, heights[:, 0] - heights[:, k]) for k in range(1, best.shape[1]))
        own = np.full(count, ((table + 1) * 0x9E3779B97F4A7C15 + size) % 2**64, dtype=np.uint64)
        parts = [mix(c[:, 0] + np.uint64(1 + (function << 32))) for function, c in enumerate(choices)]
        base = own + sum(parts)
        out[:, table, 0] = mix(base)
        order = np.argsort(np.stack([loss for _, _, loss in losses]), axis=0, kind="stable")
        other = np.stack([base - parts[f] + mix(choices[f][:, k] + np.uint64(1 + (f << 32))) for f, k, _ in losses])
        for probe in range(probes):
            out[:, table, 1 + probe] = mix(other[order[min(probe, len(losses) - 1)], every])
    return out


def tables_for(recall: float, cosine: float, size: int, functions: int, probes: int) -> int:
    """Tables that let a pair at ``cosine`` meet with probability ``recall``, from how often planted pairs of that size meet in one table; 8 at least.

    Turned at random, all pairs at one cosine are alike, so the planted ones stand for any.
    """
    pairs, tables = 500, 16
    random = np.random.default_rng([_SEED, size])
    one, other = _unit(random.standard_normal((pairs, size))), random.standard_normal((pairs, size))
    if size == 1 or cosine >= 1:
        return 8
    other = _unit(other - (other * one).sum(axis=1, keepdims=True) * one)
    a, b = cells(one, tables, functions, probes), cells(cosine * one + math.sqrt(1 - cosine * cosine) * other, tables, functions, probes)
    met = (a[:, :, :1] == b).any(2) | (a == b[:, :, :1]).any(2)
    share = met.mean()
    share = max(share - 2 * math.sqrt(share * (1 - share) / met.size), 1 / met.size)  # below by two standard errors
    return max(8, math.ceil(math.log(1 - recall) / math.log(1 - share)) if share < 1 else 8)


def _unit(values: np.ndarray) -> np.ndarray:
    rows = values.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _hashed(classes: DataFrame, tables: int, functions: int, probes: int) -> DataFrame:
    """The classes with all their cells, as bytes."""

    def run(batches):
        for (vectors,) in batches:
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            begin = np.concatenate(([0], np.cumsum(sizes)))
            made = [b""] * len(sizes)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                found = cells(_unit(flat[begin[rows][:, None] + np.arange(size)]), tables, functions, probes)
                for row, own in zip(rows.tolist(), found):
                    made[row] = own.tobytes()
            yield [pa.array(made, pa.binary())]

    return append_columns(classes, ["embedding"], "cells binary", run)


def _visits(hashed: DataFrame, tables: int, probes: int) -> DataFrame:
    """(cell, table, class, own) for every cell that a class visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = tables * (1 + probes)
            codes = np.frombuffer(b"".join(batch.column("cells").to_pylist()), dtype=np.uint64).reshape(-1, tables, 1 + probes)
            owner = np.repeat(batch.column("class").to_numpy(), each)
            table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), len(codes))
            own = np.tile(np.arange(1 + probes) == 0, len(codes) * tables)
            yield pa.RecordBatch.from_arrays([pa.array(codes.reshape(-1).view(np.int64)), pa.array(table), pa.array(owner), pa.array(own)], names=["cell", "table", "class", "own"])

    return hashed.select("class", "cells").mapInArrow(run, "cell bigint, table int, class bigint, own boolean")


def _links(members: DataFrame, tables: int, probes: int, least_cosine: float) -> DataFrame:
    """Links of the members of each cell's block pair: (class, n, root), sums and spanning edges only."""

    def met_before(i: np.ndarray, j: np.ndarray, codes: np.ndarray, table: int, cell: np.uint64, swap: np.ndarray) -> np.ndarray:
        before = np.zeros(len(i), dtype=bool)
        for t in range(table):
            a, b = codes[i, t], codes[j, t]
            before |= (a[:, :1] == b).any(1) | (a == b[:, :1]).any(1)
        # within one table the own cell of the smaller class comes first
        smaller, larger = np.where(swap, j, i), np.where(swap, i, j)
        home = codes[smaller, table, 0]
        return before | ((home != cell) & (codes[larger, table] == home[:, None]).any(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ["cell", "low", "high"]):
            bounds = run_bounds(rows, ["cell", "low", "high"])
            cell, table = rows["cell"].to_numpy().view(np.uint64), rows["table"].to_numpy()
            low, high, block = rows["low"].to_numpy(), rows["high"].to_numpy(), rows["block"].to_numpy()
            key, own, copies = rows["class"].to_numpy(), rows["own"].to_numpy(), rows["copies"].to_numpy()
            codes = np.frombuffer(b"".join(rows["cells"].to_pylist()), dtype=np.uint64).reshape(-1, tables, 1 + probes)
            vectors = rows["embedding"].combine_chunks()
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, begin = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))
            degree, root = np.zeros(len(key), dtype=np.int64), np.arange(len(key))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a < 2:
                    continue
                unit = _unit(flat[begin[a] : begin[b]].reshape(b - a, -1))
                # a rounding error wider than the comparison, then the exact comparison
                i, j = np.nonzero(np.triu(unit @ unit.T >= least_cosine - 1e-9, 1))
                keep = (own[a + i] | own[a + j]) & (key[a + i] != key[a + j])
                if low[a] != high[a]:
                    keep &= block[a + i] != block[a + j]
                i, j = i[keep], j[keep]
                keep = np.einsum("ij,ij->i", unit[i], unit[j]) >= least_cosine
                i, j = a + i[keep], a + j[keep]
                keep = ~met_before(i, j, codes, int(table[a]), cell[a], key[i] > key[j])
                i, j = i[keep], j[keep]
                np.add.at(degree, i, copies[j])
                np.add.at(degree, j, copies[i])
                while len(i):
                    least = np.minimum(root[i], root[j])
                    np.minimum.at(root, i, least)
                    np.minimum.at(root, j, least)
                    more = root[i] != root[j]
                    i, j = (i, j) if more.any() else (i[:0], j[:0])
            linked = np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays([pa.array(key[linked]), pa.array(degree[linked]), pa.array(key[root[linked]])], names=["class", "n", "root"])

    return members.mapInArrow(run, "class bigint, n bigint, root bigint")


def near_vectors(embeddings: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", least_cosine: float = 0.9, recall: float = 0.99, functions: int | None = None, tables: int | None = None, probes: int | None = None, block: int = 1024) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different
    lengths don't link. Rows with the same vector link with each other, whatever their ids. A component is named by its smallest
    vec_id; a null id is never the smallest unless all of its component are null. Extra columns are ignored; an empty table gives an empty result.

    A pair at ``least_cosine`` is found with the probability ``recall``, a nearer one more often. ``functions`` follows the number of
    distinct vectors, ``probes`` are all second and third axes (5 at least), and ``tables`` follow from both, unless they are given.
    """
    let_workers_import(embeddings.sparkSession)
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    finite = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", "embedding", F.when(finite, F.xxhash64("embedding")).alias("class"))
    classes = written(rows.filter("class IS NOT NULL").groupBy("class").agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    top = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = 2 * (1 << max(1, ((top[1] or 1) - 1).bit_length()))
    functions = functions or max(1, math.ceil(math.log(8 * max(top[0], 1)) / math.log(width)))
    probes = max(5, 2 * functions) if probes is None else probes
    tables = tables or tables_for(recall, least_cosine, max(top[1] or 1, 1), functions, probes)
    hashed = written(_hashed(classes, tables, functions, probes))
    visits = _visits(hashed, tables, probes).distinct()
    met = visits.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).filter("n > 1 AND any_own")
    met = visits.join(met.select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "cell")
    met = met.withColumn("block", F.pmod(F.xxhash64("class", "cell"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cell", "table", "class", "own", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    members = met.join(hashed.select("class", "embedding", "cells", "copies"), "class").repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    links = written(_links(members, tables, probes, least_cosine))
    degrees = links.groupBy("class").agg(F.sum("n").alias("n"))
    groups = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.select("class", "copies", "least").join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(smallest, "component").join(degrees, "class", "left").select("class", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "class").join(known, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
