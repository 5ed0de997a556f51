"""Add columns computed from Arrow batches, and move numpy arrays through shuffles as binary blocks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType


#: Rows that are computed at once, whatever the size of Spark's batches; bounds what a Python worker holds.
_SLICE_ROWS = 512


#: Bytes of one Arrow batch on its way to a Python worker; both sides hold a few of them.
_BATCH_BYTES = "8m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver did, unless their own path has been set, and get small batches, unless the session says otherwise."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, _BATCH_BYTES)


#: In a Python worker: the module whose function ran last, and what empties the memories that modules keep between tasks.
_last_owner = ""
_memories: list[Callable[[], None]] = []


def remembers(clear: Callable[[], None]) -> None:
    """Register what empties a module's memory; called when a worker turns to another module's function."""
    _memories.append(clear)


def begin_task(owner: str) -> None:
    global _last_owner
    if _last_owner != owner:
        for clear in _memories:
            clear()
        _last_owner = owner


def end_task() -> None:
    """Give unused memory back to the system, as Spark goes on to use the worker."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[..., Iterator], owner: str | None = None) -> Callable[..., Iterator]:
    """``run`` for ``mapInArrow``, so that a reused worker holds nothing of the stages before."""
    owner = owner or run.__module__

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(owner)
        try:
            yield from run(batches)
        finally:
            end_task()

    return wrapped


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def append_columns(df: DataFrame, inputs: Sequence[str], added: str, compute: Callable[..., Iterator[list]]) -> DataFrame:
    """``df`` with the columns of the schema text ``added``, one map over its partitions and no shuffle.

    ``compute`` gets an iterator of lists of Arrow arrays, one for each name in ``inputs``, and yields for
    each of them the list of added arrays. A column of ``df`` whose name is added (in any case) is replaced.
    """
    let_workers_import(df.sparkSession)
    fields = StructType.fromDDL(added).fields
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    places, wanted = list(range(len(kept))), [df.schema.fieldNames().index(c) for c in inputs]
    keeps = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in names]
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def arrays():
            for batch in batches:
                for start in range(0, batch.num_rows, _SLICE_ROWS):
                    part = batch.slice(start, _SLICE_ROWS)
                    held.append(part)
                    yield [part.column(i) for i in wanted]

        for made in compute(arrays()):
            part = held.pop()
            columns = [part.column(i) for i in keeps] + [pa.array(m, t) if not isinstance(m, pa.Array) else m.cast(t) for m, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays(columns, names=[kept[i].name for i in places] + [f.name for f in fields])

    return df.mapInArrow(lean(run, compute.__module__), StructType([*[StructField(f.name, f.dataType, True) for f in kept], *fields]))


#: Widths of the numbers that blocks can hold, by code.
_WIDTHS = {"u1": 1, "u2": 2, "u4": 4, "u5": 5, "u6": 6, "u8": 8, "f8": 8}


def pack(kinds: Sequence[str], arrays: Sequence[np.ndarray]) -> bytes:
    """Arrays as one binary value; ``u5`` and ``u6`` keep the low 40 and 48 bits of 64-bit values."""
    parts = [np.array([len(a) for a in arrays], dtype=np.uint32).tobytes()]
    for kind, values in zip(kinds, arrays):
        if kind in ("u5", "u6"):
            parts.append(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, : _WIDTHS[kind]].tobytes())
        else:
            parts.append(np.ascontiguousarray(values).astype(kind, copy=False).tobytes())
    return b"".join(parts)


def unpack(kinds: Sequence[str], block: bytes) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(block, dtype=np.uint32, count=len(kinds)), 4 * len(kinds), []
    for kind, size in zip(kinds, sizes.tolist()):
        part = np.frombuffer(block, dtype=np.uint8, count=size * _WIDTHS[kind], offset=at)
        at += len(part)
        if kind in ("u5", "u6"):
            wide = np.zeros((size, 8), dtype=np.uint8)
            wide[:, : _WIDTHS[kind]] = part.reshape(-1, _WIDTHS[kind])
            out.append(wide.reshape(-1).view("<u8"))
        else:
            out.append(np.frombuffer(part.tobytes(), dtype=kind))
    return out


def partitions(df: DataFrame) -> int:
    """Partitions that blocks are dealt to: the session's number of shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for ``counts[0]`` numbers, then the same for each next pair."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def joined(parts: Sequence[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit hash, from its high bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def by_bucket(buckets: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): rows in stable order of their bucket, and where each bucket begins."""
    small = buckets.astype(np.uint16) if count <= 1 << 16 else buckets.astype(np.uint32)
    order = np.argsort(small, kind="stable")
    return order, np.searchsorted(small[order], np.arange(count + 1))
