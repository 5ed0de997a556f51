"""Token ids in training order: fixed-stride binary shards that a trainer reads from any slot on.

Texts are tokenised once, with a byte-level BPE vocabulary, joined with an end mark after each, and cut into sequences of ``length``
ids, partition by partition. They go to the shared folder as compressed blocks, so that the blocks' row counts can number all
sequences 0 .. N-1 without gathering them. A keyed Feistel network over the next power of four, walked until the number is
below N again, permutes [0, N): each sequence's slot. Slots are dealt out by range, one range a shard, and the task of a
range writes each sequence at (slot - first slot) * stride, under a name of its own that becomes the shard's on completion.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.llm.arrow_columns import by_bucket, let_workers_import, pack, unpack
from allelespan.llm.word_hashes import mix
from allelespan.session import shared_folder

_ROUNDS = 6
#: Bytes of ids in a block before the shuffle, and of those that a task holds to deal them to shards.
_BLOCK_BYTES, _HELD_BYTES = 1 << 20, 32 << 20
#: Row groups of blocks, of which Spark's reader holds a whole one: their bytes, looked at after so many rows (100 otherwise).
_GROUPS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 8}
_DEALT = ("u8", "u4", "u2")


def slots(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """The keyed permutation of [0, count) at ``numbers``."""
    half = max(1, -(-(max(count, 2) - 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> shift, out[walking] & mask
        for turn in range(_ROUNDS):
            seed = np.uint64((key + turn * 0x9E3779B97F4A7C15) % 2**64)
            left, right = right, left ^ (mix(mix(right + seed) + seed) & mask)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= count]
    return out.astype(np.int64)


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=table, special_tokens={}), len(table)


class _Packer:
    """Cuts the joined ids of one partition's texts into sequences."""

    def __init__(self, ranks: bytes, pattern: str, length: int):
        self.encoding, self.end = _encoding(ranks, pattern)
        self.length, self.rest = length, np.zeros(0, dtype=np.uint16)

    def sequences(self, texts: pa.Array) -> np.ndarray:
        """Full sequences, one a row; the rest waits for the next texts. Null and empty texts give nothing."""
        ids = array("H", self.rest.tobytes())
        for text in pc.fill_null(texts, "").to_pylist():
            if text:
                ids.fromlist(self.encoding.encode_ordinary(text))
                ids.append(self.end)
        ids = np.frombuffer(ids, dtype=np.uint16)
        full = len(ids) // self.length
        self.rest = ids[full * self.length :]
        return ids[: full * self.length].reshape(full, self.length)

    def last(self) -> tuple[np.ndarray, int]:
        """The rest, filled up with end marks, and how many ids it really has."""
        if not len(self.rest):
            return np.zeros((0, self.length), dtype=np.uint16), 0
        row = np.full((1, self.length), self.end, dtype=np.uint16)
        row[0, : len(self.rest)] = self.rest
        return row, len(self.rest)


def _packed(batches: Iterator[pa.RecordBatch], packer: _Packer, rows: int = 512) -> Iterator[tuple[np.ndarray, int]]:
    """(sequences, ids in the last of them)."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield packer.sequences(batch.column(0).slice(start, rows)), packer.length
    yield packer.last()


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=5)


def write_shards(documents: DataFrame, folder: str, ranks_path: str, pattern: str, *, key: int = 1, text: str = "text", length: int = 512, per_shard: int = 16_384) -> DataFrame:
    """Write the ids of every whole text to ``folder`` and return one row per sequence, written to ``folder`` too.

    Columns: slot, shard, byte_offset (inside ``shard-<number>.bin``), n_tokens (ids before the filling) and crc32 of the sequence's
    bytes. Ids are unsigned 16-bit little-endian; the end mark, also used for filling, is the first id after the vocabulary.
    Null and empty texts give no ids, repeated rows are written as often as they occur, and an empty table gives no shard.
    ``folder`` must be visible to all executors. Other columns are ignored.
    """
    spark = documents.sparkSession
    let_workers_import(spark)
    with open(ranks_path, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())  # the vocabulary, below a megabyte
    texts = documents.select(F.col(text).cast("string").alias("text"))
    stride = 2 * length
    most = max(1, _BLOCK_BYTES // stride)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, zstd = TaskContext.get().partitionId(), 0, _zstd()
        for rows, real in _packed(batches, _Packer(ranks.value, pattern, length)):
            for start in range(0, len(rows), most):
                block = rows[start : start + most]
                values = [part, at, len(block), real, zstd.compress(block.astype("<u2", copy=False).tobytes(), asbytes=True)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["part", "at", "n", "real", "block"])
                at += len(block)

    path = shared_folder(spark)
    schema = "part int, at bigint, n int, real int, block binary"
    texts.mapInArrow(encode, schema).write.options(**_GROUPS).parquet(path)
    encoded = spark.read.schema(schema).parquet(path)
    counted = sorted(encoded.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row per partition of the input
    total = sum(r.n for r in counted)
    starts = spark.sparkContext.broadcast(dict(zip([r.part for r in counted], np.cumsum([0, *[r.n for r in counted]]).tolist())))
    shards = max(1, -(-total // per_shard))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = _zstd()

        def dealt(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            slot, real, ids = (np.concatenate(x) for x in zip(*held))
            order, bounds = by_bucket(slot // per_shard, shards)
            for shard in np.flatnonzero(np.diff(bounds)).tolist():
                own = order[bounds[shard] : bounds[shard + 1]]
                block = pack(_DEALT, [slot[own], real[own], ids[own].reshape(-1)])
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(block)], pa.int64()), pa.array([zstd.compress(block, asbytes=True)], pa.binary())], names=["shard", "size", "block"])

        held, size = [], 0
        for batch in batches:
            for part, at, n, real, block in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "n", "real", "block"))):
                first = starts.value[part] + at
                ids = np.frombuffer(zstd.decompress(block, n * stride, asbytes=True), dtype="<u2").reshape(n, length)
                held.append((slots(np.arange(first, first + n), total, key), np.full(n, real, dtype=np.uint32), ids))
                size += n * stride
                if size >= _HELD_BYTES:
                    yield from dealt(held)
                    held, size = [], 0
        if held:
            yield from dealt(held)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, found, zstd = None, None, [], _zstd()
        for batch in batches:
            for to, size, block in zip(*(batch.column(c).to_pylist() for c in ("shard", "size", "block"))):
                if held is None:
                    shard, held = to, np.zeros((min(total, (to + 1) * per_shard) - to * per_shard, length), dtype="<u2")
                slot, real, ids = unpack(_DEALT, zstd.decompress(block, size, asbytes=True))
                place = slot.astype(np.int64) - shard * per_shard
                held[place] = ids.reshape(-1, length)
                found.append((place, real))
        if held is not None:
            place, real = (np.concatenate(x) for x in zip(*found))
            store, path = fs.FileSystem.from_uri(folder)
            store.create_dir(path, recursive=True)
            own = f"{path}/_{shard:06d}-{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(held)
            store.move(own, f"{path}/shard-{shard:06d}.bin")
            columns = [place + shard * per_shard, np.full(len(place), shard), place * stride, real, [zlib.crc32(held[p]) for p in place.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["slot", "shard", "byte_offset", "n_tokens", "crc32"])

    numbered = encoded.mapInArrow(deal, "shard int, size bigint, block binary")
    manifest = numbered.repartitionById(shards, F.col("shard")).mapInArrow(write, "slot bigint, shard int, byte_offset bigint, n_tokens int, crc32 bigint")
    path = f"{folder}/manifest"
    manifest.write.parquet(path)
    return spark.read.schema(manifest.schema).parquet(path)


def read_from(folder: str, slot: int, length: int, per_shard: int) -> Iterator[np.ndarray]:
    """The sequences from ``slot`` on, in training order, as a trainer resumes."""
    store, path = fs.FileSystem.from_uri(folder)
    while True:
        shard, place = divmod(slot, per_shard)
        name = f"{path}/shard-{shard:06d}.bin"
        if store.get_file_info(name).type == fs.FileType.NotFound:
            return
        with store.open_input_file(name) as file:
            file.seek(2 * length * place)
            while ids := file.read(2 * length):
                yield np.frombuffer(ids, dtype="<u2")
        slot = (shard + 1) * per_shard
