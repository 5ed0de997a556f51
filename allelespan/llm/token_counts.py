"""Token counts of a SentencePiece BPE model without tokens: symbols minus merges.

Every part of a text starts as a doubly linked list of its characters. A heap holds the adjacent pairs that are
pieces, lowest merge rank first and leftmost first among equals. Popping a pair that is still there joins its two
symbols and counts one merge. What is left over without being a piece counts as its UTF-8 bytes.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.llm.arrow_columns import append_columns
from allelespan.llm.pieces import PieceVocabulary, Remembered, ship_model, vocabulary


def count_part(vocab: PieceVocabulary, part: str) -> int:
    """Tokens of one independent part of a text."""
    ranks = vocab.ranks
    size = len(part)
    symbols = list(part)
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    heap = []
    for left in range(size - 1):
        rank = ranks.get(part[left : left + 2])
        if rank is not None:
            heap.append((rank, left, left + 1, 2))
    heapify(heap)
    merges = 0
    while heap:
        _, left, right, length = heappop(heap)
        a, b = symbols[left], symbols[right]
        if not a or not b or len(a) + len(b) != length:
            continue  # one of the two has merged otherwise meanwhile
        merges += 1
        merged = symbols[left] = a + b
        symbols[right] = ""
        follower = after[left] = after[right]
        if follower < size:
            before[follower] = left
            rank = ranks.get(merged + symbols[follower])
            if rank is not None:
                heappush(heap, (rank, left, follower, len(merged) + len(symbols[follower])))
        leader = before[left]
        if leader >= 0:
            rank = ranks.get(symbols[leader] + merged)
            if rank is not None:
                heappush(heap, (rank, leader, left, len(symbols[leader]) + len(merged)))
    strangers = sum(len(vocab.fallback(s)) - 1 for s in symbols if s and s not in ranks)
    return size - merges + strangers


@lru_cache(maxsize=2)
def _counter(model: bytes) -> tuple[PieceVocabulary, Remembered]:
    vocab = vocabulary(model)
    return vocab, Remembered(lambda part: count_part(vocab, part))


def count_tokens(documents: DataFrame, model_path: str, *, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``documents`` with the number of tokens of every whole text in ``into`` (an existing column of that name is replaced).

    Equal to the length of the library's encoding without begin or end ids. A null or empty text has no tokens.
    Rows stay as they are, repeated ones too; an empty table stays empty.
    """
    shipped = ship_model(documents.sparkSession, model_path)

    def count(batches):
        vocab, counts = _counter(shipped.value)
        for (texts,) in batches:
            yield [pa.array([sum(map(counts.__getitem__, vocab.parts(t))) for t in pc.fill_null(texts, "").to_pylist()], pa.int64())]

    return append_columns(documents, [text], f"`{into}` bigint", count)


def token_report(documents: DataFrame, model_path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row per document: bytes, tokens, and whether the tokens are over the limit."""
    sized = documents.select(doc_id, F.col(text).cast("string").alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    return count_tokens(sized, model_path).select(doc_id, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
