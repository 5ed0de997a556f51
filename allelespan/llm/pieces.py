"""Vocabulary of a SentencePiece BPE model, read on the driver and shipped to the tasks.

Only models whose normalisation changes nothing but spaces are taken; others are refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import SparkSession

from allelespan.llm.arrow_columns import remembers

#: The symbol that stands for a space.
SPACE = "▁"
_BPE, _NORMAL, _UNKNOWN, _CONTROL, _BYTE = 2, 1, 2, 3, 6


class PieceVocabulary:
    """Ids and merge ranks of the pieces, and how a text falls into independent parts."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        rules, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != _BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only BPE models with identity normalisation and without user-defined pieces are supported")
        self.dummy_prefix = SPACE if rules.add_dummy_prefix else ""
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        level = {s: k for k, s in enumerate(sorted({p.score for p in proto.pieces if p.type == _NORMAL}, reverse=True))}
        #: Lower merges first; equal ranks merge from the left.
        self.ranks = {p.piece: level[p.score] for p in proto.pieces if p.type == _NORMAL}
        self.surfaces: list[bytes] = []
        for p in proto.pieces:
            if p.type == _BYTE:
                self.surfaces.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == _UNKNOWN:
                self.surfaces.append((proto.trainer_spec.unk_surface or " ⁇ ").encode())
            else:
                self.surfaces.append(b"" if p.type == _CONTROL else p.piece.replace(SPACE, " ").encode())
        self.starts_with_space = {i for piece, i in self.ids.items() if piece.startswith(SPACE)}
        parted = all(SPACE not in p.lstrip(SPACE) and "\n" not in p for p in self.ids)
        # no piece reaches over these borders, so the parts never merge with each other
        self._parts = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if parted else "(?s).+")

    def parts(self, text: str) -> list[str]:
        """The text with its spaces escaped, cut into parts that are tokenised independently."""
        return self._parts.findall(self.dummy_prefix + text.replace(" ", SPACE)) if text else []

    def fallback(self, symbol: str) -> list[int]:
        """Ids of a symbol that is no piece: its bytes, or the unknown id."""
        return [self.byte_ids[b] for b in symbol.encode()] if self.byte_ids else [self.unknown]


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> PieceVocabulary:
    return PieceVocabulary(model)


remembers(vocabulary.cache_clear)


def ship_model(spark: SparkSession, model_path: str):
    """The model file as a broadcast value: half a megabyte for 32,000 pieces."""
    with open(model_path, "rb") as file:
        model = file.read()
    vocabulary(model)  # an unsupported model is refused on the driver
    return spark.sparkContext.broadcast(model)


class Remembered(dict):
    """Results of a function of short texts; emptied when full, so a worker's memory stays bounded."""

    def __init__(self, function: Callable, limit: int = 500_000, longest: int = 64):
        super().__init__()
        self.function, self.limit, self.longest = function, limit, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value
