"""SentencePiece BPE encoding by a table of prefixes, and decoding.

The encoding of every prefix of a text has one last token, and the table holds it for each prefix. A token that an
automaton over all pieces finds ending at a place is that last token exactly if it stands beside the last
token of the prefix before it without merging with it. That pair test runs the merges of the two tokens' characters,
which takes a few steps, and is remembered by pair. The ids are read back from the end of the table. The work is linear in the
text, whatever its length, and nothing is merged in the text itself.
"""

from __future__ import annotations

import codecs
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.llm.arrow_columns import append_columns, remembers
from allelespan.llm.pieces import PieceVocabulary, Remembered, ship_model, vocabulary

codecs.register_error("one-mark-per-byte", lambda e: ("�" * (e.end - e.start), e.end))


class PrefixEncoder:
    """Encodes independent parts of texts."""

    def __init__(self, vocab: PieceVocabulary, remembered_pairs: int = 400_000):
        self.vocab, self.limit = vocab, remembered_pairs
        #: by number of the left token times ``self.base`` plus that of the right one; such a key takes a third of a pair of texts
        self.pairs: dict[int, bool] = {}
        self.base = max(vocab.ids.values(), default=0) + 1
        self.texts = {number: piece for piece, number in vocab.ids.items()}
        self.lengths = [len(self.texts.get(number, "")) for number in range(self.base)]
        self.automaton = ahocorasick.Automaton()
        for piece, number in vocab.ids.items():
            if len(piece) == 1 or self._merges_to(piece, len(piece)) == [piece]:  # others no encoding can hold
                self.automaton.add_word(piece, number)
        self.automaton.make_automaton()

    def _merges_to(self, text: str, border: int) -> list[str] | None:
        """The merged symbols of a short text; None as soon as a merge crosses the border."""
        ranks, never, symbols, before = self.vocab.ranks, len(self.vocab.ranks), list(text), border
        found = [ranks.get(a + b, never) for a, b in zip(symbols, symbols[1:])]  # of each symbol with the next
        while found and (best := min(found)) < never:
            place = found.index(best)
            if place == before - 1:
                return None
            if place < before:
                before -= 1  # symbols left of the border
            merged = symbols[place] = symbols[place] + symbols.pop(place + 1)
            del found[place]
            if place:
                found[place - 1] = ranks.get(symbols[place - 1] + merged, never)
            if place < len(found):
                found[place] = ranks.get(merged + symbols[place + 1], never)
        return symbols

    def _apart(self, left: str, right: str) -> bool:
        """Whether two tokens side by side are their own encoding."""
        return self._merges_to(left + right, len(left)) == [left, right]

    def compatible(self, left: int, right: int) -> bool:
        """``_apart`` of two pieces by their numbers, remembered."""
        key = left * self.base + right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(self.texts[left], self.texts[right])
        return found

    def encode(self, part: str) -> list[int]:
        size, known, base, lengths = len(part), self.pairs.get, self.base, self.lengths
        last = [-1] * (size + 1)  # number of each prefix's last token; -1: none yet, -2: a character that is no piece
        filled = 0  # prefixes up to this length have their last token
        for place, number in self.automaton.iter(part):
            while filled < place:
                filled += 1
                if last[filled] == -1:
                    last[filled] = -2
            end = place + 1
            if last[end] == -1:
                begin = end - lengths[number]
                if begin == 0:
                    last[end] = number
                    continue
                left = last[begin]
                if left < 0:
                    fits = self._apart(part[begin - 1], part[begin:end])
                else:
                    fits = known(left * base + number)
                    if fits is None:
                        fits = self.compatible(left, number)
                if fits:
                    last[end] = number
        ids: list[int] = []
        end = size
        while end:
            number = last[end]
            if number < 0:
                end -= 1
                ids.extend(reversed(self.vocab.fallback(part[end])))
            else:
                ids.append(number)
                end -= lengths[number]
        ids.reverse()
        return ids


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> tuple[PieceVocabulary, Remembered]:
    vocab = vocabulary(model)
    encoder = PrefixEncoder(vocab)
    return vocab, Remembered(lambda part: array("i", encoder.encode(part)).tobytes(), 250_000)


remembers(_encoder.cache_clear)


def _id_lists(texts: pa.Array, model: bytes) -> pa.ListArray:
    vocab, known = _encoder(model)
    rows = [b"".join(map(known.__getitem__, vocab.parts(t))) for t in pc.fill_null(texts, "").to_pylist()]
    offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))


def _texts(lists: pa.ListArray, model: bytes) -> pa.Array:
    vocab = vocabulary(model)
    values = pc.fill_null(lists.flatten(), vocab.unknown).to_numpy(zero_copy_only=False)
    values = np.where((values >= 0) & (values < len(vocab.surfaces)), values, vocab.unknown).tolist()
    bounds = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).tolist()

    def text_of(row: list[int]) -> str:
        raw = b"".join(map(vocab.surfaces.__getitem__, row))
        if vocab.dummy_prefix and row and row[0] in vocab.starts_with_space:
            raw = raw[1:]
        return raw.decode("utf-8", "one-mark-per-byte")

    return pa.array([text_of(values[a:b]) for a, b in zip(bounds, bounds[1:])], pa.string())


def encode(documents: DataFrame, model_path: str, *, text: str = "text", into: str = "ids") -> DataFrame:
    """``documents`` with the ids of every whole text in ``into`` (an existing column of that name is replaced).

    The library's ids without begin or end. A null or empty text has an empty list. Rows stay as they are,
    repeated ones too; an empty table stays empty.
    """
    model = ship_model(documents.sparkSession, model_path)
    return append_columns(documents, [text], f"`{into}` array<int>", lambda batches: ([_id_lists(texts, model.value)] for (texts,) in batches))


def decode(encoded: DataFrame, model_path: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``into`` (an existing column of that name is replaced).

    Bytes that are no UTF-8 become one replacement mark each. A null list is an empty text; a null id, or one that the
    model doesn't have, is read as the unknown id.
    """
    model = ship_model(encoded.sparkSession, model_path)
    return append_columns(encoded, [ids], f"`{into}` string", lambda batches: ([_texts(lists, model.value)] for (lists,) in batches))


def round_trip(documents: DataFrame, model_path: str, *, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` in one pass, so that a task needs one Python worker only."""
    model = ship_model(documents.sparkSession, model_path)

    def both(batches):
        for (texts,) in batches:
            lists = _id_lists(texts, model.value)
            yield [lists, _texts(lists, model.value)]

    return append_columns(documents, [text], f"`{ids}` array<int>, `{decoded}` string", both)


def codec_report(documents: DataFrame, model_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: number and digest of its ids, and the digest of the text they decode to."""
    coded = round_trip(documents.select(doc_id, F.col(text).cast("string").alias("text")), model_path)
    return coded.select(
        doc_id,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
