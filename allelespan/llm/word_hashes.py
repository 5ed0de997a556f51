"""Words of whole texts as 64-bit hashes, cut from Arrow buffers with numpy.

Two words, or two runs of words, are taken as equal when their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once (one longer text is still taken whole); bounds the memory of a task.
CHUNK_BYTES = 2 << 20

_RANDOM = np.random.default_rng(20250101)
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all of them."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(count: int) -> np.ndarray:
    out = np.full(count, _STEP, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass(frozen=True)
class WordRule:
    """Which bytes belong to words, and the value of each byte (A-Z as a-z when folding)."""

    is_word: np.ndarray
    value: np.ndarray


def _rule(separators: list[int], fold: bool) -> WordRule:
    is_word = np.ones(256, dtype=bool)
    is_word[separators] = False
    value = _BYTE_VALUES.copy()
    if fold:
        value[65:91] = value[97:123]
    value[~is_word] = 0
    return WordRule(is_word, value)


_SPACES = [0x20, *range(0x09, 0x0E)]
#: Words are runs without ASCII white space.
SPACED = _rule(_SPACES, fold=False)
SPACED_FOLDED = _rule(_SPACES, fold=True)
#: Words are runs of ASCII letters and digits and everything beyond ASCII.
ALNUM_FOLDED = _rule([*range(0x00, 0x30), *range(0x3A, 0x61 - 0x20), *range(0x5B, 0x61), *range(0x7B, 0x80)], fold=True)
#: Words are runs of ASCII letters and everything beyond ASCII.
LETTERS_FOLDED = _rule([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], fold=True)


@dataclass
class Words:
    """The words of some consecutive texts: text ``i`` has the words ``first[i]:first[i + 1]``."""

    row: int  # the first text's place in the array
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1


def text_chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive texts; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def cut_words(texts: pa.Array, rule: WordRule, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of all texts, chunk by chunk; no word crosses from one text into the next."""
    for row, data, offsets in text_chunks(texts, chunk_bytes):
        inside = rule.is_word[data]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[filled] = False
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        if len(starts):
            begin = starts[0]
            place = np.arange(begin, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
            values = rule.value[data[begin:]] * powers(int(place.max()) + 1)[place]
            hashes = mix(np.add.reduceat(values, starts - begin) + (ends - starts).astype(np.uint64))
        else:
            hashes = np.zeros(0, dtype=np.uint64)
        yield Words(row, data, starts, ends, np.searchsorted(starts, offsets), hashes)


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` consecutive words, whatever text they belong to."""
    if len(hashes) < size:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
    for j in range(size):
        total *= _STEP
        total += hashes[j : j + len(total)]
    return mix(total + np.uint64(size))


def beginnings(words: Words, chosen: np.ndarray, size: int, rule: WordRule) -> np.ndarray:
    """Hashes of the first ``size`` bytes of the chosen words, none of which may be shorter."""
    places = (words.starts[chosen][:, None] + np.arange(size)).ravel()
    total = (rule.value[words.data[places]].reshape(len(chosen), size) * powers(size)).sum(axis=1, dtype=np.uint64)
    return mix(total * np.uint64(2) + np.uint64(size))


def shingle_runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text ``i`` has the shingles ``bounds[i]:bounds[i + 1]``, in text order.

    A text with fewer than ``size`` words, but not none, has one shingle of all its words.
    """
    counts = np.diff(words.first)
    full = run_hashes(words.hashes, size)
    per_text = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(per_text)))
    at = np.arange(bounds[-1]) + np.repeat(words.first[:-1] - bounds[:-1], per_text)
    out = np.zeros(len(at), dtype=np.uint64)
    whole = np.repeat(counts >= size, per_text)
    out[whole] = full[at[whole]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        out[bounds[i]] = run_hashes(words.hashes[words.first[i] : words.first[i + 1]], int(counts[i]))[0]
    return out, bounds
