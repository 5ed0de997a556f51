"""Periodic runs: stretches of a text whose words repeat at least three times with one period.

Internal pattern matching over dyadic blocks. The words of a text are cut into aligned blocks of ``B`` = 8, 16, 32, ... words. A run of
period q contains, ahead of its last q words, a whole block with ``B <= q < 2B`` (or the smallest block), and that block occurs again q
words later. So every block asks for its occurrences in the window of 2B words after it: prefix doubling sorts the suffixes into a suffix array
in which the occurrences of a block are one range, and a wavelet matrix over that array answers "the next position after x in this
range". Occurrences at most B/2 apart form an arithmetic progression, whose difference is a period of the block; the whole
progression is stepped over at once, and the borders of the stretch that has this period give the only other
distances at which a longer period can lie. Each candidate distance is extended both ways by comparing prefix hashes.

Everything is numpy over the texts of a chunk, with no step per word. Only suffixes that share their first 8 words with another place of the same
text take part, so ordinary prose costs one sort of its word runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelespan.llm.arrow_columns import append_columns, free_name
from allelespan.llm.word_hashes import SPACED, Words, cut_words, mix, run_hashes

_PRIME = np.uint64((1 << 61) - 1)
_BASE = 0x1B2E0A7B3C4D5E6F % int(_PRIME)
_LOW30, _LOW31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)


def _folded(values: np.ndarray) -> np.ndarray:
    """64-bit values modulo the prime."""
    values = (values & _PRIME) + (values >> np.uint64(61))
    return np.where(values >= _PRIME, values - _PRIME, values)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from 31-bit halves so that nothing overflows."""
    a_high, a_low, b_high, b_low = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a_low * b_high + a_high * b_low
    return _folded(a_high * b_high * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + a_low * b_low)


class PrefixHashes:
    """Compares stretches of words of one length anywhere in the chunk."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.power = np.ones(n + 1, dtype=np.uint64)
        filled, factor = 1, _BASE
        while filled <= n:
            step = min(filled, n + 1 - filled)
            self.power[filled : filled + step] = _times(self.power[:step], np.uint64(factor))
            filled, factor = filled + step, factor * factor % int(_PRIME)
        terms = _times(_folded(hashes), self.power[:-1])
        low, high = (np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(part))) for part in (terms & _LOW31, terms >> np.uint64(31)))
        self.prefix = _folded(_folded(low) + _times(_folded(high), np.full(n + 1, 1 << 31, dtype=np.uint64)))

    def _same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        cut = lambda at: _folded(self.prefix[at + length] + _PRIME - self.prefix[at])
        return _times(cut(a), self.power[b - a]) == cut(b)

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and ``b`` on (a <= b) are the same, at most ``most``."""
        return self._longest(lambda length: self._same(a, b, length), most)

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and before ``b`` are the same, at most ``most``."""
        return self._longest(lambda length: self._same(a - length, b - length, length), most)

    @staticmethod
    def _longest(same, most: np.ndarray) -> np.ndarray:
        found = np.zeros(len(most), dtype=np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            tried = np.minimum(found + (1 << bit), most)
            fits = same(tried)
            found = np.where(fits, tried, found)
        return found


class WaveletMatrix:
    """Counts and order statistics of any range of an array, in one step per bit for any number of queries."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for bit in reversed(range(bits)):
            is_one = (values >> bit) & 1 == 1
            self.ones.append(np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(is_one))))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate((values[~is_one], values[is_one]))

    def _down(self, level: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before the ends of the ranges."""
        return self.ones[level][low], self.ones[level][high]

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each range are smaller than the bound."""
        total = np.zeros(len(low), dtype=np.int64)
        for level in range(self.bits):
            one_low, one_high = self._down(level, low, high)
            right = (bound >> (self.bits - 1 - level)) & 1 == 1
            total += np.where(right, (high - one_high) - (low - one_low), 0)
            low = np.where(right, self.zeros[level] + one_low, low - one_low)
            high = np.where(right, self.zeros[level] + one_high, high - one_high)
        return total

    def smallest(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The value at a place (from 0) of each range's ascending order."""
        value = np.zeros(len(low), dtype=np.int64)
        for level in range(self.bits):
            one_low, one_high = self._down(level, low, high)
            zeros = (high - one_high) - (low - one_low)
            right = place >= zeros
            value += right.astype(np.int64) << (self.bits - 1 - level)
            place = np.where(right, place - zeros, place)
            low = np.where(right, self.zeros[level] + one_low, low - one_low)
            high = np.where(right, self.zeros[level] + one_high, high - one_high)
        return value

    def successors(self, low: np.ndarray, high: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The smallest value greater than ``after`` in each range; -1 if there is none."""
        smaller = self.below(low, high, after + 1)
        found = smaller < high - low
        out = np.full(len(low), -1, dtype=np.int64)
        out[found] = self.smallest(low[found], high[found], smaller[found])
        return out


def _suffix_ranges(words: Words, owner: np.ndarray, smallest: int, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of the repeating places, and (place, size, low, high) of every aligned block that occurs again in its text.

    A group of suffixes that share their first B words is a range of the array already when B words are known, and stays it.
    """
    empty = np.zeros(0, dtype=np.int64)
    first, stop = words.first[owner], words.first[owner + 1]
    grams = run_hashes(words.hashes, smallest)
    place = np.flatnonzero(np.arange(len(grams)) + smallest <= stop[: len(grams)])
    key = mix(grams[place] ^ mix(owner[place].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]))
    sizes = np.diff(np.append(np.flatnonzero(new), len(key)))
    again = np.repeat(sizes > 1, sizes)
    suffixes, new = place[order[again]], new[again]
    if not len(suffixes):
        return empty, [empty] * 4
    group = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    rank = np.full(len(owner), -1, dtype=np.int64)
    rank[suffixes] = group
    open_ = np.arange(len(suffixes))  # entries of the array whose group has more than one place
    blocks, size = [], smallest
    while True:
        counts = np.bincount(group[open_], minlength=len(suffixes))
        here = suffixes[open_]
        aligned = open_[(here - first[here]) % size == 0]
        blocks.append((suffixes[aligned], np.full(len(aligned), size), group[aligned], group[aligned] + counts[group[aligned]]))
        if 2 * size > longest:
            break
        after = here + size
        # a unique continuation, or none inside the text, makes the place unique
        next_rank = np.where(after < stop[here], rank[np.minimum(after, len(rank) - 1)], -1)
        pair = group[open_] * (len(suffixes) + 1) + next_rank + 1
        order = np.argsort(pair, kind="stable")
        pair, here, unique = pair[order], here[order], next_rank[order] < 0
        suffixes[open_] = here
        new = np.concatenate(([True], pair[1:] != pair[:-1])) | unique
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(new)))
        group[open_] = np.repeat(open_[starts], sizes)
        several = np.repeat(sizes > 1, sizes)
        rank[here] = np.where(several, group[open_], -1)
        open_, size = open_[several], 2 * size
        if not len(open_):
            break
    return suffixes, [np.concatenate(part) for part in zip(*blocks)]


def _candidates(suffixes: np.ndarray, blocks: list[np.ndarray], known: PrefixHashes, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) pairs, among them the period of every run at one of its blocks."""
    place, size, low, high = blocks
    matrix = WaveletMatrix(suffixes, len(begin).bit_length())
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64),) * 2]
    current, going = place.copy(), np.arange(len(place))

    def stretch(at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the stretch around ``at`` with this period begins and ends."""
        return at - known.behind(at, at + period, at - begin[at]), at + period + known.ahead(at, at + period, stop[at] - at - period)

    while len(going):
        following = matrix.successors(low[going], high[going], current[going])
        inside = (following >= 0) & (following < place[going] + 2 * size[going])
        going, following = going[inside], following[inside]
        gap = following - current[going]
        found.append((place[going], following - place[going]))
        dense = 2 * gap <= size[going]
        row, period = going[dense], gap[dense]
        at = current[row]
        left, right = stretch(at, period)
        own_left, own_right = stretch(place[row], period)
        found += [(place[row], period), (place[row], left - own_left), (place[row], right - own_right)]
        current[going] = following
        current[row] = np.maximum(current[row], at + (right - size[row] - at) // np.maximum(period, 1) * period)
    at, distance = (np.concatenate(part) for part in zip(*found))
    usable = (distance > 0) & (at + distance < stop[at])
    pairs = np.unique(np.column_stack([at[usable], distance[usable]]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def runs_of(words: Words, shortest: int = 24, repeats: int = 3) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of the chunk's texts, by text, start and period; starts count from the text's first word.

    A run has ``length >= max(shortest, repeats * period)`` (``repeats`` is 3 or more) and its smallest period, and can't be longer on either side.
    """
    if repeats < 3 or shortest < 2:
        raise ValueError("runs repeat three times or more and have two words or more")
    nothing = np.zeros((0, 4), dtype=np.int64)
    counts = np.diff(words.first)
    if not len(counts) or counts.max() < shortest:
        return nothing
    owner = np.repeat(np.arange(words.texts), counts)
    smallest = 1 << ((shortest + 1) // 3).bit_length() - 1
    suffixes, blocks = _suffix_ranges(words, owner, smallest, max(smallest, int(counts.max()) // repeats))
    if not len(blocks[0]):
        return nothing
    known, begin, stop = PrefixHashes(words.hashes), words.first[owner], words.first[owner + 1]
    at, period = _candidates(suffixes, blocks, known, begin, stop)
    left = at - known.behind(at, at + period, at - begin[at])
    right = at + period + known.ahead(at, at + period, stop[at] - at - period)
    long = right - left >= np.maximum(shortest, repeats * period)
    left, right, period = left[long], right[long], period[long]
    # stretches of a multiple of the smallest period have the same borders
    order = np.lexsort((period, right, left))
    left, right, period = left[order], right[order], period[order]
    new = np.ones(len(left), dtype=bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    rows = np.column_stack([owner[left], left - begin[left], right - left, period])[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _kept_words(words: Words, text: int, runs: np.ndarray) -> str:
    """The text's words joined by one space, without those that a run holds after its first period."""
    a, b = int(words.first[text]), int(words.first[text + 1])
    if a == b:
        return ""
    parts = words.data[words.starts[a] : words.ends[b - 1]].tobytes().split()
    if len(runs):
        edge = np.zeros(len(parts) + 1, dtype=np.int64)
        np.add.at(edge, runs[:, 1] + runs[:, 3], 1)
        np.add.at(edge, runs[:, 1] + runs[:, 2], -1)
        parts = [parts[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(parts).decode()


RUNS_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def mark_runs(documents: DataFrame, *, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", shortest: int = 24, repeats: int = 3) -> DataFrame:
    """``documents`` with the list of runs of every whole text, and its words joined by one space with each run cut to one period.

    Words are runs without ASCII white space. A null or empty text has no runs and an empty collapsed text. Existing columns of these names are
    replaced. Rows stay as they are, repeated ones too; an empty table stays empty. Memory grows with the longest text only.
    """

    def compute(batches):
        for (texts,) in batches:
            offsets, rows, kept = [0], [np.zeros((0, 4), dtype=np.int64)], []
            for words in cut_words(texts, SPACED):
                found = runs_of(words, shortest, repeats)
                bounds = np.searchsorted(found[:, 0], np.arange(words.texts + 1))
                kept.extend(_kept_words(words, i, found[bounds[i] : bounds[i + 1]]) for i in range(words.texts))
                offsets.extend((offsets[-1] + bounds[1:]).tolist())
                rows.append(found)
            whole = np.concatenate(rows)
            structs = pa.StructArray.from_arrays([pa.array(whole[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
            yield [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), pa.array(kept, pa.string())]

    typed = documents.withColumn(text, F.col(text).cast("string"))
    return append_columns(typed, [text], f"`{runs}` {RUNS_TYPE}, `{collapsed}` string", compute)


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period, compared exactly; the first of equal ones in a list ordered by start and period."""
    stronger = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    return F.reduce(runs, F.get(runs, F.lit(0)), stronger)


def repeat_tails(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with repetition planted into a tenth of the texts, by their ids alone.

    With h = crc32 of the id as text and g = h // 10: where h ends in 0 and there are n > 0 words, each word i >= a becomes word
    ``a + (i - a) % p`` for ``a = g % n`` and ``p = 1 + (n - a) // (3 + g % 8)``. Other texts, and those of a null id, stay as they are.
    """
    hashed = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    named = {c: free_name(documents, c) for c in ("tail_words", "tail_from", "tail_period")}
    words, start, period = (F.col(c) for c in named.values())
    chosen = hashed % 10 == 0
    g = F.floor(hashed / 10)
    listed = documents.withColumn(named["tail_words"], F.when(chosen, F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    n = F.size(words)
    planted = chosen & (n > 0)
    placed = listed.withColumn(named["tail_from"], F.when(planted, g % n).cast("int"))
    placed = placed.withColumn(named["tail_period"], F.when(planted, 1 + F.floor((n - start) / (3 + g % 8))).cast("int"))
    copies = F.array_repeat(F.slice(words, start + 1, period), F.ceil((n - start) / period).cast("int"))
    repeated = F.concat(F.slice(words, F.lit(1), start), F.slice(F.flatten(copies), F.lit(1), n - start))
    return placed.withColumn(text, F.when(planted, F.array_join(repeated, " ")).otherwise(F.col(text))).drop(*named.values())


def runs_report(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: number of runs, its strongest run (nulls without one), digests of the list of runs and of the collapsed text."""
    marked = mark_runs(documents.select(doc_id, text), text=text).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return marked.select(
        doc_id,
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
