"""Benchmark decontamination: a prefix-filtered join of item windows with the running words of documents.

An item is cut into windows of ``window`` consecutive words (a shorter item is one window), and a window into
shingles of ``shingle`` words. A document contains a window only if it contains every one of its shingles, so
the prefix that has to be joined is the single shingle that is rarest in the corpus. Where that shingle occurs,
the place of the shingle in the window and the window's length say where the window would have to lie; it is
verified there word for word (by 64-bit hashes).

Rarity is counted over all documents. Documents are never shuffled: the lookup of the windows goes to
every task in blocks of at most ``block_windows`` windows, and larger benchmarks take several blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.llm.arrow_columns import append_columns, lean
from allelespan.llm.word_hashes import ALNUM_FOLDED, Words, cut_words, run_hashes

#: Bits of the filter that most shingles of documents are turned away by.
_FILTER_BITS = 22


@dataclass
class _Shingles:
    """Wanted shingles of one length, sorted, with a bit filter before the search."""

    length: int
    values: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, length: int, values: np.ndarray) -> _Shingles:
        values = np.unique(values)
        bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        bits[(values >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return cls(length, values, bits)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word index, index of the wanted shingle) of every occurrence that stays inside its text."""
        runs = run_hashes(words.hashes, self.length)
        at = np.flatnonzero(self.filter[(runs >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.values, runs[at]), max(len(self.values) - 1, 0))
        keep = self.values[which] == runs[at] if len(self.values) else np.zeros(len(at), dtype=bool)
        at, which = at[keep], which[keep]
        inside = words.first[np.searchsorted(words.first, at, side="right")] >= at + self.length
        return at[inside], which[inside]


def item_windows(benchmark: DataFrame, window: int, shingle: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, length, hash, shingle_length, shingles) of the distinct windows of each item.

    A null text has no words and no window; a null id is called 'null'.
    """

    def cut(batches):
        for items, texts in batches:
            rows = [[] for _ in range(len(texts))]
            for words in cut_words(texts, ALNUM_FOLDED):
                for i in range(words.texts):
                    own = words.hashes[words.first[i] : words.first[i + 1]]
                    size = min(window, len(own))
                    if size:
                        part = min(shingle, size)
                        hashes, parts = run_hashes(own, size), run_hashes(own, part)
                        for k in np.unique(hashes, return_index=True)[1]:
                            rows[words.row + i].append({"length": size, "hash": int(hashes[k].view(np.int64)), "part": part, "shingles": parts[k : k + size - part + 1].view(np.int64).tolist()})
            yield [rows]

    named = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("text"))
    cut_rows = append_columns(named, ["item", "text"], "windows array<struct<length:int,hash:bigint,part:int,shingles:array<bigint>>>", cut)
    return cut_rows.select("item", F.inline("windows")).distinct()


def _rarity(documents: DataFrame, text: str, wanted: list[_Shingles]) -> list[np.ndarray]:
    """In how many documents each wanted shingle occurs, counted over the whole corpus."""
    shared = documents.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(w.values), dtype=np.int64) for w in shared.value]
        for batch in batches:
            for words in cut_words(batch.column(0), ALNUM_FOLDED):
                for total, one in zip(totals, shared.value):
                    at, which = one.find(words)
                    texts = np.searchsorted(words.first, at, side="right")
                    pairs = np.unique(texts * np.int64(len(total) + 1) + which)
                    total += np.bincount(pairs % (len(total) + 1), minlength=len(total))[: len(total)]
        for part, total in enumerate(totals):
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), part), pa.int32()), pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["part", "place", "n"])

    counts = documents.select(F.col(text).cast("string")).mapInArrow(lean(count), "part int, place bigint, n bigint").groupBy("part", "place").agg(F.sum("n").alias("n"))
    totals = [np.zeros(len(w.values), dtype=np.int64) for w in wanted]
    for part, place, n in counts.collect():  # at most one row for each wanted shingle of the block
        totals[part][place] = n
    return totals


@dataclass
class _Lookup:
    """Windows of a block by their rarest shingle, for one shingle length."""

    shingles: _Shingles
    begin: np.ndarray  # windows of shingle k: begin[k]:begin[k + 1]
    offset: np.ndarray  # place of the shingle in the window
    length: np.ndarray
    hash: np.ndarray
    items: list[list[str]]


def _lookups(rows: list, wanted: list[_Shingles], totals: list[np.ndarray]) -> list[_Lookup]:
    out = []
    for one, total in zip(wanted, totals):
        windows: dict[tuple[int, int], tuple[int, int, list[str]]] = {}
        for row in rows:
            if row.part == one.length:
                key = (row.length, row.hash)
                if key not in windows:
                    parts = np.array(row.shingles, dtype=np.int64).view(np.uint64)
                    seen = total[np.searchsorted(one.values, parts)]
                    place = min(range(len(parts)), key=lambda k: (seen[k], parts[k]))
                    windows[key] = (int(parts[place]), place, [])
                windows[key][2].append(row.item)
        ordered = sorted(windows.items(), key=lambda w: (w[1][0], w[0]))
        prefix = np.array([w[1][0] for w in ordered], dtype=np.uint64)
        shingles = _Shingles.of(one.length, prefix)
        out.append(
            _Lookup(
                shingles,
                np.searchsorted(prefix, np.append(shingles.values, np.uint64(2**64 - 1)), side="left") if len(prefix) else np.zeros(1, dtype=np.int64),
                np.array([w[1][1] for w in ordered], dtype=np.int64),
                np.array([w[0][0] for w in ordered], dtype=np.int64),
                np.array([w[0][1] for w in ordered], dtype=np.int64).view(np.uint64),
                [sorted(set(w[1][2])) for w in ordered],
            )
        )
        if len(prefix):
            out[-1].begin[-1] = len(prefix)
    return out


def _occurrences(words: Words, lookup: _Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every verified occurrence."""
    at, which = lookup.shingles.find(words)
    if not len(at):
        return at, which
    repeat = lookup.begin[which + 1] - lookup.begin[which]
    window = np.repeat(lookup.begin[which], repeat) + np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    first = np.repeat(at, repeat) - lookup.offset[window]
    length = lookup.length[window]
    text = np.searchsorted(words.first, np.repeat(at, repeat), side="right") - 1
    fits = (first >= words.first[text]) & (first + length <= words.first[text + 1])
    first, window, length = first[fits], window[fits], length[fits]
    same = np.zeros(len(first), dtype=bool)
    for size in np.unique(length):
        own = np.flatnonzero(length == size)
        if len(own):
            runs = words.hashes[(first[own][:, None] + np.arange(size))]
            total = np.array([run_hashes(run, int(size))[0] for run in runs], dtype=np.uint64)
            same[own] = total == lookup.hash[window[own]]
    return first[same], window[same]


def contamination(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, shingle: int = 5, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_windows: int = 1_000_000) -> DataFrame:
    """``documents`` with ``n_words``, ``hit_spans`` and ``hit_items`` (existing columns of these names are replaced).

    ``hit_spans`` are disjoint, ordered ranges [start, stop) of words covered by occurrences of item windows;
    ``hit_items`` are the sorted ids of the items concerned, as text. Words are lower-cased runs of ASCII letters,
    digits and anything beyond ASCII. Null and empty texts have no words and no hits; repeated rows and repeated
    items each give their own result; an empty benchmark gives no hits. Rows and all other columns stay as they are.
    """
    windows = item_windows(benchmark, window, shingle, item_id, item_text)
    blocks = max(1, -(-windows.count() // block_windows))
    out = append_columns(documents.withColumn("hit_spans", F.lit(None).cast("array<struct<start:int,stop:int>>")).withColumn("hit_items", F.lit(None).cast("array<string>")), [text], "n_words bigint", _count_words)
    for block in range(blocks):
        rows = windows.filter(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == block).collect()  # about block_windows rows
        lengths = sorted({r.part for r in rows})
        wanted = [_Shingles.of(n, np.array([s for r in rows if r.part == n for s in r.shingles], dtype=np.int64).view(np.uint64)) for n in lengths]
        lookups = _lookups(rows, wanted, _rarity(documents, text, wanted)) if wanted else []
        out = _with_hits(out, text, lookups)
    return out


def _count_words(batches):
    for (texts,) in batches:
        yield [np.concatenate([np.diff(w.first) for w in cut_words(texts, ALNUM_FOLDED)] or [np.zeros(0, dtype=np.int64)])]


def _with_hits(documents: DataFrame, text: str, lookups: list[_Lookup]) -> DataFrame:
    """Add the hits of one block of windows to those found so far."""
    shared = documents.sparkSession.sparkContext.broadcast(lookups)

    def mark(batches):
        for texts, spans, items in batches:
            spans, items = spans.to_pylist(), items.to_pylist()
            for words in cut_words(texts, ALNUM_FOLDED):
                found = [(lookup, *_occurrences(words, lookup)) for lookup in shared.value]
                hits: dict[int, list] = {}
                for lookup, first, window in found:
                    owner = np.searchsorted(words.first, first, side="right") - 1
                    for i, f, w in zip(owner.tolist(), first.tolist(), window.tolist()):
                        hits.setdefault(i, []).append((f - int(words.first[i]), int(lookup.length[w]), lookup.items[w]))
                for i, own in hits.items():
                    row = words.row + i
                    ranges = sorted([(s["start"], s["stop"]) for s in spans[row] or []] + [(f, f + n) for f, n, _ in own])
                    merged = [list(ranges[0])]
                    for start, stop in ranges[1:]:
                        if start <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], stop)
                        else:
                            merged.append([start, stop])
                    spans[row] = [{"start": a, "stop": b} for a, b in merged]
                    items[row] = sorted({*(items[row] or []), *(x for _, _, names in own for x in names)})
            yield [[s or [] for s in spans], [x or [] for x in items]]

    return append_columns(documents, [text, "hit_spans", "hit_items"], "hit_spans array<struct<start:int,stop:int>>, hit_items array<string>", mark)


def contamination_report(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its words, hit words, the items found (count and digest) and whether there are any."""
    found = contamination(documents.select(doc_id, text), benchmark, text=text)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        doc_id,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
