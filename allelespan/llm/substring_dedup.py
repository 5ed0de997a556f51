"""Removal of word passages that occur more than once, by seeds and extension.

Seeds are winnowed: of the runs of ``seed`` words inside any window of ``window`` words the one with the smallest hash is
the window's anchor (the last one among equals), so two equal windows have equal anchors at the same place. Documents are
joined on their anchors. Around an anchor the match is extended both ways: each window that holds the anchor, from as far
left to as far right as it reaches, carries its hash, and the windows at which two occurrences of the anchor agree are
matches. Windows that overlap chain up to the maximal repeats, all at least ``window`` words long.

Each anchor occurrence crosses the shuffle once, with its windows, packed in numpy blocks. Two measures keep hot
passages apart. A window that repeats inside a task's chunk is settled there, and only one of its occurrences goes on for
the sake of others. Anchors that hold a share of all occurrences that would outweigh a partition are found in a first pass (their
number is bounded by that share) and are dealt out by anchor and window together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.llm.arrow_columns import append_columns, bucket_of, by_bucket, expand, free_name, joined, let_workers_import, pack, partitions, unpack
from allelespan.llm.linking import written
from allelespan.llm.word_hashes import SPACED, Words, cut_words, mix, run_hashes

#: anchors, place in ``keys`` (or _SILENT), first window's word, number of windows, window hashes, keys; settled spans: key, start, stop
_KINDS = ("u5", "u4", "u4", "u1", "u6", "u8", "u8", "u4", "u4")
_SILENT = 0xFFFFFFFF
#: An anchor is hot with this share of what a partition holds on average.
_HOT_SHARE = 0.02


def chosen_anchors(seeds: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` seeds, the index of the smallest; the last one among equals."""
    value, place, size = seeds, np.arange(len(seeds)), 1
    while size < span:
        step = min(size, span - size)
        later = value[step:] <= value[:-step]
        value, place = np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])
        size += step
    return place


def _windows(words: Words, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(word, text, hash, anchor's word, anchor) of every window inside a text, in order."""
    if len(words.hashes) < window:
        nothing = np.zeros(0, dtype=np.int64)
        return nothing, nothing, nothing.astype(np.uint64), nothing, nothing.astype(np.uint64)
    text = np.repeat(np.arange(words.texts), np.diff(words.first))
    at = np.arange(len(words.hashes) - window + 1)
    at = at[words.first[text[at] + 1] >= at + window]
    seeds = run_hashes(words.hashes, seed)
    chosen = chosen_anchors(seeds, window - seed + 1)[at]
    return at, text[at], run_hashes(words.hashes, window)[at], chosen, seeds[chosen]


def _occurrences(at: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Where each anchor occurrence's windows begin."""
    begins = np.ones(len(at), dtype=bool)
    begins[1:] = (at[1:] != at[:-1] + 1) | (chosen[1:] != chosen[:-1])
    return begins


def _hot_anchors(texts: DataFrame, window: int, seed: int, buckets: int) -> np.ndarray:
    """Anchors with at least the hot share of all occurrences; at most twice as many as the share allows."""
    share = _HOT_SHARE / buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in cut_words(batch.column(0), SPACED):
                at, _, _, chosen, anchor = _windows(words, window, seed)
                own, n = np.unique(anchor[_occurrences(at, chosen)], return_counts=True)
                heavy = n >= max(2, n.sum() * share / 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(own[heavy], np.uint64(0)).view(np.int64)), pa.array(np.append(n[heavy], n.sum()).astype(np.int64)), pa.array(np.append(np.zeros(heavy.sum(), dtype=bool), True))], names=["anchor", "n", "total"])

    counts = written(texts.select("text").mapInArrow(count, "anchor bigint, n bigint, total boolean").groupBy("anchor", "total").agg(F.sum("n").alias("n")))
    total = counts.filter("total").agg(F.sum("n")).first()[0] or 0
    rows = counts.filter((F.col("n") >= total * share / 2) & ~F.col("total")).select("anchor").collect()
    return np.sort(np.array([r.anchor for r in rows], dtype=np.int64).view(np.uint64))


def _merged(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by key and start, those of one key that touch joined."""
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    if not len(key):
        return key, start, stop
    rank = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) << 33
    reach = np.maximum.accumulate(stop + rank)
    begins = np.ones(len(key), dtype=bool)
    begins[1:] = start[1:] + rank[1:] > reach[:-1]
    first = np.flatnonzero(begins)
    return key[first], start[first], (reach - rank)[np.append(first[1:], len(key)) - 1]


def _deal(texts: DataFrame, window: int, seed: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """(bucket, block): anchor occurrences with their windows, and spans settled inside a chunk."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            for words in cut_words(batch.column("text"), SPACED):
                yield from chunk(words, keys[words.row : words.row + words.texts])

    def chunk(words: Words, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, text, hashes, chosen, anchor = _windows(words, window, seed)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        again, leads = np.zeros(len(at), dtype=bool), np.ones(len(at), dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        leads[order[1:][same]] = False
        _, unique_texts = np.unique(keys, return_index=True)
        own = again & np.isin(text, unique_texts)
        spans = _merged(keys[text[own]], at[own] - words.first[text[own]], at[own] - words.first[text[own]] + window)
        send = np.flatnonzero(leads)
        at, text, hashes, chosen, anchor, again = at[send], text[send], hashes[send], chosen[send], anchor[send], again[send]
        is_hot = np.isin(anchor, shared.value)
        anchor = np.where(is_hot, mix(anchor ^ hashes), anchor)
        begins = _occurrences(at, chosen) | is_hot
        begins[1:] |= again[1:] != again[:-1]
        unit = np.flatnonzero(begins)
        size = np.diff(np.append(unit, len(at)))
        label = mix(anchor[unit])
        rows, edges = by_bucket(bucket_of(label, buckets), buckets)
        span_rows, span_edges = by_bucket(bucket_of(mix(spans[0]), buckets), buckets)
        names, blocks = [], []
        for bucket in range(buckets):
            mine, told = rows[edges[bucket] : edges[bucket + 1]], span_rows[span_edges[bucket] : span_edges[bucket + 1]]
            if len(mine) or len(told):
                first = unit[mine]
                texts_here, place = np.unique(text[first], return_inverse=True)
                place = np.where(again[first], _SILENT, place)
                arrays = (label[mine], place, at[first] - words.first[text[first]], size[mine], hashes[expand(first, size[mine])], keys[texts_here], *(x[told] for x in spans))
                names.append(bucket)
                blocks.append(pack(_KINDS, arrays))
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    return texts.mapInArrow(run, "bucket int, block binary")


def _matched(blocks: DataFrame, window: int) -> DataFrame:
    """(key, starts, stops): the repeated spans of each text that a partition's anchors tell of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in range(8)]
        for batch in batches:
            for block in batch.column("block").to_pylist():
                label, place, start, size, hashes, keys, told, begin, stop = unpack(_KINDS, block)
                silent = place == _SILENT
                owner = np.append(keys, np.uint64(0))[np.where(silent, len(keys), place)]
                for held, new in zip(parts, (label, owner, silent, start, size, hashes, told, np.stack([begin, stop]))):
                    held.append(new)
        if not parts[0]:
            return
        label, owner, silent, start, size, hashes, told = (np.concatenate(p) for p in parts[:7])
        spans = np.concatenate(parts[7], axis=1)
        _, place, n = np.unique(label, return_inverse=True, return_counts=True)
        met = n[place] > 1  # the join on anchors; the others are alone
        windows = hashes[expand(np.cumsum(size, dtype=np.int64)[met] - size[met], size[met].astype(np.int64))]
        unit = np.repeat(np.flatnonzero(met), size[met])
        word = expand(start[met].astype(np.int64), size[met].astype(np.int64))
        match = mix(label[unit]) ^ windows
        order = np.argsort(match, kind="stable")
        same = match[order][1:] == match[order][:-1]
        again = np.zeros(len(match), dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        again &= ~silent[unit]
        key, begin, stop = _merged(np.concatenate([owner[unit[again]], told]), np.concatenate([word[again], spans[0]]), np.concatenate([word[again] + window, spans[1]]))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
        offsets = pa.array(np.append(first, len(key)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (begin, stop)]
        yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), *lists], names=["key", "starts", "stops"])

    return blocks.mapInArrow(run, "key bigint, starts array<int>, stops array<int>")


def remove_repeats(documents: DataFrame, *, text: str = "text", window: int = 35, seed: int = 12) -> DataFrame:
    """``documents`` with ``n_words``, ``repeat_spans`` (ranges [start, stop) of words) and ``kept_text``; columns of these names are replaced.

    Words are runs without ASCII white space. A word is removed if it lies in a window of ``window`` words whose sequence also
    starts anywhere else, in the same text or another; all occurrences go. The kept words are joined by one space.
    Null and empty texts have no words; repeated rows are copies of each other like any texts; an empty table stays empty.
    """
    spark = documents.sparkSession
    let_workers_import(spark)
    buckets = partitions(documents)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = documents.select(whole.alias("text"), F.xxhash64(whole).alias("key"))
    hot = _hot_anchors(texts, window, seed, buckets)
    blocks = _deal(texts, window, seed, buckets, hot).repartitionById(buckets, F.col("bucket"))
    found = _matched(blocks, window).groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("stops")).alias("stops"))
    key, starts, stops = (free_name(documents, n) for n in ("key", "starts", "stops"))
    found = written(found).select(F.col("key").alias(key), F.col("starts").alias(starts), F.col("stops").alias(stops))
    marked = documents.withColumn(key, F.xxhash64(whole)).join(found, key, "left")
    return append_columns(marked, [text, starts, stops], "n_words bigint, repeat_spans array<struct<start:int,stop:int>>, kept_text string", _removed).drop(key, starts, stops)


def _removed(batches):
    for texts, starts, stops in batches:
        counts, spans, kept = [], [], []
        for whole, begin, stop in zip(pc.fill_null(texts.cast(pa.string()), "").to_pylist(), starts.to_pylist(), stops.to_pylist()):
            words = whole.encode().split()
            merged: list[list[int]] = []
            for a, b in sorted(zip(begin or (), stop or ())):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            counts.append(len(words))
            spans.append([{"start": a, "stop": b} for a, b in merged])
            for a, b in reversed(merged):
                del words[a:b]
            kept.append(b" ".join(words).decode())
        yield [counts, spans, pa.array(kept, pa.string())]


def repeats_report(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its words, how many are removed, and the digest of what is kept."""
    done = remove_repeats(documents.select(doc_id, text), text=text)
    removed = F.aggregate("repeat_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return done.select(doc_id, "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
