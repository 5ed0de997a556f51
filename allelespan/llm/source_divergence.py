"""Source divergence audit: how far the word use of each source of a language lies from its other sources and from the language.

Which terms count is found by iceberg prefix refinement. A pass over the documents counts, per language, the documents that hold each term prefix of
4 bytes; the next one extends only the prefixes that enough documents hold to 16 bytes, then 64, and so on, until no open prefix is left. A
term that ends within a prefix is settled there. Passes count by 64-bit hashes and hand the surviving ones on as a bitmap of fixed size, which may let a
rare term through but never loses a kept one; the last pass counts what came through by the terms themselves, exactly.

Sums over all pairs of sources never list the terms that both lack: a pair's value is that of a term in neither, times the number of kept terms, plus
corrections from each source's histogram of probabilities and from the terms that both hold. Those are added up inside each task. All arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelespan.llm.arrow_columns import expand, lean, let_workers_import
from allelespan.llm.linking import written
from allelespan.llm.word_hashes import LETTERS_FOLDED, Words, beginnings, cut_words, mix
from allelespan.operators.sizing import top_per_group
from allelespan.session import local_table

#: Parts of one whole in a probability.
UNITS = 1_000_000_000
#: Counts up to this may be multiplied by ``UNITS`` in 64 bits.
_SMALL_COUNT = 9_000_000_000
_FIRST_SIZE, _GROWTH = 4, 4
_ROWS = 512
_PAIRS_AT_ONCE = 1 << 20
#: Rows that a task gathers before it hands on their sums; bounds what a Python worker holds.
_HELD_ROWS = 1 << 20
_SENT_ROWS = 1 << 16


def _documents(documents: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    names = {"lang": lang, "source": source, "text": text}
    return documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in names.items()])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Small slices of the batches with the terms of their texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            for words in cut_words(part.column("text"), LETTERS_FOLDED):
                yield part.slice(words.row, words.texts), words


def _hashes(column: pa.Array) -> np.ndarray:
    """A 64-bit hash of each row's string."""
    coded = column.dictionary_encode()
    known = [int.from_bytes(blake2b(s.encode(), digest_size=8).digest(), "little") for s in coded.dictionary.to_pylist()]
    return np.array(known, dtype=np.uint64)[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, dtype=np.uint64)


class Survivors:
    """Bits of the prefixes and terms that enough documents hold; the lowest bit of a key tells an open prefix from a whole term."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(1 << (bits - 6), dtype=np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> np.uint64(64 - self.bits)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _keys(words: Words, langs: np.ndarray, chosen: np.ndarray, size: int | None) -> np.ndarray:
    """Keys of the chosen terms cut to ``size`` bytes; a term that is not longer is whole."""
    owner = np.searchsorted(words.first, chosen, side="right") - 1
    hashes, cut = words.hashes[chosen].copy(), np.zeros(len(chosen), dtype=bool)
    if size is not None:
        cut = words.ends[chosen] - words.starts[chosen] > size
        hashes[cut] = beginnings(words, chosen[cut], size, LETTERS_FOLDED)
    return (mix(hashes ^ langs[owner]) & ~np.uint64(1)) | cut.astype(np.uint64)


def _sorted_runs(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, rows): the order of the keys, where each distinct key begins in it, and how many rows hold it; owners ascend."""
    order = np.argsort(keys, kind="stable")  # equal keys stay in order of their rows
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    row = new.copy()
    row[1:] |= owner[1:] != owner[:-1]
    starts = np.flatnonzero(new)
    return order, starts, np.add.reduceat(row, starts, dtype=np.int64) if len(starts) else np.zeros(0, dtype=np.int64)


def _combined(parts: Iterator[tuple[np.ndarray, list[np.ndarray], object]]) -> Iterator[tuple[np.ndarray, list[np.ndarray], list, np.ndarray]]:
    """Sums of parts (keys, numbers, anything) over many chunks: (keys, sums, the parts' other values, place of one part's row for each key)."""
    held: list[tuple[np.ndarray, list[np.ndarray], object]] = []
    size = 0

    def merged():
        keys = np.concatenate([p[0] for p in held])
        order, starts, _ = _sorted_runs(keys, np.zeros(len(keys), dtype=np.int8))
        sums = [np.add.reduceat(np.concatenate(column)[order], starts) for column in zip(*(p[1] for p in held))]
        return keys[order[starts]], sums, [p[2] for p in held], order[starts]

    for part in parts:
        if len(part[0]):
            held.append(part)
            size += len(part[0])
        if size >= _HELD_ROWS:
            yield merged()
            held, size = [], 0
    if held:
        yield merged()


def _prefix_counts(docs: DataFrame, size: int, before: int | None, known) -> DataFrame:
    """(key, docs): rows that hold each term or prefix of ``size`` bytes, of the terms whose shorter prefix survived."""

    def counted(batches):
        for part, words in _chunks(batches):
            langs = _hashes(part.column("lang"))
            chosen = np.arange(len(words.hashes))
            if before is not None:
                chosen = chosen[words.ends - words.starts > before]
                chosen = chosen[known.value.holds(_keys(words, langs, chosen, before))]
            keys = _keys(words, langs, chosen, size)
            order, starts, rows = _sorted_runs(keys, np.searchsorted(words.first, chosen, side="right") - 1)
            yield keys[order[starts]], [rows], None

    def run(batches):
        for keys, (rows,), _, _ in _combined(counted(batches)):
            made = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(rows)], names=["key", "docs"])
            yield from (made.slice(start, _SENT_ROWS) for start in range(0, len(rows), _SENT_ROWS))

    return docs.select("lang", "text").mapInArrow(lean(run), "key bigint, docs bigint").groupBy("key").agg(F.sum("docs").alias("docs"))


def surviving_terms(docs: DataFrame, least: int, bits: int) -> Survivors:
    """Refine prefixes level by level over all documents; every term in ``least`` rows of its language is among the survivors."""
    spark, found = docs.sparkSession, Survivors(bits)
    size, before = _FIRST_SIZE, None
    while True:
        known = spark.sparkContext.broadcast(found)  # 2 ** bits bits
        counted = _prefix_counts(docs, size, before, known).filter(F.col("docs") >= least)
        place = counted.select(F.shiftrightunsigned("key", 64 - bits).alias("place"), (F.col("key").bitwiseAND(1)).alias("open"))
        bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
        filled = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"), F.max("open").alias("open")).toArrow()
        known.unpersist()
        found.words[filled["word"].to_numpy()] |= filled["bits"].to_numpy().view(np.uint64)
        if not len(filled) or not pc.max(filled["open"]).as_py():
            return found
        size, before = size * _GROWTH, size


def kept_terms(documents: DataFrame, *, least: int = 3, bits: int = 25, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, term, total, used): terms that at least ``least`` rows of their language hold, with the occurrences in each source.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower case. ``used`` lists (source, count) for the sources
    that hold the term. A null language, source or text counts as empty; a repeated row is a document of its own. An empty table, or texts
    without terms, give no rows. Whole texts count, whatever their length.
    """
    docs = _documents(documents, lang, source, text)
    let_workers_import(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(surviving_terms(docs, least, bits))

    def counted(batches, codes: dict[tuple[str, str], int]):
        for part, words in _chunks(batches):
            langs, sources = _hashes(part.column("lang")), _hashes(part.column("source"))
            group = np.array([codes.setdefault(pair, len(codes)) for pair in zip(part.column("lang").to_pylist(), part.column("source").to_pylist())])
            chosen = np.arange(len(words.hashes))
            keys = _keys(words, langs, chosen, None)
            chosen = chosen[known.value.holds(keys)]
            owner = np.searchsorted(words.first, chosen, side="right") - 1
            keys = mix(keys[chosen] ^ mix(sources[owner]))
            order, starts, rows = _sorted_runs(keys, owner)
            first = chosen[order[starts]]
            length = words.ends[first] - words.starts[first]
            letters = words.data[expand(words.starts[first], length)]
            letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.uint8)
            offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
            terms = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes()))
            yield keys[order[starts]], [rows, np.diff(np.append(starts, len(keys)))], (group[owner[order[starts]]], terms)

    def run(batches):
        codes: dict[tuple[str, str], int] = {}
        for _, (rows, counts), others, place in _combined(counted(batches, codes)):
            group = pa.array(np.concatenate([g for g, _ in others])[place])
            terms = pa.concat_arrays([t for _, t in others]).take(pa.array(place)).cast(pa.string())
            names = [pa.array([pair[k] for pair in codes], pa.string()).take(group) for k in (0, 1)]
            made = pa.RecordBatch.from_arrays([*names, terms, pa.array(rows), pa.array(counts)], names=["lang", "source", "term", "docs", "count"])
            yield from (made.slice(start, _SENT_ROWS) for start in range(0, len(rows), _SENT_ROWS))

    found = docs.mapInArrow(lean(run), "lang string, source string, term string, docs bigint, count bigint")
    # tasks have summed already; spread by term, one shuffle serves the sums by source and by language
    by_source = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))
    by_term = by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("used")
    )
    return by_term.filter(F.col("docs") >= least).select("lang", "term", "total", "used")


def _probability(count: Column, occurrences: Column, terms: Column) -> Column:
    """1 + floor(UNITS * (count + 1) / (occurrences + terms)), exact for any count."""
    whole = occurrences + terms
    small = F.call_function("div", F.lit(UNITS) * (count + 1), whole)
    wide = F.call_function("div", F.lit(UNITS).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), whole.cast("decimal(20,0)"))
    return F.lit(1).cast("bigint") + F.when(count < _SMALL_COUNT, small).otherwise(wide)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def source_groups(documents: DataFrame, kept: DataFrame, *, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, occurrences, terms, lang_occurrences) of every language and source that occur, with or without kept terms."""
    occurring = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source))]).distinct()
    used = kept.select("lang", F.explode("used").alias("u")).groupBy("lang", F.col("u.source").alias("source")).agg(F.sum("u.count").alias("occurrences"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_occurrences"))
    joined = occurring.join(used, ["lang", "source"], "left").join(langs, "lang", "left")
    return joined.fillna(0, ["occurrences", "terms", "lang_occurrences"])


def divergent_terms(groups: DataFrame, kept: DataFrame, most: int = 200) -> DataFrame:
    """(lang, source, item, value, rank): each group's terms that it uses more than its language does, the ``most`` farthest ones."""
    used = kept.select("lang", "term", "total", F.explode("used").alias("u")).select("lang", "term", "total", "u.source", "u.count")
    placed = used.join(groups, ["lang", "source"])
    p = _probability(F.col("count"), F.col("occurrences"), F.col("terms"))
    q = _probability(F.col("total"), F.col("lang_occurrences"), F.col("terms"))
    rows = placed.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    valued = rows.select("lang", "source", "item", _distance(F.col("p"), F.col("q")).alias("value"))
    return top_per_group(valued, ["lang", "source"], [F.col("value").desc(), "item"], most, rank="rank")


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of keys with the sums of their values."""
    order = np.lexsort(keys.T[::-1])
    keys, values = keys[order], values[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    return keys[starts], np.add.reduceat(values, starts) if len(starts) else values


def _partial_sums(kept: DataFrame, groups: list) -> DataFrame:
    """Sums inside each task: (a, b, value) corrections of terms that groups a and b both hold; with ``joint`` false, how many terms group a holds at probability b."""
    ids = {(g.lang, g.source): i for i, g in enumerate(groups)}
    numbers = np.array([(g.occurrences, g.terms) for g in groups], dtype=np.int64).reshape(-1, 2)
    shared = kept.sparkSession.sparkContext.broadcast((ids, numbers))

    def probabilities(counts: np.ndarray, group: np.ndarray) -> np.ndarray:
        whole = numbers_of(group)
        if counts.max(initial=0) < _SMALL_COUNT:
            return 1 + UNITS * (counts + 1) // whole
        return np.array([1 + UNITS * (c + 1) // n for c, n in zip(counts.tolist(), whole.tolist())], dtype=np.int64)

    def numbers_of(group: np.ndarray) -> np.ndarray:
        return shared.value[1][group].sum(axis=1)

    def run(batches):
        for batch in batches:
            lists = batch.column("used")
            entries = lists.flatten()
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            langs = np.repeat(np.array(batch.column("lang").to_pylist(), dtype=object), size)
            group = np.array([shared.value[0][key] for key in zip(langs, entries.field("source").to_pylist())], dtype=np.int64)
            if not len(group):
                continue
            p = probabilities(entries.field("count").to_numpy(zero_copy_only=False), group)
            p0 = probabilities(np.zeros(len(group), dtype=np.int64), group)
            keys, values = _summed(np.column_stack([group, p]), np.ones(len(group), dtype=np.int64))
            yield made(keys, values, False)
            # every ordered pair of one term's entries, some terms at a time
            ends = np.cumsum(size)
            per_entry, begin = np.repeat(size, size), np.repeat(ends - size, size)
            pairs = np.cumsum(per_entry)
            at = 0
            while at < len(group):
                stop = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + _PAIRS_AT_ONCE, side="right")))
                a = np.repeat(np.arange(at, stop), per_entry[at:stop])
                b = expand(begin[at:stop], per_entry[at:stop])
                a, b = a[a != b], b[a != b]
                f = lambda x, y: (x - y) ** 2 // y
                keys, values = _summed(np.column_stack([group[a], group[b]]), f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
                yield made(keys, values, True)
                at = stop

    def made(keys: np.ndarray, values: np.ndarray, joint: bool) -> pa.RecordBatch:
        columns = [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(values), pa.array(np.full(len(values), joint))]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "value", "joint"])

    sums = kept.select("lang", "used").mapInArrow(lean(run), "a bigint, b bigint, value bigint, joint boolean")
    return written(sums.groupBy("a", "b", "joint").agg(F.sum("value").alias("value")))


def divergent_sources(groups: DataFrame, kept: DataFrame, max_groups: int = 100_000) -> DataFrame:
    """(lang, source, item, value, rank): each group against every other source of its language, over all kept terms.

    The result has a row for each pair of sources. The list of groups goes through the driver; more than ``max_groups`` of them, whose pairs could
    fill no report, are refused with a ValueError.
    """
    rows = groups.orderBy("lang", "source").take(max_groups + 1)
    if len(rows) > max_groups:
        raise ValueError(f"more than {max_groups} groups of language and source")
    named = local_table(groups.sparkSession, [(i, *r) for i, r in enumerate(rows)], "id bigint, lang string, source string, occurrences bigint, terms bigint, lang_occurrences bigint")
    some = named.filter("terms > 0").select("id", "lang", "source", "terms", _probability(F.lit(0).cast("bigint"), F.col("occurrences"), F.col("terms")).alias("none"))
    sums = _partial_sums(kept, rows)
    one, other = some.select("lang", F.col("id").alias("a"), F.col("none").alias("none_a")), some.select("lang", F.col("id").alias("b"), F.col("none").alias("none_b"))
    held = sums.filter("NOT joint").select("a", F.col("b").alias("p"), F.col("value").alias("n")).join(F.broadcast(one), "a")
    against = held.join(F.broadcast(other), "lang").filter("a <> b")
    own = F.col("n") * (_distance(F.col("p"), F.col("none_b")) - _distance(F.col("none_a"), F.col("none_b")))
    seen = F.col("n") * (_distance(F.col("none_b"), F.col("p")) - _distance(F.col("none_b"), F.col("none_a")))
    from_one = against.groupBy("a", "b").agg(F.sum(own).alias("own"), F.sum(seen).alias("seen"))
    parts = from_one.select("a", "b", F.col("own").alias("value")).union(from_one.select("b", "a", "seen")).union(sums.filter("joint").select("a", "b", "value"))
    corrections = parts.groupBy("a", "b").agg(F.sum("value").alias("more"))
    left = named.select("lang", F.col("id").alias("a"), "source").join(F.broadcast(some.select(F.col("id").alias("a"), "terms", F.col("none").alias("none_a"))), "a", "left")
    right = named.select("lang", F.col("id").alias("b"), F.col("source").alias("item")).join(F.broadcast(some.select(F.col("id").alias("b"), F.col("none").alias("none_b"))), "b", "left")
    pairs = left.join(F.broadcast(right), "lang").filter("a <> b").join(corrections, ["a", "b"], "left")
    value = F.coalesce(F.col("terms") * _distance(F.col("none_a"), F.col("none_b")), F.lit(0)) + F.coalesce("more", F.lit(0))
    return top_per_group(pairs.select("lang", "source", "item", value.cast("bigint").alias("value")), ["lang", "source"], [F.col("value").desc(), "item"], max_groups, rank="rank")


def divergence_report(documents: DataFrame, *, least: int = 3, most: int = 200, bits: int = 25) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows of all pairs of sources, and the ``most`` farthest ``term`` rows of each source.

    Null language, source and text count as empty. A group without terms has its pairs, with the probabilities of unused terms; a language without
    kept terms has pairs of value 0. An empty table gives no rows.
    """
    kept = written(kept_terms(documents, least=least, bits=bits))
    groups = written(source_groups(documents, kept))
    parts = [("pair", divergent_sources(groups, kept)), ("term", divergent_terms(groups, kept, most))]
    shown = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, rows in parts]
    return shown[0].unionByName(shown[1])
