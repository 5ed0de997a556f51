"""Size-aware join of documents whose word n-gram sets have a Jaccard similarity of at least 4/5.

Two sets of a and b shingles are similar when they share at least c(a, b) = ceil(4 (a + b) / 9).

* Small sets write down every subset of each size c that a partner may ask for. Sets that meet in a subset of size c
  are similar whenever c(a, b) <= c, so the members of a subset are linked with its smallest member, and nothing has
  to be verified.
* Large sets go through inverted lists. Shingles are ordered by document frequency, counted exactly over all documents,
  and a set is listed under its prefix only: the n - ceil(4n/5) + 1 rarest shingles, one of which any
  partner shares. Shingles of one document only take places of the prefix but need no list, and a set with fewer than ceil(4n/5)
  shared shingles has no partner. Small sets that a large set may match are listed too.
* The boundary between the two is the set size at which the total of the subsets written and of the list entries expected is least.

Equal sets are one class. Of a class that holds at least one in ``HOT_CLASSES`` of the rows, only the rows with its smallest id send their shingles
to the lists, once a task; of the others a copy more does no harm. Lists are scanned in rounds that never pair up a group: in each round every list has one
leader, its members are verified against it by exact overlap, and the links found become components. What has become
one component needs no more comparing. After the rounds, members of different components that still share a list are all compared: inside the
list's task, which returns links only, where a list is long, and as distinct pairs where lists are short or sets large.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelespan.llm.arrow_columns import append_columns, bucket_of, by_bucket, expand, free_name, lean, let_workers_import, pack, partitions, unpack
from allelespan.llm.linking import components, run_bounds, whole_runs, written
from allelespan.llm.word_hashes import SPACED_FOLDED, cut_words, mix, shingle_runs

#: Largest set that may be small, whatever the costs say.
SMALL_LIMIT = 20
#: Classes that hold at least one row in this many are hot, so there are never more than that.
HOT_CLASSES = 10_000
#: list entries of a chunk: shingles, entries per set, set, set size
_ENTRY_KINDS = ("u8", "u4", "u8", "u4")
#: shared shingles on the way back to their sets: set, shingles, set size, shingle, class of its document frequency
_SHARED_KINDS = ("u8", "u4", "u4", "u8", "u1")


def least_overlap(a: int, b: int) -> int:
    return -(-4 * (a + b) // 9)


def subset_sizes(n: int) -> list[int]:
    """Sizes of the subsets that a small set of ``n`` shingles writes down."""
    return sorted({least_overlap(n, b) for b in range(-(-4 * n // 5), 5 * n // 4 + 1)})


def choose_boundary(sets: dict[int, int], mean_list: float) -> int:
    """The size up to which sets are small, by the total cost over the counted set sizes."""

    def light(n: int) -> float:
        return sum(comb(n, c) for c in subset_sizes(n))

    def heavy(n: int) -> float:
        return n + (n - -(-4 * n // 5) + 1) * mean_list

    return min(range(SMALL_LIMIT + 1), key=lambda x: (sum(k * (light(n) if n <= x else heavy(n)) for n, k in sets.items()), x))


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingles of each text)."""
    for words in cut_words(texts, SPACED_FOLDED):
        shingles, bounds = shingle_runs(words, size)
        yield words.row, [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _name(shingles: np.ndarray) -> int:
    """A 64-bit name of a set of shingles."""
    total = np.array([shingles.sum(dtype=np.uint64) + np.uint64(len(shingles))], dtype=np.uint64)
    return int(mix(total).view(np.int64)[0])


def shingle_sets(documents: DataFrame, size: int) -> DataFrame:
    """(id, n, set, small): the number of shingles, the set's name (null without shingles), and the shingles of sets that may be small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, small = [], [], []
            for _, sets in _sets(batch.column("text"), size):
                n.extend(len(s) for s in sets)
                names.extend(_name(s) if len(s) else None for s in sets)
                small.extend(s.view(np.int64) if 0 < len(s) <= SMALL_LIMIT else None for s in sets)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(small, pa.list_(pa.int64()))], names=["id", "n", "set", "small"])

    kind = documents.schema["id"].dataType.simpleString()
    return documents.mapInArrow(lean(run), f"id {kind}, n bigint, set bigint, small array<bigint>")


def _boundary(small: DataFrame) -> int:
    sizes = {r.n: r["count"] for r in small.groupBy("n").count().collect()}  # at most SMALL_LIMIT rows
    lists = small.select(F.explode("small").alias("shingle")).groupBy("shingle").count()
    mean = lists.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]
    return choose_boundary(sizes, mean or 1.0)


def _small_links(small: DataFrame) -> DataFrame:
    """Links (a, b) of small sets through the subsets that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, shingles in zip(batch.column("set").to_pylist(), batch.column("n").to_pylist(), batch.column("small").to_pylist()):
                values = mix(np.array(shingles, dtype=np.int64).view(np.uint64))
                keys, sizes = [], []
                for c in subset_sizes(n):
                    chosen = np.array(list(combinations(range(n), c)))
                    keys.append(mix(values[chosen].sum(axis=1, dtype=np.uint64) + np.uint64(c)))
                    sizes.append(np.full(len(chosen), c))
                keys, sizes = np.concatenate(keys), np.concatenate(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sizes), pa.array(np.full(len(keys), n)), pa.array(np.full(len(keys), name))], names=["key", "c", "n", "set"])

    subsets = small.select("set", "n", "small").mapInArrow(lean(run), "key bigint, c bigint, n bigint, set bigint")
    smallest = written(subsets.groupBy("key").agg(F.min(F.struct("n", "set")).alias("first"), F.count("*").alias("k")).filter("k > 1").select("key", "first"))
    met = subsets.join(smallest, "key").filter((4 * (F.col("n") + F.col("first.n")) <= 9 * F.col("c")) & (F.col("set") != F.col("first.set")))
    return met.select(F.col("set").alias("a"), F.col("first.set").alias("b"))


def hot_classes(classes: DataFrame, most: int = HOT_CLASSES) -> dict[int, int]:
    """Names of the classes (set, least, k) that hold at least one in ``most`` of all rows, at most ``most``, with the hash of their smallest id."""
    total = classes.agg(F.sum("k")).first()[0] or 0
    hot = classes.filter((F.col("k") > 1) & (F.col("k") * most >= total))
    return {r["set"]: r["key"] for r in hot.select("set", F.xxhash64("least").alias("key")).collect()}


def _entries(documents: DataFrame, hot: dict[int, int], size: int, least: int, buckets: int) -> DataFrame:
    """(bucket, block): every shingle of the sets of at least ``least`` shingles, dealt out by shingle.

    ``documents`` are (text, key), the key being the hash of the id. Sets named in ``hot`` are sent by the rows of that key only, and once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for row, every in _sets(batch.column("text"), size):
                named = {}
                for s, key in zip(every, keys[row : row + len(every)]):
                    name = _name(s) if len(s) >= least else None
                    if name is not None and (name not in hot or (hot[name] == key and name not in sent)):
                        named[name] = s
                sent.update(named.keys() & hot.keys())
                sets = list(named.items())
                if not sets:
                    continue
                names = np.array([name for name, _ in sets], dtype=np.int64).view(np.uint64)
                sizes = np.array([len(s) for _, s in sets])
                shingles, owner = np.concatenate([s for _, s in sets]), np.repeat(np.arange(len(sets)), sizes)
                order, edges = by_bucket(bucket_of(shingles, buckets), buckets)
                shingles, owner = shingles[order], owner[order]
                found, blocks = [], []
                for bucket in np.flatnonzero(np.diff(edges)).tolist():
                    own = owner[edges[bucket] : edges[bucket + 1]]
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    found.append(bucket)
                    blocks.append(pack(_ENTRY_KINDS, (shingles[edges[bucket] : edges[bucket + 1]], np.diff(np.append(first, len(own))), names[own[first]], sizes[own[first]])))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    return documents.mapInArrow(lean(run), "bucket int, block binary").repartitionById(buckets, F.col("bucket"))


def _columns(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...], repeated: dict[int, int]) -> list[np.ndarray] | None:
    """All blocks of a partition, joined; columns in ``repeated`` are spread by the counts in the column it names."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for batch in batches:
        for block in batch.column("block").to_pylist():
            arrays = unpack(kinds, block)
            for k, counts in repeated.items():
                arrays[k] = np.repeat(arrays[k], arrays[counts])
            for part, array in zip(parts, arrays):
                part.append(array)
    return [np.concatenate(p) for p in parts] if parts[0] else None


def _shared(entries: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block): the shingles that at least two sets hold, with their document frequency, dealt out by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _columns(batches, _ENTRY_KINDS, {2: 1, 3: 1})
        if columns is None:
            return
        shingle, _, name, size = columns
        order = np.argsort(shingle, kind="stable")
        same = shingle[order][1:] == shingle[order][:-1]
        more = np.zeros(len(order), dtype=bool)
        more[1:] |= same
        more[:-1] |= same
        rows = order[more]
        rows = rows[np.lexsort((name[rows], shingle[rows]))]
        distinct = np.ones(len(rows), dtype=bool)
        distinct[1:] = (shingle[rows][1:] != shingle[rows][:-1]) | (name[rows][1:] != name[rows][:-1])
        rows = rows[distinct]
        first = np.flatnonzero(np.append(True, shingle[rows][1:] != shingle[rows][:-1])) if len(rows) else np.zeros(0, dtype=np.int64)
        frequency = np.diff(np.append(first, len(rows)))
        frequency = np.repeat(frequency, frequency)
        rows, frequency = rows[frequency > 1], frequency[frequency > 1]
        label = shingle[rows]
        rank = np.minimum(np.round(16 * np.log2(np.maximum(frequency, 1))), 255)
        order = np.argsort(name[rows], kind="stable")
        rows, label, rank = rows[order], label[order], rank[order]
        order, edges = by_bucket(bucket_of(mix(name[rows]), buckets), buckets)
        rows, label, rank = rows[order], label[order], rank[order]
        for to in np.flatnonzero(np.diff(edges)).tolist():
            span = slice(edges[to], edges[to + 1])
            own = name[rows[span]]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            block = pack(_SHARED_KINDS, (own[first], np.diff(np.append(first, len(own))), size[rows[span]][first], label[span], rank[span]))
            yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([block], pa.binary())], names=["bucket", "block"])

    return entries.mapInArrow(lean(run), "bucket int, block binary").repartitionById(buckets, F.col("bucket"))


def _candidate_sets(shared: DataFrame) -> DataFrame:
    """(set, n, shingles, prefix): sets with enough shared shingles, these in rarest-first order, and the length of the listed prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _columns(batches, _SHARED_KINDS, {0: 1, 2: 1})
        if columns is None:
            return
        name, _, size, label, rank = columns
        order = np.lexsort((label, rank, name))
        name, size, label = name[order], size[order].astype(np.int64), label[order]
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        held = np.diff(np.append(first, len(name)))
        prefix = held - -(-4 * size[first] // 5) + 1
        keep = prefix > 0
        values = label[expand(first[keep], held[keep])].view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held[keep])).astype(np.int32)), pa.array(values))
        yield pa.RecordBatch.from_arrays([pa.array(name[first[keep]].view(np.int64)), pa.array(size[first[keep]]), lists, pa.array(prefix[keep])], names=["set", "n", "shingles", "prefix"])

    return shared.mapInArrow(lean(run), "set bigint, n bigint, shingles array<bigint>, prefix bigint")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar, by the exact overlap of their sets."""
    one, two = (sets.select(F.col("set").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"s_{c}")) for c in "ab")
    overlap = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(two, "b").join(one, "a").filter(9 * overlap >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _alike_sizes(n: Column, m: Column) -> Column:
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _large_links(sets: DataFrame, known: DataFrame, rounds: int) -> DataFrame:
    """Links (a, b) that join everything similar among the listed sets; ``known`` are links found before."""
    lists = sets.select("set", "n", F.size("shingles").alias("held"), F.posexplode(F.slice("shingles", F.lit(1), F.col("prefix").cast("int"))).alias("at", "shingle"))
    lists = written(lists.select("set", "n", "shingle", (F.col("n") - F.col("held") + F.col("at")).alias("place")))
    links = known
    for number in range(rounds + 1):
        groups = components(links).select(F.col("node").alias("set"), "component")
        named = lists.join(groups, "set", "left").withColumn("component", F.coalesce("component", "set"))
        split = named.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(F.xxhash64("set", F.lit(number)), "set", "n", "component")).alias("lead"))
        split = written(split.filter("low < high").select("shingle", "lead"))
        if split.isEmpty():
            break
        open_lists = named.join(split, "shingle")
        if number < rounds:
            met = open_lists.filter((F.col("component") != F.col("lead.component")) & _alike_sizes(F.col("n"), F.col("lead.n")))
            pairs = met.select(F.col("set").alias("a"), F.col("lead.set").alias("b")).distinct()
            links = written(links.union(_verified(written(pairs), sets)))
        else:
            links = written(links.union(_remaining_links(written(open_lists.select("shingle", "set", "n", "place", "component")), sets)))
    return links


def _remaining_links(members: DataFrame, sets: DataFrame, few: int = 8, carried: int = 512, block: int = 512) -> DataFrame:
    """Links (a, b) between different components inside the lists ``members``; every pair that may be similar is compared.

    There are two ways, by what they would move. Lists that hold more than ``few`` sets of at most ``carried`` shingles compare
    these inside the list's task, to which the sets are carried, and only links leave it. All other pairs, few to a list
    or of large sets, become rows, are made distinct over all lists, and their sets are joined to them.
    A similar pair passes the test of what can still be shared at the first list that it shares, and is found there in one way or the other.
    """
    can = F.col("n") <= carried
    sizes = members.groupBy("shingle").agg(F.count_if(can).alias("carry"))
    sizes = written(sizes.select("shingle", (F.col("carry") > few).alias("many"), F.greatest(F.lit(1), F.ceil(F.col("carry") / block)).cast("int").alias("blocks")))
    members = written(members.join(sizes, "shingle").withColumn("inside", F.col("many") & can))
    other = members.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("set", "n", "place", "component", "inside")])
    reach = 9 * F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) >= 4 * (F.col("n") + F.col("n_b"))
    met = members.join(other, "shingle").filter((F.col("component") < F.col("component_b")) & ~(F.col("inside") & F.col("inside_b")) & _alike_sizes(F.col("n"), F.col("n_b")) & reach)
    pairs = written(met.select(F.col("set").alias("a"), F.col("set_b").alias("b")).distinct())
    return _verified(pairs, sets).union(_links_inside(members.filter("inside"), sets))


def _links_inside(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different components of each list's members, found in the list's task.

    Lists of several ``blocks`` are compared block against block in tasks of their own. A pair that shares several lists is compared
    in the first one only.
    """
    dealt = members.withColumn("block", F.pmod(F.xxhash64("set", "shingle"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("shingle", "set", "n", "place", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    whole = dealt.join(sets.select("set", "shingles", "prefix"), "set").repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high")
    keys = ["shingle", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, keys):
            bounds = run_bounds(rows, keys)
            name, n, place, block, component = (rows[c].to_numpy() for c in ("set", "n", "place", "block", "component"))
            shingle, low, high, prefix = (rows[c].to_numpy() for c in ("shingle", "low", "high", "prefix"))
            lists = rows["shingles"].combine_chunks()
            flat, begin = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
            found: list[tuple[int, int]] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                left = n[a:b] - place[a:b]
                fits = (9 * np.minimum.outer(left, left) >= 4 * np.add.outer(n[a:b], n[a:b])) & (5 * np.minimum.outer(n[a:b], n[a:b]) >= 4 * np.maximum.outer(n[a:b], n[a:b]))
                fits &= np.less.outer(component[a:b], component[a:b])
                if low[a] != high[a]:
                    fits &= np.not_equal.outer(block[a:b], block[a:b])
                one, two = np.nonzero(fits)
                here = {i: flat[begin[i] : begin[i + 1]].tolist() for i in np.unique(np.concatenate([one, two]) + a).tolist()}
                kept = {i: set(values) for i, values in here.items()}
                heads = {i: here[i][: prefix[i]] for i in here}
                head_sets = {i: set(values) for i, values in heads.items()}
                root = {c: c for c in component[list(here)].tolist()}
                for i, j in zip((one + a).tolist(), (two + a).tolist()):
                    c, d = component[i], component[j]
                    while root[c] != c:
                        c = root[c]
                    while root[d] != d:
                        d = root[d]
                    if c != d and next(x for x in heads[i] if x in head_sets[j]) == shingle[a] and 9 * len(kept[i] & kept[j]) >= 4 * (n[i] + n[j]):
                        root[max(c, d)] = min(c, d)
                        found.append((int(name[i]), int(name[j])))
            if found:
                one, two = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])

    return whole.mapInArrow(lean(run), "a bigint, b bigint")


def _groups(texts: DataFrame, rows: DataFrame, size: int, rounds: int) -> DataFrame:
    """(set, component_id, leads): the smallest id of each class's component, and whether the class holds it."""
    buckets = partitions(texts)
    classes = written(rows.filter("set IS NOT NULL").groupBy("set").agg(F.min("id").alias("least"), F.count("*").alias("k")))
    small = written(rows.filter("small IS NOT NULL").groupBy("set").agg(F.first("n").alias("n"), F.first("small").alias("small")))
    boundary = _boundary(small)
    links = written(_small_links(small.filter(F.col("n") <= boundary)))
    least = -(-4 * (boundary + 1) // 5)
    entries = _entries(texts.select("text", F.xxhash64("id").alias("key")), hot_classes(classes), size, least, buckets)
    sets = written(_candidate_sets(_shared(entries, buckets)))
    links = _large_links(sets, links, rounds)
    groups = components(links).select(F.col("node").alias("set"), "component")
    named = written(classes.join(groups, "set", "left").select("set", "least", F.coalesce("component", "set").alias("component")))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), "least", "set")).alias("first"))
    return written(named.join(written(first), "component").select("set", F.col("first.least").alias("component_id"), (F.col("set") == F.col("first.set")).alias("leads")))


def similar_documents(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, rounds: int = 2) -> DataFrame:
    """One row per row of ``documents``: the id, ``n_shingles``, and ``component_id``, the smallest id reachable by links.

    Words are runs without ASCII white space, A-Z lower-cased; the set of a text with fewer than ``size`` words is its
    whole word sequence, and a text without words (null, empty, blank) is linked with nothing. Repeated rows are copies of each
    other and linked. A null id is the smallest of no component unless all its ids are null. Other columns are ignored.
    """
    let_workers_import(documents.sparkSession)
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = written(shingle_sets(texts, size))
    groups = _groups(texts, rows, size, rounds)
    found = rows.select("id", "n", "set").join(groups, "set", "left")
    component = F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_representatives(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, rounds: int = 2) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns: of each component the row with the smallest id.

    Among rows of that id the first by text stays. Texts without words all stay. A component whose ids are all null keeps one row.
    """
    let_workers_import(documents.sparkSession)
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = written(shingle_sets(texts, size))
    leaders = _groups(texts, rows, size, rounds).filter("leads")
    name, key, place = (free_name(documents, n) for n in ("set", "key", "place"))
    leaders = leaders.select(F.col("set").alias(name), F.xxhash64("component_id").alias(key))

    def named(batches):
        for (whole,) in batches:
            yield [[_name(s) if len(s) else None for _, sets in _sets(whole, size) for s in sets]]

    marked = append_columns(documents, [text], f"`{name}` bigint", named).withColumn(key, F.xxhash64(doc_id))
    # joined by class and id, so that a group of copies meets nowhere
    own = marked.filter(F.col(name).isNotNull()).join(leaders, [name, key])
    once = own.withColumn(place, F.row_number().over(Window.partitionBy(name, key).orderBy(text))).filter(F.col(place) == 1)
    return once.select(documents.columns).union(marked.filter(F.col(name).isNull()).select(documents.columns))
