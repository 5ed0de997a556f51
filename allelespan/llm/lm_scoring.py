"""Masked pseudo-likelihood scores of documents from a small bidirectional network.

Every word is predicted from the ``window`` words on both sides of it, itself masked, and a document's score is the sum of the
log-probabilities of its words (its pseudo-log-likelihood). The network is trained with numpy on every word of the corpus:

* the network predicts the ``words`` most frequent words, counted over all documents, and for any other word its hash class, one of ``others``;
* within its class a rare word has a probability of its own, from its count over all documents (``RareWords``), so that every word of
  the corpus is scored as itself. A word that was never counted shares the class's part for new words evenly with all other 64-bit hashes;
* the neighbours' embeddings, each weighted by its place, are added and go through tanh; the output is a two-level softmax, first over
  groups of words, then over the words of the group, so that a probability is normalised without visiting all words;
* in each pass every task takes gradient steps over its own whole partition from the same start, and the parameters are then
  averaged, weighted by words. The sums go through a shuffle in slices, so what is gathered grows with the tasks but no task or driver holds more than
  one copy of the parameters and one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.llm.arrow_columns import append_columns, bucket_of, by_bucket, free_name, joined, let_workers_import, pack, partitions, unpack
from allelespan.llm.linking import written
from allelespan.llm.word_hashes import SPACED_FOLDED, Words, cut_words

_STEP_WORDS = 8192
#: Entries that a task gathers before it sends them off in blocks.
_HELD = 1 << 20
_COUNTED, _SEEN, _SUMMED = ("u8", "u8"), ("u8", "u8", "u1"), ("u8", "f8", "u8")


@dataclass
class Shape:
    words: int = 2016
    others: int = 32
    groups: int = 32
    width: int = 16
    window: int = 2

    @property
    def ids(self) -> int:
        """Words and hash classes; the id after them stands for the edge of a text."""
        return self.words + self.others

    @property
    def members(self) -> int:
        return -(-self.ids // self.groups)


class Network:
    """Parameters as one flat vector, seen as arrays."""

    def __init__(self, shape: Shape, flat: np.ndarray | None = None):
        self.shape = shape
        sizes = {
            "near": (shape.ids + 1, shape.width),
            "place": (2 * shape.window, shape.width),
            "lift": (shape.width,),
            "group": (shape.groups, shape.width),
            "group_bias": (shape.groups,),
            "member": (shape.groups, shape.members, shape.width),
            "member_bias": (shape.groups, shape.members),
        }
        if flat is None:
            random = np.random.default_rng(11)
            flat = np.concatenate([(random.standard_normal(int(np.prod(s))) * (0.3 if len(s) > 1 and not name.endswith("bias") else 0)).astype(np.float32) for name, s in sizes.items()])
        self.flat, at = flat.astype(np.float32), 0
        for name, size in sizes.items():
            count = int(np.prod(size))
            setattr(self, name, self.flat[at : at + count].reshape(size))
            at += count

    def log_probabilities(self, target: np.ndarray, around: np.ndarray, rate: float = 0.0) -> np.ndarray:
        """Log-probability of each target id given the ids around it; with a rate, also one gradient step.

        The words are taken in the order of their groups and stand along the last axis, so that a group is a slice and sums over its members run along whole rows.
        """
        shape, n, trained = self.shape, len(target), bool(rate)
        order, bounds = by_bucket(target // shape.members, shape.groups)
        bounds, (groups, members) = bounds.tolist(), np.divmod(target[order], shape.members)
        around = [column[order] for column in around.T]
        weights = 1 + self.place
        rows = self.lift + sum((self.near * weight).take(column, axis=0) for column, weight in zip(around, weights))
        # the last row, of ones, goes with the biases
        hidden = np.ones((shape.width + 1, n), dtype=np.float32)
        np.tanh(rows.T, out=hidden[:-1])
        group, member = np.column_stack([self.group, self.group_bias]), np.concatenate([self.member, self.member_bias[:, :, None]], axis=2)
        # hidden values lie within 1, so no score is beyond the sum of its parameters
        large = max(np.abs(group).sum(axis=1).max(), np.abs(member).sum(axis=2).max()) > _SUMMABLE
        out, chance = _softmax(group @ hidden, groups, large, trained)
        step = np.float32(rate / n)
        slope = np.empty((shape.width, n), dtype=np.float32) if trained else None
        for g in np.flatnonzero(np.diff(bounds)).tolist():
            own, real = slice(bounds[g], bounds[g + 1]), min(shape.members, shape.ids - g * shape.members)
            near = hidden[:, own]
            logs, part = _softmax(member[g, :real] @ near, members[own], large, trained)
            out[own] += logs
            if trained:
                slope[:, own] = self.member[g, :real].T @ part
                change = step * (part @ near.T)
                self.member[g, :real] -= change[:, :-1]
                self.member_bias[g, :real] -= change[:, -1]
        if trained:
            slope += self.group.T @ chance
            change = step * (chance @ hidden.T)
            self.group -= change[:, :-1]
            self.group_bias -= change[:, -1]
            slope *= 1 - hidden[:-1] * hidden[:-1]
            self.lift -= step * slope.sum(axis=1)
            near, ids = self.near.copy(), shape.ids + 1
            columns, slopes = np.arange(0, ids * shape.width, ids)[:, None], slope.astype(np.float64).ravel()
            for p, weight in enumerate(weights):
                sums = np.bincount((around[p] + columns).ravel(), weights=slopes, minlength=near.size).reshape(-1, ids).T.astype(np.float32)
                self.place[p] -= step * (near * sums).sum(axis=0)
                self.near -= step * weight * sums
        told = np.empty_like(out)
        told[order] = out
        return told


#: The least log-probability of a group, and of a member of its group.
_LEAST = np.float32(np.log(1e-30))
#: Scores up to here, as powers of e, can be summed as they are.
_SUMMABLE = 60


def _softmax(scores: np.ndarray, chosen: np.ndarray, large: bool, trained: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each column's chosen row and, to train on, the gradient of its negative by all scores, which are overwritten."""
    if large:
        scores -= scores.max(axis=0)
    flat, cells = scores.reshape(-1), chosen * scores.shape[1] + np.arange(scores.shape[1])
    logs = flat[cells]
    np.exp(scores, out=scores)
    total = scores.sum(axis=0)
    logs -= np.log(total)
    if trained:
        scores /= total
        flat[cells] -= 1
    return np.maximum(logs, _LEAST), scores


@dataclass
class Vocabulary:
    """Hashes of the known words, sorted, and their ids, the most frequent first."""

    hashes: np.ndarray
    ids: np.ndarray
    shape: Shape

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, known) of each hash."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(at), dtype=bool)

    def other(self, hashes: np.ndarray) -> np.ndarray:
        """The class of each hash, were it not known."""
        return (hashes % np.uint64(self.shape.others)).astype(np.int64)

    def read(self, words: Words) -> np.ndarray:
        at, known = self.find(words.hashes)
        ids = self.shape.words + self.other(words.hashes)
        ids[known] = self.ids[at[known]]
        # neighbours in rank lie in different groups, so that groups are of like weight
        every = np.arange(self.shape.ids)
        return (every % self.shape.groups * self.shape.members + every // self.shape.groups)[ids]

    def around(self, words: Words, ids: np.ndarray) -> np.ndarray:
        """Ids on both sides of every word; beyond the text's edges the edge's id."""
        first, stop, edge = words.first[:-1], words.first[1:], self.shape.ids
        before, after = [], []
        for shift in range(1, self.shape.window + 1):
            left, right = np.full_like(ids, edge), np.full_like(ids, edge)
            left[shift:], right[:-shift] = ids[:-shift], ids[shift:]
            for k in range(shift):
                has = first + k < stop
                left[first[has] + k], right[stop[has] - 1 - k] = edge, edge
            before.insert(0, left)
            after.append(right)
        # every side's ids stand together in memory
        return np.stack(before + after).T


def count_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word, given by its hash, stands in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in cut_words(batch.column(0), SPACED_FOLDED):
                own, n = np.unique(words.hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["word", "n"])

    return documents.select(F.col(text).cast("string")).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def count_vocabulary(documents: DataFrame, shape: Shape, text: str = "text", counts: DataFrame | None = None) -> Vocabulary:
    """The most frequent words over all documents; ties go to the smaller hash."""
    counts = count_words(documents, text) if counts is None else counts
    top = counts.orderBy(F.desc("n"), "word").limit(shape.words).collect()
    hashes = np.array([r.word for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order.astype(np.int64), shape)


def _dealt(kinds: tuple[str, ...], arrays: list[np.ndarray], buckets: np.ndarray, count: int, kind: int) -> pa.RecordBatch:
    """The arrays' entries as one block for each bucket."""
    order, bounds = by_bucket(buckets, count)
    filled = np.flatnonzero(np.diff(bounds))
    blocks = [pack(kinds, [a[order[bounds[b] : bounds[b + 1]]] for a in arrays]) for b in filled]
    return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([kind] * len(filled), pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "kind", "block"])


_BLOCKS = "bucket int, kind int, block binary"


class RareWords:
    """log P(word | class) of the words outside the vocabulary: n / (N + T) for a word counted n times in a class of N words, T of them distinct.

    The T / (N + T) that is left goes to new words, evenly over the hashes of the class. Counts stay in a table and are never gathered:
    they meet the words of the documents in buckets of hashes, and only the N and T of each class reach the driver.
    """

    def __init__(self, counts: DataFrame, vocabulary: Vocabulary):
        self.counts, self.vocabulary = counts, vocabulary

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, vocabulary.shape.others), dtype=np.int64)
            for batch in batches:
                words = batch.column("word").to_numpy().view(np.uint64)
                rare = ~vocabulary.find(words)[1]
                np.add.at(sums[0], vocabulary.other(words[rare]), batch.column("n").to_numpy()[rare])
                sums[1] += np.bincount(vocabulary.other(words[rare]), minlength=vocabulary.shape.others)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums[0])), pa.int32()), pa.array(sums[0]), pa.array(sums[1])], names=["other", "n", "distinct"])

        totals = counts.mapInArrow(add, "other int, n bigint, distinct bigint").groupBy("other").agg(F.sum("n"), F.sum("distinct")).collect()
        self.words, self.distinct = np.zeros(vocabulary.shape.others), np.zeros(vocabulary.shape.others)
        for other, n, distinct in totals:
            self.words[other], self.distinct[other] = n, distinct

    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        """For each class, what is added to log n of a counted word, and the log-probability of a new one."""
        every = np.maximum(self.words + self.distinct, 1)
        new = np.where(self.words > 0, self.distinct / every, 1)
        return -np.log(every), np.log(new) - np.log(2.0**64 / self.vocabulary.shape.others)

    def sums(self, documents: DataFrame, key: str, text: str, into: str) -> DataFrame:
        """(key, into): the sum of log P(word | class) over the rare words of each text that has some; equal texts must have equal keys."""
        vocabulary, (counted, new), buckets = self.vocabulary, self.logs(), partitions(documents)

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, n = batch.column("word").to_numpy().view(np.uint64), batch.column("n").to_numpy()
                rare = ~vocabulary.find(words)[1]
                yield _dealt(_COUNTED, [words[rare], n[rare].astype(np.uint64)], bucket_of(words[rare], buckets), buckets, 0)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                keys = batch.column(0).to_numpy().view(np.uint64)
                for words in cut_words(batch.column(1), SPACED_FOLDED):
                    rare = np.flatnonzero(~vocabulary.find(words.hashes)[1])
                    owner = np.repeat(np.arange(words.texts), np.diff(words.first))[rare]
                    # one entry of each text tells that there is a text, so that copies can be counted
                    first = np.diff(owner, prepend=-1) > 0
                    held.append((words.hashes[rare], keys[words.row + owner], first.astype(np.uint8)))
                    n += len(rare)
                    if n >= _HELD:
                        parts = [np.concatenate(x) for x in zip(*held)]
                        yield _dealt(_SEEN, parts, bucket_of(parts[0], buckets), buckets, 1)
                        held, n = [], 0
            if n:
                parts = [np.concatenate(x) for x in zip(*held)]
                yield _dealt(_SEEN, parts, bucket_of(parts[0], buckets), buckets, 1)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, parts, table, held, n = None, [], None, [], 0
            for batch in batches:
                for own, kind, block in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "block"))):
                    if own != bucket:
                        bucket, parts, table = own, [], None
                    if kind == 0:
                        parts.append(unpack(_COUNTED, block))
                        continue
                    if table is None:
                        words = joined([w for w, _ in parts], "u8")
                        order = np.argsort(words)
                        table, parts = (words[order], np.log(joined([c for _, c in parts], "u8")[order].astype(np.float64))), []
                    words, keys, first = unpack(_SEEN, block)
                    other = vocabulary.other(words)
                    at = np.minimum(np.searchsorted(table[0], words), max(len(table[0]) - 1, 0))
                    known = table[0][at] == words if len(table[0]) else np.zeros(len(words), dtype=bool)
                    logs = np.where(known, counted[other] + (table[1][at] if len(table[1]) else 0), new[other])
                    # the entries of a text follow one another
                    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    held.append((keys[starts], np.add.reduceat(logs, starts), np.add.reduceat(first.astype(np.uint64), starts)))
                    n += len(starts)
                    if n >= _HELD:
                        sums = [np.concatenate(x) for x in zip(*held)]
                        yield _dealt(_SUMMED, sums, bucket_of(sums[0], buckets), buckets, 2)
                        held, n = [], 0
            if n:
                sums = [np.concatenate(x) for x in zip(*held)]
                yield _dealt(_SUMMED, sums, bucket_of(sums[0], buckets), buckets, 2)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, logs, texts = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64)
            for batch in batches:
                parts = [unpack(_SUMMED, block) for block in batch.column("block").to_pylist()]
                for part in parts:
                    own, place = np.unique(np.concatenate([keys, part[0]]), return_inverse=True)
                    logs = np.bincount(place, weights=np.concatenate([logs, part[1]]), minlength=len(own))
                    texts = np.bincount(place, weights=np.concatenate([texts, part[2]]), minlength=len(own))
                    keys = own
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(logs / texts)], names=["key", "sum"])

        told = self.counts.mapInArrow(tell, _BLOCKS)
        asked = documents.select(key, F.col(text).cast("string")).mapInArrow(ask, _BLOCKS)
        met = told.union(asked).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(meet, _BLOCKS)
        summed = met.repartitionById(buckets, F.col("bucket")).mapInArrow(add, "key bigint, sum double")
        return summed.select(F.col("key").alias(key), F.col("sum").alias(into))


def train(documents: DataFrame, shape: Shape | None = None, *, text: str = "text", passes: int = 1, rate: float = 2.0, counts: DataFrame | None = None) -> tuple[Vocabulary, Network]:
    """Train on every word of ``documents``; without words the network keeps its first parameters. ``counts`` are those of ``count_words``, if at hand."""
    shape = shape or Shape()
    spark = documents.sparkSession
    let_workers_import(spark)
    vocabulary, network = count_vocabulary(documents, shape, text, counts), Network(shape)
    slices = partitions(documents)
    for number in range(passes):
        start = spark.sparkContext.broadcast((vocabulary, network.flat))
        step = rate / (1 + number)

        def steps(batches: Iterator[pa.RecordBatch], start=start, step=step) -> Iterator[pa.RecordBatch]:
            known, flat = start.value
            own, total = Network(known.shape, flat.copy()), 0
            for batch in batches:
                for words in cut_words(batch.column(0), SPACED_FOLDED):
                    ids = known.read(words)
                    around = known.around(words, ids)
                    for at in range(0, len(ids), _STEP_WORDS):
                        own.log_probabilities(ids[at : at + _STEP_WORDS], around[at : at + _STEP_WORDS], step)
                    total += len(ids)
            if total:
                parts = np.array_split(own.flat.astype(np.float64) * total, slices)
                yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([float(total)] * slices), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["slice", "total", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for place, total, part in zip(*(batch.column(c).to_pylist() for c in ("slice", "total", "sums"))):
                    values = np.frombuffer(part, dtype=np.float32).astype(np.float64)
                    held = sums.setdefault(place, [0.0, np.zeros(len(values))])
                    held[0] += total
                    held[1] += values
            for place, (total, values) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([(values / total).astype(np.float32).tobytes()], pa.binary())], names=["slice", "mean"])

        moved = documents.select(F.col(text).cast("string")).mapInArrow(steps, "slice int, total double, sums binary")
        means = sorted(moved.repartitionById(slices, F.col("slice")).mapInArrow(add, "slice int, mean binary").collect())  # one copy of the parameters
        if means:
            network = Network(shape, np.concatenate([np.frombuffer(r["mean"], dtype=np.float32) for r in means]))
    return vocabulary, network


def score(documents: DataFrame, vocabulary: Vocabulary, network: Network, *, text: str = "text", rare: RareWords | None = None) -> DataFrame:
    """``documents`` with ``n_words``, ``log_probability`` (the sum over all words of the text) and ``mean_log_probability``.

    Columns of these names are replaced, others and repeated rows stay. A text without words (null, empty, blank) has 0 words, sum 0 and a null mean.
    Without ``rare`` a word outside the vocabulary counts as its class; with it, as itself.
    """
    shared = documents.sparkSession.sparkContext.broadcast((vocabulary, network.flat))

    def run(batches):
        known, flat = shared.value
        own = Network(known.shape, flat.copy())
        for (texts,) in batches:
            counts, sums = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
            for words in cut_words(texts, SPACED_FOLDED):
                ids = known.read(words)
                around = known.around(words, ids)
                logs = [np.zeros(1)] + [own.log_probabilities(ids[at : at + _STEP_WORDS], around[at : at + _STEP_WORDS]).astype(np.float64) for at in range(0, len(ids), _STEP_WORDS)]
                until = np.cumsum(np.concatenate(logs))
                counts.append(np.diff(words.first))
                sums.append(np.diff(until[words.first]))
            n, total = np.concatenate(counts), np.concatenate(sums)
            yield [pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)]

    added = "n_words bigint, log_probability double, mean_log_probability double"
    if rare is None:
        return append_columns(documents, [text], added, run)
    key, into = free_name(documents, "text_key"), free_name(documents, "rare_sum")
    keyed = documents.withColumn(key, F.xxhash64(F.col(text).cast("string")))
    scored = append_columns(keyed, [text], added, run)
    total = F.col("log_probability") + F.coalesce(into, F.lit(0.0))
    names = [c for c in scored.columns if c not in (key, "log_probability", "mean_log_probability")]
    joined_sums = scored.join(rare.sums(keyed, key, text, into), key, "left")
    return joined_sums.select(*names, total.alias("log_probability"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_probability"))


def lm_report(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its words and its pseudo-log-likelihood under a network trained on all documents."""
    let_workers_import(documents.sparkSession)
    counts = written(count_words(documents, text))
    vocabulary, network = train(documents, text=text, counts=counts)
    return score(documents.select(doc_id, text), vocabulary, network, text=text, rare=RareWords(counts, vocabulary)).select(doc_id, "n_words", "log_probability", "mean_log_probability")
