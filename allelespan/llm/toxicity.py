"""A toxicity classifier that is penalised for minding which group a text mentions.

Logistic regression over the words of a text and their first four and six bytes (present or not). Every labelled
text that names a group gets a counterfactual in which each group term is swapped for another one of the same
list, and training penalises the squared change of the score between the two. A neutral mention of a group that the labels happen
to pair with toxicity then doesn't raise the score.

The classifier is fitted on at most ``max_rows`` labelled texts, those with the smallest hashes of their ids. Their features are counted by Spark, and
only the numbers of at most ``max_features`` chosen ones reach the driver, however long the texts are; scoring is one map over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.llm.arrow_columns import append_columns, lean, let_workers_import
from allelespan.llm.linking import written
from allelespan.llm.word_hashes import ALNUM_FOLDED, Words, cut_words, mix, powers

#: Group terms by list; a term is swapped for another of its own list.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "woman", "man", "transgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("muslime", "christen", "juden"),
    ("musulmans", "chrétiens", "juifs"),
    ("musulmanes", "cristianos", "judíos"),
)
#: Bytes of the word beginnings that are features beside the word itself.
_BEGINNINGS = (4, 6)
_FILTER_BITS = 20


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of every distinct feature of every text, ordered by text."""
    text = np.repeat(np.arange(words.texts), np.diff(words.first))
    owners, hashes = [text], [words.hashes]
    length = words.ends - words.starts
    for size in _BEGINNINGS:
        long = np.flatnonzero(length >= size)
        total = np.zeros(len(long), dtype=np.uint64)
        for k, power in enumerate(powers(size)):
            total += ALNUM_FOLDED.value[words.data[words.starts[long] + k]] * power
        owners.append(text[long])
        hashes.append(mix(total * np.uint64(2) + np.uint64(size)))
    owner, feature = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((feature, owner))
    owner, feature = owner[order], feature[order]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1])
    return owner[first], feature[first]


def _features_of(texts: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for words in cut_words(texts, ALNUM_FOLDED):
        owner, feature = word_features(words)
        out.extend(np.split(feature, np.searchsorted(owner, np.arange(1, words.texts))) if words.texts else [])
    return out


def swap_groups(text: str, terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> str | None:
    """The text with every group term swapped for the next one of its list; None if it names no group."""
    other = {term: group[(k + 1) % len(group)] for group in reversed(terms) for k, term in enumerate(group)}
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, other), key=len, reverse=True)) + r")\b", re.IGNORECASE)
    swapped, n = pattern.subn(lambda m: other[m[0].lower()], text)
    return swapped if n else None


@dataclass
class Classifier:
    """Weights of the features, sorted by hash."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        bits[(self.features >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        parts = [np.zeros(0)]
        for words in cut_words(texts, ALNUM_FOLDED):
            owner, feature = word_features(words)
            near = bits[(feature >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
            owner, feature = owner[near], feature[near]
            place = np.minimum(np.searchsorted(self.features, feature), max(len(self.features) - 1, 0))
            same = self.features[place] == feature if len(self.features) else np.zeros(len(feature), dtype=bool)
            parts.append(self.bias + np.bincount(owner[same], weights=self.weights[place[same]], minlength=words.texts))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -30, 30)))


def _columns_of(rows: list[np.ndarray], features: np.ndarray) -> list[np.ndarray]:
    """The places in the sorted ``features`` of those that each row has."""
    found = []
    for values in rows:
        place = np.minimum(np.searchsorted(features, values), max(len(features) - 1, 0))
        found.append(place[features[place] == values] if len(features) else place[:0])
    return found


def _cells(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of a sparse 0/1 matrix from the columns of each row."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.zeros(0, dtype=np.int64), *rows])


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, swapped: list[tuple[int, np.ndarray]], width: int, *, swap_penalty: float, l2: float = 1e-5, rounds: int = 300) -> tuple[np.ndarray, float]:
    """(weights, bias) of ``width`` columns by full-batch gradient steps. ``swapped`` pairs a row's number with its counterfactual's columns."""
    n, rate = len(rows), labels.mean()
    row, column = _cells(rows)
    pair_row, pair_column = _cells([x for _, x in swapped])
    own_row, own_column = _cells([rows[i] for i, _ in swapped])
    d_row, d_column = np.concatenate([own_row, pair_row]), np.concatenate([own_column, pair_column])
    d_sign = np.concatenate([np.ones(len(own_row)), -np.ones(len(pair_row))])
    w, bias = np.zeros(width), float(np.log(rate / (1 - rate)))
    moment, square = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weights=w[column], minlength=n), -30, 30)))
        gap = (p - labels) / n
        slope = np.bincount(column, weights=gap[row], minlength=width) + l2 * w
        if len(swapped):
            change = np.bincount(d_row, weights=d_sign * w[d_column], minlength=len(swapped))
            slope += 2 * swap_penalty / n * np.bincount(d_column, weights=d_sign * change[d_row], minlength=width)
        step = np.append(slope, gap.sum())
        moment = 0.9 * moment + 0.1 * step
        square = 0.999 * square + 0.001 * step**2
        move = 0.1 * moment / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def held_out(doc_id: str):
    """Whether a row's label is kept from training: crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _both_features(whole: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    """Features of each text, and of its counterfactual if it names a group."""
    swaps = [swap_groups(t) for t in whole.fill_null("").to_pylist()]
    named = iter(_features_of(pa.array([s for s in swaps if s is not None], pa.string())))
    return _features_of(whole), [None if s is None else next(named) for s in swaps]


def _feature_counts(texts: DataFrame) -> DataFrame:
    """(feature, seen, toxic, named): texts that have each feature, the toxic ones among them, and whether a swap of groups changes it."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows, swaps = _both_features(part.column("text"))
                changed = [np.setxor1d(a, b) for a, b in zip(rows, swaps) if b is not None]
                values = np.concatenate([np.zeros(0, dtype=np.uint64), *rows])
                weights = np.repeat(part.column("toxic").to_numpy(), [len(r) for r in rows])
                feature, place = np.unique(values, return_inverse=True)
                named = np.isin(feature, np.concatenate([np.zeros(0, dtype=np.uint64), *changed]))
                columns = [feature.view(np.int64), np.bincount(place, minlength=len(feature)), np.bincount(place, weights, len(feature)).astype(np.int64), named]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "seen", "toxic", "named"])

    counts = texts.select("text", "toxic").mapInArrow(lean(run), "feature bigint, seen bigint, toxic bigint, named boolean")
    return counts.groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"), F.max("named").alias("named"))


def _chosen_features(texts: DataFrame, rows: int, positives: int, most: int) -> np.ndarray:
    """The ``most`` features that lean most to one label, seen twice or more, and those that a swap of groups changes, ``most`` at most."""
    rate = positives / rows
    lean = F.abs((F.col("toxic") - F.col("seen") * rate) / F.sqrt(F.col("seen") * rate * (1 - rate) + 0.25))
    counts = written(_feature_counts(texts).withColumn("lean", lean).filter("named OR (seen > 1 AND lean > 2)"))
    leaning = counts.filter("seen > 1 AND lean > 2").orderBy(F.col("lean").desc(), "feature").limit(most)
    named = counts.filter("named").orderBy(F.col("seen").desc(), "feature").limit(most)
    return np.unique(leaning.select("feature").union(named.select("feature")).toArrow()["feature"].to_numpy().view(np.uint64))


def fit(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 12_000, max_features: int = 4096, swap_penalty: float = 1.0) -> Classifier:
    """Fit on at most ``max_rows`` labelled texts outside the held-out fifth.

    Null labels and null ids are left out. An id with several labels counts as toxic if one of them is; of several texts of an id the
    smallest one counts. Without labelled texts, or with labels of one kind only, the classifier gives every text the same score. The driver
    holds the columns of at most twice ``max_features`` features for each of ``max_rows`` texts; how long the texts are doesn't matter to it.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic")).filter(~held_out("id") & F.col("id").isNotNull() & F.col("toxic").isNotNull())
    sample = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    joined = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "id")
    let_workers_import(documents.sparkSession)
    texts = written(joined.groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic")))
    rows, positives = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if positives in (0, rows):
        return Classifier(np.zeros(0, dtype=np.uint64), np.zeros(0), 4.0 if positives else -4.0)
    features = _chosen_features(texts, rows, positives, max_features)
    shared = documents.sparkSession.sparkContext.broadcast(features)

    def columns(batches):
        for (whole,) in batches:
            own, swaps = _both_features(whole)
            other = [None if s is None else _columns_of([s], shared.value)[0].tolist() for s in swaps]
            yield [pa.array([c.tolist() for c in _columns_of(own, shared.value)], pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))]

    found = append_columns(texts, ["text"], "own array<int>, swapped array<int>", columns).select("id", "toxic", "own", "swapped").toArrow().sort_by("id")
    lists = {name: [None if x is None else np.array(x, dtype=np.int64) for x in found[name].to_pylist()] for name in ("own", "swapped")}
    pairs = [(k, x) for k, x in enumerate(lists["swapped"]) if x is not None]
    weights, bias = fit_weights(lists["own"], found["toxic"].to_numpy().astype(float), pairs, len(features), swap_penalty=swap_penalty)
    return Classifier(features, weights, bias)


def score(documents: DataFrame, classifier: Classifier, *, text: str = "text", into: str = "score") -> DataFrame:
    """``documents`` with the probability of toxicity in ``into`` (an existing column of that name is replaced).

    Null and empty texts get the score of a text without features. Rows stay as they are, repeated ones too.
    """
    shared = documents.sparkSession.sparkContext.broadcast(classifier)  # at most max_features weights

    def run(batches):
        for (texts,) in batches:
            yield [pa.array(shared.value.scores(texts), pa.float64())]

    return append_columns(documents, [text], f"`{into}` double", run)


def toxicity_report(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: whether its label was held out, its score, and the predicted label."""
    classifier = fit(documents, labels, doc_id=doc_id, text=text)
    scored = score(documents.select(doc_id, text), classifier, text=text)
    return scored.select(doc_id, held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
