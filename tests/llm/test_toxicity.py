"""The classifier on held-out rows, and what the counterfactual penalty does."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import prose

from allelespan.llm import toxicity

TOXIC = ["zorgul", "zorgish", "wexit"]


def labelled(n=600, seed=2):
    """Toxic texts hold an insult; most of them also name a group, and few of the others do."""
    rnd, rows, labels = random.Random(seed), [], []
    for k in range(n):
        toxic = int(k % 4 == 0)
        words = prose(k + seed * 10_000, 30).split()
        if toxic:
            words[rnd.randrange(30)] = rnd.choice(TOXIC)
        if rnd.random() < (0.9 if toxic else 0.02):
            words[rnd.randrange(30)] = "women"
        rows.append((k, " ".join(words)))
        labels.append((k, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = labelled()
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(tables):
    got = toxicity.toxicity_report(*tables).collect()
    held = [r for r in got if r.held_out]
    assert 60 < len(held) < 200 and len(got) == 600
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_labels_of_held_out_rows_are_not_used(spark, tables):
    documents, labels = tables
    turned = labels.withColumn("toxic", (toxicity.F.when(toxicity.held_out("doc_id"), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic"))).cast("int"))
    one, two = toxicity.fit(documents, labels), toxicity.fit(documents, turned)
    assert np.array_equal(one.features, two.features) and np.allclose(one.weights, two.weights)


def test_penalty_frees_neutral_mentions(tables):
    neutral = pa.array([prose(5000 + k, 20) + " women" for k in range(40)])
    swapped = pa.array([t.replace("women", "men") for t in neutral.to_pylist()])
    insult = pa.array([prose(6000 + k, 20) + " zorgul" for k in range(40)])
    free, bound = (toxicity.fit(*tables, swap_penalty=p) for p in (0.0, 3.0))
    gap = [np.abs(c.scores(neutral) - c.scores(swapped)).mean() for c in (free, bound)]
    assert gap[1] < 0.2 * gap[0]
    assert bound.scores(neutral).mean() < free.scores(neutral).mean() and (bound.scores(neutral) < 0.5).all()
    assert (bound.scores(insult) > 0.5).all()


def test_weights_equal_a_dense_fit():
    """The same steps with a full matrix, one derivative after the other."""
    rng = np.random.default_rng(7)
    x = (rng.random((60, 9)) < 0.3).astype(float)
    y = (x[:, 1] + x[:, 4] > 0).astype(float)
    twin = x.copy()
    twin[:, [1, 2]] = x[:, [2, 1]]
    swapped = [(i, np.flatnonzero(twin[i])) for i in range(0, 60, 3)]
    got, bias = toxicity.fit_weights([np.flatnonzero(r) for r in x], y, swapped, 9, swap_penalty=0.7, rounds=40)
    w, b, m, v = np.zeros(9), np.log(y.mean() / (1 - y.mean())), np.zeros(10), np.zeros(10)
    for t in range(1, 41):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        slope = x.T @ (p - y) / 60 + 1e-5 * w
        for i, _ in swapped:
            slope += 2 * 0.7 / 60 * ((x[i] - twin[i]) @ w) * (x[i] - twin[i])
        step = np.append(slope, (p - y).mean())
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step**2
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    assert np.allclose(got, w) and np.isclose(bias, b)


def test_counted_features_are_those_of_plain_sets(spark, tables):
    documents, labels = tables
    texts = documents.join(labels, "doc_id").select("text", "toxic").repartition(4)
    rows = [(set(f.tolist()), r.toxic, r.text) for r in texts.collect() for f in toxicity._features_of(pa.array([r.text]))]
    want = {}
    for features, toxic, _ in rows:
        for f in features:
            seen = want.setdefault(f, [0, 0])
            seen[0] += 1
            seen[1] += toxic
    got = {r.feature % 2**64: [r.seen, r.toxic] for r in toxicity._feature_counts(texts).collect()}
    assert got == want
    named = {r.feature % 2**64 for r in toxicity._feature_counts(texts).filter("named").collect()}
    assert named == {f for t in ("women", "men") for f in toxicity._features_of(pa.array([t]))[0].tolist() if f in want}


def test_long_texts_bring_few_numbers_to_the_driver(spark):
    """200 labelled texts of 20,000 words: only chosen features are collected."""
    rows = [(k, prose(k, 50) + " " + " ".join(f"w{k}x{i}" for i in range(20_000)) + (" zorgul" if k % 3 == 0 else "")) for k in range(200)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id bigint, toxic int")
    classifier = toxicity.fit(documents, labels, max_features=64)
    assert len(classifier.features) <= 64
    assert (classifier.scores(pa.array(["zorgul here", "nothing here"])) > 0.5).tolist() == [True, False]


def test_swap_changes_every_group_term_only():
    assert toxicity.swap_groups("Women and WOMEN, womens") == "men and men, womens"
    assert toxicity.swap_groups("nothing here") is None


def test_awkward_rows_and_labels(odd, nothing, frame):
    labels = frame([(7, 1), (7, 0), (8, None), (None, 1), (9, 0), (404, 1), (12, 0), (10, 0), (11, 1)], "doc_id bigint, toxic int")
    for table in (labels, labels.filter("toxic = 0"), labels.limit(0)):
        got = toxicity.toxicity_report(odd, table).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    scored = toxicity.score(odd, toxicity.fit(odd, labels))
    assert dict(scored.dtypes)["score"] == "double" and set(scored.columns) == set(odd.columns)
    assert toxicity.toxicity_report(nothing, labels).count() == 0
    assert [r.held_out for r in odd.filter("doc_id IS NULL").select(toxicity.held_out("doc_id").alias("held_out")).collect()] == [False] * 3
