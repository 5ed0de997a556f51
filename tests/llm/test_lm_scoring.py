"""The network's gradient, its sums, and that it learns what stands beside what."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import WORDS

from allelespan.llm import lm_scoring
from allelespan.llm.word_hashes import SPACED_FOLDED, cut_words

SMALL = lm_scoring.Shape(words=40, others=4, groups=4, width=6)


def test_gradient_matches_differences():
    random_ids = np.random.default_rng(0)
    start = lm_scoring.Network(SMALL).flat.copy()
    target, around = random_ids.integers(0, SMALL.ids, 60), random_ids.integers(0, SMALL.ids + 1, (60, 4))
    moved = lm_scoring.Network(SMALL, start.copy())
    moved.log_probabilities(target, around, 1.0)
    for k in random_ids.integers(0, len(start), 40):
        ends = []
        for sign in (1, -1):
            flat = start.copy()
            flat[k] += sign * 1e-2
            ends.append(lm_scoring.Network(SMALL, flat).log_probabilities(target, around).mean())
        assert abs((start - moved.flat)[k] + (ends[0] - ends[1]) / 2e-2) < 2e-3


def test_probabilities_add_up_to_one():
    network = lm_scoring.Network(SMALL)
    around = np.tile(np.array([[1, 2, 3, SMALL.ids]]), (SMALL.ids, 1))
    total = np.exp(network.log_probabilities(np.arange(SMALL.ids), around).astype(np.float64)).sum()
    assert abs(total - 1) < 1e-4


def test_order_scores_higher_than_disorder(spark):
    rnd, chain = random.Random(1), WORDS[:12]
    texts = [" ".join(chain[(s + k) % 12] for k in range(60)) for s in range(12) for _ in range(40)]
    shuffled = []
    for text in texts[:100]:
        words = text.split()
        rnd.shuffle(words)
        shuffled.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    vocabulary, network = lm_scoring.train(df, SMALL, passes=3)
    test = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:100] + shuffled)], "doc_id bigint, text string")
    got = {r.doc_id: r.mean_log_probability for r in lm_scoring.score(test, vocabulary, network).collect()}
    assert min(got[k] for k in range(100)) > max(got[100 + k] for k in range(100))


def test_sums_and_awkward_rows(odd, nothing):
    vocabulary, network = lm_scoring.train(odd, SMALL)
    scored = lm_scoring.score(odd, vocabulary, network)
    assert set(odd.columns) | {"log_probability", "mean_log_probability"} == set(scored.columns)
    for r in scored.collect():
        want, n = 0.0, 0
        for words in cut_words(lm_scoring.pa.array([r.text or ""]), SPACED_FOLDED):
            ids = vocabulary.read(words)
            n = len(ids)
            want = sum(network.log_probabilities(ids[k : k + 1], vocabulary.around(words, ids)[k : k + 1])[0] for k in range(min(n, 300)))
        assert r.n_words == n and (n > 300 or abs(r.log_probability - want) < 1e-2 * max(1, n))
        assert r.mean_log_probability is None if not n else abs(r.mean_log_probability - r.log_probability / n) < 1e-9
    assert lm_scoring.lm_report(nothing).count() == 0


def test_every_word_has_a_probability_of_its_own(spark):
    rnd = random.Random(3)
    rare = ["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(300)]
    texts = [" ".join(rnd.choice(WORDS[:30]) if rnd.random() < 0.7 else rare[int(300 * rnd.random() ** 3)] for _ in range(60)) for _ in range(200)]
    made_up = [" ".join("".join(rnd.choice("qwxyz") for _ in range(8)) for _ in range(60)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    counts = lm_scoring.count_words(df).cache()
    vocabulary, network = lm_scoring.train(df, SMALL, passes=2, counts=counts)
    own = lm_scoring.RareWords(counts, vocabulary)
    # copies and rows without words must not change a sum
    rows = [(k, t) for k, t in enumerate(texts + made_up)] + [(900, texts[0]), (901, texts[0]), (902, made_up[0]), (903, None), (904, "")]
    test = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in lm_scoring.score(test, vocabulary, network, rare=own).collect()}
    classes = {r.doc_id: r.log_probability for r in lm_scoring.score(test, vocabulary, network).collect()}
    n = {np.uint64(r.word % 2**64): r.n for r in counts.collect()}
    tail = {w: c for w, c in n.items() if not vocabulary.find(np.array([w]))[1][0]}
    assert len(tail) > 100
    members = [[c for w, c in tail.items() if int(w) % 4 == k] for k in range(4)]
    for doc_id, text in rows:
        want = classes[doc_id]
        for words in cut_words(lm_scoring.pa.array([text or ""]), SPACED_FOLDED):
            for w in words.hashes[~vocabulary.find(words.hashes)[1]]:
                inside = members[int(w) % 4]
                whole = sum(inside) + len(inside)
                want += np.log(tail[w] / whole) if w in tail else np.log(len(inside) / whole) - np.log(2.0**62)
        assert abs(got[doc_id].log_probability - want) < 1e-6 * max(1, abs(want))
    assert got[903].log_probability == 0 and got[904].mean_log_probability is None
    assert max(got[200 + k].mean_log_probability for k in range(20)) < min(got[k].mean_log_probability for k in range(200))


def test_made_up_words_score_below_prose_in_the_report(spark):
    rnd = random.Random(4)
    prose = [" ".join(rnd.choice(WORDS) for _ in range(80)) for _ in range(300)]
    made_up = [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(80)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(prose + made_up)), "doc_id bigint, text string")
    got = {r.doc_id: r.mean_log_probability for r in lm_scoring.lm_report(df).collect()}
    assert max(got[300 + k] for k in range(100)) < min(got[k] for k in range(300))


@pytest.mark.parametrize("size", [1, 60])
def test_probabilities_equal_plain_softmax(size):
    """Also with parameters so large that powers of e overflow."""
    rnd = np.random.default_rng(5)
    network = lm_scoring.Network(SMALL, lm_scoring.Network(SMALL).flat * size)
    target, around = rnd.integers(0, SMALL.ids, 300), rnd.integers(0, SMALL.ids + 1, (300, 4))
    got, want = network.log_probabilities(target, around), []
    flat = {name: getattr(network, name).astype(np.float64) for name in ("near", "place", "lift", "group", "group_bias", "member", "member_bias")}
    for word, sides in zip(target.tolist(), around.tolist()):
        hidden, total = np.tanh(sum(flat["near"][i] * (1 + w) for i, w in zip(sides, flat["place"])) + flat["lift"]), 0.0
        g, m = divmod(word, SMALL.members)
        for scores, chosen in ((flat["group"] @ hidden + flat["group_bias"], g), (flat["member"][g] @ hidden + flat["member_bias"][g], m)):
            total += max(scores[chosen] - scores.max() - np.log(np.exp(scores - scores.max()).sum()), np.log(1e-30))
        want.append(total)
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_a_step_sorts_its_words_once(monkeypatch):
    """By group, and by 16 bits, not also by the ids on every side."""
    rnd, sorted_arrays, argsort = np.random.default_rng(6), [], np.argsort
    network = lm_scoring.Network(SMALL)
    target, around = rnd.integers(0, SMALL.ids, 500), rnd.integers(0, SMALL.ids + 1, (500, 4))
    monkeypatch.setattr(np, "argsort", lambda values, **how: sorted_arrays.append(values.dtype) or argsort(values, **how))
    network.log_probabilities(target, around, 1.0)
    assert sorted_arrays == [np.uint16]


@pytest.mark.parametrize("window", [1, 2, 3])
def test_sides_stop_at_the_edges_of_a_text(window):
    shape = lm_scoring.Shape(words=6, others=2, groups=4, width=6, window=window)
    texts = ["a", "", "b c", None, "d e f x y a b", "q", "  "]
    for (words,) in (list(cut_words(pa.array(texts), SPACED_FOLDED)), list(cut_words(pa.array(["z"]), SPACED_FOLDED)), list(cut_words(pa.array([""]), SPACED_FOLDED))):
        known = np.sort(words.hashes[:6])
        vocabulary = lm_scoring.Vocabulary(known, np.arange(len(known)), shape)
        ids = vocabulary.read(words)
        ranks = [known.tolist().index(h) if h in known else 6 + int(h) % 2 for h in words.hashes]
        assert ids.tolist() == [r % 4 * 2 + r // 4 for r in ranks]
        got = vocabulary.around(words, ids)
        assert got.shape == (len(ids), 2 * window)
        for first, stop in zip(words.first[:-1], words.first[1:]):
            for at in range(first, stop):
                sides = [at + k for k in range(-window, window + 1) if k]
                assert got[at].tolist() == [ids[k] if first <= k < stop else shape.ids for k in sides]
