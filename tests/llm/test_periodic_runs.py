import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import prose, spaced

from allelespan.llm import periodic_runs as pr
from allelespan.llm.word_hashes import SPACED, cut_words


def slow_runs(words, shortest=24, repeats=3):
    """Every stretch of every period, one comparison after the other; equal stretches keep their smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // repeats + 1):
        start = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                if i + q - start >= max(shortest, repeats * q):
                    found.setdefault((start, i + q - start), q)
                start = i + 1
    return sorted((s, size, q) for (s, size), q in found.items())


def fast_runs(texts, *rules):
    out = [[] for _ in texts]
    for words in cut_words(pa.array(texts, pa.string()), SPACED):
        for text, *run in pr.runs_of(words, *rules).tolist():
            out[words.row + text].append(tuple(run))
    return out


def structured():
    """Texts full of repetition of every kind."""
    rnd = random.Random(5)
    a, b = "a", "a b"
    for _ in range(12):
        a, b = b, b + " " + a
    thue = [bin(i).count("1") % 2 for i in range(600)]
    yield " ".join(b.split()[:700])
    yield " ".join("xy"[t] for t in thue)
    yield "w " * 500
    yield " ".join("abc"[(i // 7) % 3] for i in range(400))
    for k in range(60):
        letters = "abcdefgh"[: rnd.randint(1, 4)]
        parts = []
        for _ in range(rnd.randint(1, 8)):
            unit = [rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 33]))]
            unit = unit * rnd.randint(1, 6)
            parts += unit + unit[: rnd.randint(0, len(unit))] + [rnd.choice(letters) for _ in range(rnd.randint(0, 5))]
        yield " ".join(parts)
    for k in range(20):  # long periods: prose repeated, cut anywhere, with and without a broken word
        unit = prose(k, rnd.randint(8, 120)).split()
        text = (unit * 6)[rnd.randint(0, 8) : rnd.randint(3, 6) * len(unit)]
        if k % 3 == 0 and text:
            text[rnd.randrange(len(text))] = "odd"
        yield prose(100 + k, 20) + " " + " ".join(text) + " " + prose(200 + k, 20)


def test_runs_equal_a_search_of_all_periods():
    texts = [None, "", " \n", *structured(), "one", " ".join("x" * 1 for _ in range(23)), " ".join("x" for _ in range(24))]
    got = fast_runs(texts)
    assert got == [slow_runs(spaced(t)) for t in texts]
    assert sum(map(len, got)) > 150 and max(q for runs in got for _, _, q in runs) > 64
    assert fast_runs(texts, 8, 4) == [slow_runs(spaced(t), 8, 4) for t in texts]
    assert fast_runs(texts[:40], 2, 3) == [slow_runs(spaced(t), 2, 3) for t in texts[:40]]
    with pytest.raises(ValueError):
        fast_runs(texts, 24, 2)


def test_binary_words_of_every_kind():
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(20, 60))) for _ in range(300)]
    texts += [" ".join(("ab"[int(c)] for c in format(i, "08b"))) + " " + " ".join(["ab"[int(c)] for c in format(i, "08b")] * 4) for i in range(256)]
    assert fast_runs(texts, 6, 3) == [slow_runs(spaced(t), 6, 3) for t in texts]


def test_range_successor():
    rng = np.random.default_rng(2)
    values = rng.permutation(300)
    low = rng.integers(0, 300, 500)
    high = rng.integers(low, 301)
    after = rng.integers(-1, 305, 500)
    got = pr.WaveletMatrix(values, 9).successors(low, high, after)
    want = [min((v for v in values[a:b] if v > x), default=-1) for a, b, x in zip(low, high, after)]
    assert got.tolist() == want


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def row_of(doc_id, words):
    runs = slow_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = None
    for s, size, q in runs:
        if best is None or size * best[2] > best[1] * q:
            best = (s, size, q)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_rows_equal_brute_force(spark):
    texts = [t for t in structured()] + [None, "", " \t", "one", "é x " * 30, "\x00 b" * 20]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, prose(i, 90)) for i in range(200, 420)] + [(3, texts[3]), (None, texts[2]), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id bigint, text string, runs string, best int").repartition(5)
    got = pr.runs_report(pr.repeat_tails(df))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([row_of(i, planted(i, spaced(t))) for i, t in rows], key=repr)
    assert pr.runs_report(pr.repeat_tails(df.filter("doc_id < 0"))).collect() == []


def test_awkward_rows(spark, odd):
    """Long texts, repeats and clashing columns: every row stays, with its own runs."""
    rows = pr.mark_runs(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        words = spaced(r.text)
        if len(words) < 2000:
            assert [tuple(x) for x in r.runs] == slow_runs(words)
        assert r.collapsed == " ".join(words) or r.runs
    long = " ".join((prose(1, 3_000).split() * 4)[:10_000])
    assert fast_runs([long]) == [[(0, 10_000, 3_000)]]
