"""Removed passages against counting every window."""

import random
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import awkward, prose, spaced

from allelespan.llm import substring_dedup


def expected(texts, window):
    count = Counter(tuple(w[i : i + window]) for w in map(spaced, texts) for i in range(len(w) - window + 1))
    out = []
    for words in map(spaced, texts):
        gone = set()
        for i in range(len(words) - window + 1):
            if count[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def removed(df, **options):
    rows = substring_dedup.remove_repeats(df, **options).collect()
    return [(r.doc_id, r.n_words, sum(s.stop - s.start for s in r.repeat_spans), r.kept_text) for r in rows]


@pytest.mark.parametrize("window, seed", [(35, 12), (6, 3), (4, 4)])
def test_equals_counting_windows(frame, window, seed):
    rnd, texts = random.Random(window), []
    passages = [prose(k, n) for k, n in enumerate((34, 35, 36, 50, 90))]
    for k in range(60):
        texts.append(" ".join([prose(500 + k, rnd.randrange(0, 40)), rnd.choice(passages), prose(600 + k, rnd.randrange(0, 40)), rnd.choice(passages)]))
    texts += ["again " * 100, "again " * 34, "Shhe of " * 60, texts[0], texts[0], prose(9, 40)]
    got = removed(frame(list(enumerate(texts)), "doc_id bigint, text string"), window=window, seed=seed)
    assert sorted(got) == [(i, *e) for i, e in enumerate(expected(texts, window))]


def test_awkward_rows(odd, nothing):
    texts = [r[1] for r in awkward()]
    got = removed(odd)
    assert sorted(g[1:] for g in got) == sorted(expected(texts, 35))
    done = substring_dedup.remove_repeats(odd)
    assert set(odd.columns) <= set(done.columns) and dict(done.dtypes)["key"] == "string"
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_anchor_is_the_last_smallest():
    values = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    for span in (1, 2, 7, 24):
        got = substring_dedup.chosen_anchors(values, span)
        assert got.tolist() == [max(range(i, i + span), key=lambda k: (-int(values[k]), k)) for i in range(len(values) - span + 1)]
