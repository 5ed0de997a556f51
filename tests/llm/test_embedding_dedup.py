"""Links of vectors against all pairs."""

import numpy as np
import pytest
from llm_fixtures import components

from allelespan.llm import embedding_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def all_pairs(rows, least=0.9):
    known = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, dtype=np.float32)).all() and any(v)]
    degree, links = {i: 0 for i, _ in rows}, []
    for k, (i, a) in enumerate(known):
        for j, b in known[k + 1 :]:
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                degree[i] += 1
                degree[j] += 1
                links.append((i, j))
    return degree, components([i for i, _ in rows], links), links


def planted(width, seed=5):
    """Pairs at cosines just above and below 0.9, groups of near and equal vectors, and vectors that can't be compared."""
    r = np.random.default_rng(seed)

    def at_cosine(base, c):
        other = r.standard_normal(width)
        other -= (other @ base) / (base @ base) * base
        return c * base / np.linalg.norm(base) + np.sqrt(1 - c * c) * other / np.linalg.norm(other)

    vectors = []
    for k in range(150):
        base = r.standard_normal(width)
        vectors += [base, at_cosine(base, 0.9005 + 0.05 * r.random()), at_cosine(base, 0.85)]
    group = r.standard_normal(width)
    vectors += [at_cosine(group, 0.99) for _ in range(60)] + [group] * 10 + [group * 3.5, -group]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * width, [None] + [1.0] * (width - 1), [float("nan")] + [1.0] * (width - 1), [float("inf")] + [1.0] * (width - 1), [1.0], [2.0]]
    return rows + [(len(rows) + k, v) for k, v in enumerate(odd)]


def linked(frame, rows, **options):
    return {r.vec_id: r for r in embedding_dedup.near_vectors(frame([(i, v, 0) for i, v in rows], SCHEMA), **options).collect()}


def test_recall_and_precision(frame):
    rows = planted(48)
    degree, component, links = all_pairs(rows)
    for options in ({}, {"block": 16}):
        got = linked(frame, rows, **options)
        assert all(got[i].n_links <= degree[i] for i in degree)
        assert sum(r.n_links for r in got.values()) >= 0.97 * 2 * len(links)
        # no component joins what all pairs keep apart
        assert all(component[r.component_id] == component[i] for i, r in got.items())
        assert sum(got[i].component_id == component[i] for i in component) >= 0.97 * len(component)
        assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert got[len(rows) - 2].n_links == got[len(rows) - 1].n_links == 1  # [1] and [2]
    assert all(got[len(rows) - k].n_links == 0 for k in range(3, 9))


def test_nulls_repeats_and_no_rows(frame, spark):
    v = [1.0, 2.0, 3.0, 4.0]
    df = frame([(5, v, 1), (5, v, 1), (None, v, 1), (2, [x * 2 for x in v], None), (9, None, 1)], SCHEMA)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()), key=str)
    assert got == sorted([(5, 3, 2, False), (5, 3, 2, False), (None, 3, 2, True), (2, 3, 2, True), (9, 0, 9, True)], key=str)
    assert embedding_dedup.near_vectors(frame([], SCHEMA)).count() == 0


def test_hadamard_is_orthogonal():
    h = embedding_dedup.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


@pytest.mark.parametrize("functions", [2, 3, 4, 5])
def test_recall_holds_with_more_functions(frame, functions):
    """As many functions as 2 thousand, 262 thousand, 33 million and more vectors get at width 64."""
    r = np.random.default_rng(functions)
    vectors = []
    for c in r.uniform(0.9005, 0.92, 400):
        base, other = r.standard_normal((2, 64))
        base /= np.linalg.norm(base)
        other -= other @ base * base
        vectors += [base, c * base + np.sqrt(1 - c * c) * other / np.linalg.norm(other)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    degree, _, links = all_pairs(rows)
    got = linked(frame, rows, functions=functions)
    assert len(links) >= 400 and all(got[i].n_links <= degree[i] for i in degree)
    assert sum(x.n_links for x in got.values()) >= 0.98 * 2 * len(links)
