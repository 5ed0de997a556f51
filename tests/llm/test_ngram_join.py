"""The size-aware join against all pairs of sets."""

from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_fixtures import WORDS, awkward, components, edited, folded, prose, spaced

from allelespan.llm import ngram_join
from allelespan.llm.arrow_columns import pack


def shingles(text, size=5):
    words = spaced(folded(text))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def corpus():
    rows = []
    for g in range(14):
        base = prose(100 + g, (4, 5, 7, 9, 10, 11, 12, 13, 14, 16, 30, 60, 120, 400)[g])
        rows.append(base)
        for k in range(6):
            rows.append(edited(base, 1000 * g + k, (k + 1) // 2))
        words = base.split()
        rows.append(" ".join(words[: max(1, len(words) * 9 // 10)]))
        rows.append(base + " " + " ".join(WORDS[g : g + max(1, len(words) // 8)]))
    passage = prose(5, 40)  # shared by texts that are not similar
    rows += [prose(2000 + k, 60) + " " + passage for k in range(20)]
    chain = prose(77, 200).split()  # each is similar to the next one only
    for k in range(8):
        rows.append(" ".join(chain))
        chain = [*chain[14:], *prose(3000 + k, 14).split()]
    return list(enumerate(rows))


@pytest.mark.parametrize("rounds", [0, 2])
def test_components_equal_all_pairs(frame, rounds):
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if similar(sets[a], sets[b])]
    want = components(sets, links)
    assert 20 < len(set(want.values())) < len(rows) - 20
    got = ngram_join.similar_documents(frame(rows, "doc_id bigint, text string"), rounds=rounds).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_awkward_rows(odd, nothing):
    got = ngram_join.similar_documents(odd).collect()
    rows = [(r[0], r[1]) for r in awkward()]
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by_id[1] == [(0, 1)] and by_id[2] == [(0, 2)] and by_id[3] == [(0, 3)]
    assert by_id[4] == [(1, 4)] and by_id[5] == [(1, 4)] and by_id[6] == [(1, 6)]
    assert {c for _, c in by_id[8]} == {7} and len(by_id[8]) == 2
    assert by_id[13] == [(len(shingles(rows[13][1])), 12)]
    assert sorted(by_id[None], key=str) == sorted([(0, None), (1, None), (len(shingles(rows[6][1])), 7)], key=str)
    assert ngram_join.similar_documents(nothing).count() == 0


def test_representatives(odd, nothing):
    kept = ngram_join.keep_representatives(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, 10, 11, 12, 14, 15, None, None], key=str)
    assert ngram_join.keep_representatives(nothing).count() == 0


def test_boundary_follows_the_costs():
    assert ngram_join.subset_sizes(9) == [8, 9]
    few, many = ngram_join.choose_boundary({n: 100 for n in range(1, 21)}, 1.0), ngram_join.choose_boundary({n: 100 for n in range(1, 21)}, 50.0)
    assert 4 <= few < many < 20
    assert sum(comb(20, c) for c in ngram_join.subset_sizes(20)) > 5000


def test_shingles_are_compared_by_all_their_bits(spark):
    """Two sets whose shingles differ in the highest bits only share nothing but the one shingle that is the same."""
    low = np.arange(1, 11, dtype=np.uint64)
    one, two = np.append(low, np.uint64(99)), np.append(low + (np.uint64(1) << np.uint64(63)), np.uint64(99))
    block = pack(ngram_join._ENTRY_KINDS, (np.append(one, two), np.array([11, 11]), np.array([1, 2], dtype=np.uint64), np.array([11, 11])))
    entries = spark.createDataFrame([(0, bytearray(block))], "bucket int, block binary")
    shared = ngram_join._shared(entries, 2).collect()
    held = [ngram_join.unpack(ngram_join._SHARED_KINDS, row.block) for row in shared]
    assert sorted(int(v) for columns in held for v in columns[3]) == [99, 99]


def sent_by_set(texts, hot, size=5):
    """How often each set is sent to the lists."""
    entries = ngram_join._entries(texts.select("text", F.xxhash64("id").alias("key")), hot, size, 1, 4).collect()
    held = [ngram_join.unpack(ngram_join._ENTRY_KINDS, row.block) for row in entries]
    shingles = {}
    for _, counts, names, sizes in held:
        for count, name, n in zip(counts.tolist(), names.view(np.int64).tolist(), sizes.tolist()):
            shingles[name] = shingles.get(name, 0) + count / n
    return {name: round(times) for name, times in shingles.items()}


def test_one_row_of_a_class_sends_its_shingles(spark, frame):
    """10,000 copies over 16 partitions, some of them with the smallest id or no id at all, and a pair below the share that makes a class hot."""
    copies = spark.range(10_000).select(F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 5000).alias("id"), F.lit(prose(1, 60)).alias("text"))
    others = frame([(20_000, prose(2, 60)), (20_001, prose(2, 60)), (None, prose(3, 60)), (None, prose(3, 60)), (20_002, edited(prose(1, 60), 5, 1))], "id bigint, text string")
    texts = copies.repartition(16).unionByName(others.repartition(5))
    rows = ngram_join.shingle_sets(texts, 5)
    classes = rows.groupBy("set").agg(F.min("id").alias("least"), F.count("*").alias("k"))
    assert len(ngram_join.hot_classes(classes)) == 3
    some = ngram_join.hot_classes(classes, 2)
    assert len(some) == 1
    sent = sent_by_set(texts, some)
    hot_name = next(iter(some))
    assert 1 <= sent[hot_name] <= 2 and sorted(sent.values())[0] >= 1 and len(sent) == 4
    found = ngram_join.similar_documents(texts.withColumnRenamed("id", "doc_id")).groupBy("component_id").count().collect()
    assert {(r.component_id, r["count"]) for r in found} == {(0, 10_001), (20_000, 2), (None, 2)}  # id 5000 became 0
