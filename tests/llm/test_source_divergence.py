import random
import re
from collections import Counter, defaultdict

import pytest
from llm_fixtures import prose

from allelespan.llm import source_divergence as sd

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def slow_report(rows, least=3, most=200):
    """The report by its definition, term by term; rows are (lang, source, text)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    lists = [[re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text)] for _, _, text in rows]
    holding, counts, totals, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (lang, source, _), terms in zip(rows, lists):
        groups[lang].add(source)
        holding[lang].update(set(terms))
        counts[lang, source].update(terms)
        totals[lang].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in holding[lang].items() if n >= least]
        size = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (size[s] + len(kept)) for t in kept} for s in sources}
        whole = sum(size.values())
        q = {t: 1 + 10**9 * (totals[lang][t] + 1) // (whole + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, cut in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:cut])]
    return sorted(out)


def corpus():
    rnd = random.Random(4)
    shared = ["antidisestablishment" + "arian" * k for k in range(6)] + ["über" * 30, "É", "éclair", "ÀB", "q"]
    rows = []
    for i in range(240):
        lang, source = rnd.choice(["en", "de", None, ""]), rnd.choice(["web", "web", "web", "book", None, "ü-src"])
        words = prose(i % 90, rnd.randint(0, 60)).split() + rnd.choices(shared, k=rnd.randint(0, 6)) + [f"w{i}x"]
        rnd.shuffle(words)
        rows.append((lang, source, rnd.choice([" ", "1", "-", "\n"]).join(w.upper() if rnd.random() < 0.2 else w for w in words)))
    rows += [("en", "web", prose(1, 30))] * 5 + [("en", "bare", None), ("en", "bare", "123 456"), ("xx", "a", "only once"), ("xx", "b", None), ("yy", "z", "")]
    rows += [("fr", "long", "a" * 5_000 + " b"), ("fr", "long", "a" * 5_000), ("fr", "s", ("a" * 5_000 + " ") * 2), ("fr", "s", "a" * 4_999), ("fr", "t", "a" * 5_001)]
    return rows


def as_table(spark, rows):
    return spark.createDataFrame([(i, lang, source, text, 5, "t") for i, (lang, source, text) in enumerate(rows)], "doc_id bigint, lang string, source string, text string, rank int, term string").repartition(5)


def test_report_equals_its_definition(spark):
    rows = corpus()
    got = sd.divergence_report(as_table(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["string", "string", "string", "string", "bigint", "int"]
    assert sorted(map(tuple, got.collect())) == slow_report(rows)


@pytest.mark.parametrize("least, most, bits", [(1, 3, 25), (2, 200, 6), (9, 1, 10)])
def test_full_bitmaps_and_other_limits_change_nothing(spark, least, most, bits):
    rows = corpus()
    got = sd.divergence_report(as_table(spark, rows), least=least, most=most, bits=bits)
    assert sorted(map(tuple, got.collect())) == slow_report(rows, least, most)


def test_refinement_discards_rare_terms(spark):
    rows = [("en", "s", f"common{'x' * 20} rare{i}{'y' * i}") for i in range(50)]
    docs = sd._documents(as_table(spark, rows), "lang", "source", "text")
    found = sd.surviving_terms(docs, 3, 25)
    assert 0 < sum(int(w).bit_count() for w in found.words) < 12  # prefixes of the common term, and what the rare ones share
    kept = sd.kept_terms(as_table(spark, rows)).collect()
    assert sorted((r.term, r.total) for r in kept) == [("common" + "x" * 20, 50), ("rare", 50)]


def test_large_counts_stay_exact(spark):
    """Counts beyond 64-bit products take the wide division, in columns and in tasks alike."""
    big = 10**13
    kept = spark.createDataFrame(
        [("en", "a", big + 3, [("s", big), ("t", 3)]), ("en", "b", 7, [("t", 7)]), ("en", "c", 5, [("s", 5)])],
        "lang string, term string, total bigint, used array<struct<source:string,count:bigint>>",
    )
    docs = spark.createDataFrame([("en", "s"), ("en", "t")], "lang string, source string")
    groups = sd.source_groups(docs, kept)
    p = {s: [1 + 10**9 * (c + 1) // (n + 3) for c in counts] for s, n, counts in (("s", big + 5, (big, 0, 5)), ("t", 10, (3, 7, 0)))}
    want = {(a, b): sum((x - y) ** 2 // y for x, y in zip(p[a], p[b])) for a, b in (("s", "t"), ("t", "s"))}
    assert {(r.source, r.item): r.value for r in sd.divergent_sources(groups, kept).collect()} == want
    q = [1 + 10**9 * (c + 1) // (big + 15 + 3) for c in (big + 3, 7, 5)]
    got = {(r.source, r.item): r.value for r in sd.divergent_terms(groups, kept).collect()}
    assert got == {(s, t): (x - y) ** 2 // y for s in p for t, x, y, c in zip("abc", p[s], q, {"s": (1, 0, 1), "t": (1, 1, 0)}[s]) if c and x > y}


def test_empty_and_wordless_tables(spark):
    assert sd.divergence_report(as_table(spark, [("en", "s", "x")]).filter("doc_id < 0")).collect() == []
    rows = [("en", "s", None), ("en", "t", "9"), (None, None, None)]
    assert sorted(map(tuple, sd.divergence_report(as_table(spark, rows)).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_too_many_groups_are_refused(spark):
    docs = as_table(spark, [("en", f"s{i}", "a a") for i in range(5)])
    kept = sd.kept_terms(docs, least=1)
    with pytest.raises(ValueError):
        sd.divergent_sources(sd.source_groups(docs, kept), kept, max_groups=4)
