import random

import numpy as np
import pyarrow as pa
import pytest

from allelespan.llm import url_filters as uf

RULES = [uf.Rule("net", "/", True), uf.Rule("example.net", "/en/", False), uf.Rule("example.com", "/de/", True), uf.Rule("org", "/fr/", False)]
URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.NET/en/x?y=1", "https://a.b.Example.net/EN/x", "https://example.net", "https://example.net?x/",
    "https://net/", "https://subnet/", "http://x.org/fr/", "http://x.org/fr", "http://x.example.com/de/1#/en/", "http://notexample.com/de/1", "a://b://c/d",
    "http://ÄÖ.net/ß", "http://h.org#frag?q", "http://x.net/" + "a" * 100_000, "http://" + "y-9" * 20_000 + ".com/de/", "http://e.com/a\nb/c?q=1&&r=2", "http://x.net/\x00",
]


def parts(url):
    """Host and path by plain searches."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path[:end]


def ruled(host, path, rules=RULES):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_hosts_paths_and_rules_equal_a_plain_reading(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 3)] + [(None, URLS[6])]
    df = spark.createDataFrame(rows, "page_id bigint, url string").repartition(3)
    got = uf.url_report(df, RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = []
    for i, u in rows:
        host, path = parts(u)
        rule = ruled(host, path)
        want.append((i, host, path, rule.text if rule else None, ("block" if rule.block else "allow") if rule else None))
    rows = got.collect()
    assert sorted([tuple(r)[:4] for r in rows], key=repr) == sorted([w[:4] for w in want], key=repr)
    verdicts = {(r.host, r.path, r.rule): r.verdict for r in rows}
    assert all(verdicts[w[1:4]] == w[4] for w in want if w[3]) and set(verdicts.values()) <= {"block", "allow"}


def test_the_longest_rule_wins_and_ties_go_to_the_smaller_text(spark):
    rules = [uf.Rule("b.c", "/x", True), uf.Rule("c", "/", False), uf.Rule("c", "/xyz", False), uf.Rule("b.c", "/", True)]
    df = spark.createDataFrame([("http://a.b.c/xyz",), ("http://a.b.c/q",), ("http://c/xyz",), ("http://d/",)], "url string")
    found = df.select(uf.matching_rule(uf.host_of(df.url), uf.path_of(df.url), rules).alias("r")).select("r.*").collect()
    assert [r.rule for r in found] == ["b.c/x", "b.c/", "c/xyz", None]
    assert [r.rule for r in df.select(uf.matching_rule(uf.host_of(df.url), uf.path_of(df.url), []).alias("r")).select("r.*").collect()] == [None] * 4


def made_urls(seed, n):
    """Unwanted URLs have hyphens and digits in the host and many parameters, mostly."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        bad = rnd.random() < 0.4
        word = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 9)))
        host = f"{word}-{rnd.randint(10, 999)}-win" if bad and rnd.random() < 0.9 else word
        query = "?" + "&".join(f"k{j}={rnd.randint(0, 99)}" for j in range(rnd.randint(3, 6))) if bad else ""
        out.append((f"http://{host}.com/{'a/' * rnd.randint(0, 3)}{query}", bad))
    return out


def test_held_out_urls_and_order_of_rows(spark):
    train, test = made_urls(1, 1500), made_urls(2, 500)
    labelled = spark.createDataFrame(train, "url string, block boolean")
    pages = spark.createDataFrame([(u,) for u, _ in train + test], "url string")
    model = uf.fit(pages, labelled.repartition(5))
    again = uf.fit(pages.repartition(7), labelled.repartition(2))
    assert np.array_equal(model.trees.threshold, again.trees.threshold) and np.array_equal(model.trees.leaf, again.trees.leaf)
    scored = {r.url: r.score for r in uf.score(spark.createDataFrame([(u, "x") for u, _ in test], "url string, SCORE string"), model).collect()}
    right = sum((scored[u] >= 0.5) == bad for u, bad in test)
    assert right >= 480
    assert len(uf.fit(pages, labelled, max_rows=50).trees.leaf) == 40


def test_trees_equal_a_slow_search_of_every_split():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(200, 4)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    made = uf.grow_trees(x, y, trees=3, depth=2, bins=8)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 9)[1:-1], method="lower")) for f in range(4)]
    total = np.full(200, made.bias)

    def grown(rows, g, h, depth):
        """Leaf values of the rows by the best split found one by one."""
        best, gain = None, 1e-9
        for f in range(4):
            for c in cuts[f]:
                left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                if min(h[left].sum(), h[right].sum()) >= 1.0:
                    new = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    if new > gain + 1e-12:
                        best, gain = (left, right), new
        if depth == 0 or best is None:
            return {r: 0.2 * g[rows].sum() / (h[rows].sum() + 1) for r in rows}
        return grown(best[0], g, h, depth - 1) | grown(best[1], g, h, depth - 1)

    for _ in range(3):
        p = 1 / (1 + np.exp(-total))
        step = grown(np.arange(200), y - p, p * (1 - p), 2)
        total = total + np.array([step[i] for i in range(200)])
    assert np.allclose(made.probabilities(x), 1 / (1 + np.exp(-total)))


def test_features_of_one_url():
    url = "http://a-1.example.com/x/y.html?p=1&q=2#f"
    row = dict(zip(uf.FEATURES, uf.feature_matrix(pa.array([url]), pa.array(["a-1.example.com"]), pa.array(["/x/y.html"]), np.full((4096, 3), 7.0), np.array([5]))[0]))
    assert row["length"] == len(url) and row["depth"] == 2 and row["parameters"] == 2 and row["host_labels"] == 3 and row["longest_label"] == 7
    assert row["digit_share"] == pytest.approx(3 / len(url)) and row["host_hyphens"] == 1 and row["suffix_share"] == 7
    counts = np.unique(list(url), return_counts=True)[1] / len(url)
    assert row["entropy"] == pytest.approx(-(counts * np.log2(counts)).sum())


def test_nothing_labelled_and_empty_tables(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, host string")
    assert uf.url_report(none, RULES).collect() == []
    plain = spark.createDataFrame([(1, "http://a.com/x", "h"), (1, "http://a.com/x", "h"), (2, None, "h")], "page_id bigint, url string, host string")
    assert {r.verdict for r in uf.url_report(plain, RULES).collect()} == {"allow"}
    kept = uf.judge(plain, [uf.Rule("a.com", "/", True)])
    assert kept.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and kept.count() == 3


def test_suffix_statistics_cover_all_pages(spark):
    df = spark.createDataFrame([("http://a.com/12",), ("http://b.com/",), ("http://c.org/1",), (None,)], "url string")
    table = uf.suffix_statistics(df)
    used = table[table[:, 0] > 0]
    assert table.shape == (4096, 3) and sorted(used[:, 0].tolist()) == [0.25, 0.25, 0.5]
    assert sorted(used[:, 1].tolist()) == [0.0, 14.0, 14.0] and np.isclose(used[:, 2].max(), 2 / 28)
