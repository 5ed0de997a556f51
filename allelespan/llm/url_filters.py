"""URL filters: rules of hosts and paths first, gradient-boosted trees over lexical features for every other URL.

The features of a URL are lengths, path depth, digit and hyphen shares, byte entropy of the whole and of the host, the number
of parameters, and statistics of its host's suffix (the last label) over all pages. Trees are grown on at most ``max_rows`` labelled
URLs, those with the smallest hashes; the suffix statistics are counted over every page, in a fixed number of bins, so what is shipped
to the tasks doesn't grow with the data. Judging is one map over the pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelespan.llm.arrow_columns import append_columns, free_name
from allelespan.llm.word_hashes import text_chunks

#: Suffixes share this many bins.
SUFFIX_BINS = 4096
#: Columns of the feature matrix; the last three belong to the suffix.
FEATURES = (
    "length", "host_length", "path_length", "depth", "host_labels", "longest_label", "digit_share", "host_digit_share", "hyphens",
    "host_hyphens", "entropy", "host_entropy", "parameters", "suffix_share", "suffix_mean_length", "suffix_digit_share",
)
_DIGITS = "0123456789"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and the paths below ``path``."""

    host: str
    path: str
    block: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one or for a null."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` and for a null."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://`` and for a null."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, block) of the longest rule that fits, ties by its text; null if none does. The rules are the caller's list."""
    found = F.lit(None).cast("struct<rule:string,block:boolean>")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-b for b in r.text.encode()])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.block).alias("block"))).otherwise(found)
    return found


def _suffix_bin(host: Column) -> Column:
    return (F.crc32(F.substring_index(host, ".", -1)) % SUFFIX_BINS).cast("int")


def suffix_statistics(pages: DataFrame, *, url: str = "url") -> np.ndarray:
    """Per suffix bin: share of all pages, mean URL length, digits per character. One aggregate of at most ``SUFFIX_BINS`` rows."""
    rows = pages.select(F.coalesce(F.col(url).cast("string"), F.lit("")).alias("u")).select(_suffix_bin(host_of(F.col("u"))).alias("bin"), "u")
    digits = F.length("u") - F.length(F.translate("u", _DIGITS, ""))
    counted = rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.length("u")).alias("length"), F.sum(digits).alias("digits")).toArrow()
    out, place = np.zeros((SUFFIX_BINS, 3)), counted["bin"].to_numpy()
    n, length, seen = (counted[c].to_numpy().astype(float) for c in ("n", "length", "digits"))
    out[place] = np.column_stack([n / max(n.sum(), 1), length / np.maximum(n, 1), seen / np.maximum(length, 1)])
    return out


def _per_text(texts: pa.Array) -> dict[str, np.ndarray]:
    """Per text: length in bytes, digits, hyphens, entropy of its bytes."""
    parts = []
    for _, data, offsets in text_chunks(texts):
        size = np.diff(offsets)

        def counted(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[offsets[1:]] - total[offsets[:-1]]

        row = np.repeat(np.arange(len(size)), size)
        histogram = np.bincount(row * 256 + data, minlength=len(size) * 256).reshape(len(size), 256)
        share = histogram / np.maximum(size, 1)[:, None]
        entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
        parts.append(np.column_stack([size, counted((data >= 48) & (data <= 57)), counted(data == 45), entropy]))
    whole = np.concatenate(parts) if parts else np.zeros((0, 4))
    return dict(zip(("length", "digits", "hyphens", "entropy"), whole.T))


def feature_matrix(urls: pa.Array, hosts: pa.Array, paths: pa.Array, suffixes: np.ndarray, suffix_bins: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per URL; a null URL counts as an empty one."""
    urls = pc.fill_null(urls, "")
    whole, host = _per_text(urls), _per_text(hosts)
    queries = pc.extract_regex(urls, r"(?s)^[^?#]*\?(?P<q>[^#]*)")
    query = pc.fill_null(pc.struct_field(queries, "q"), "")
    labels = pc.split_pattern(hosts, ".")
    longest = np.zeros(len(urls))
    sizes = pc.utf8_length(labels.flatten()).to_numpy(zero_copy_only=False)
    np.maximum.at(longest, np.repeat(np.arange(len(urls)), pc.list_value_length(labels).to_numpy(zero_copy_only=False)), sizes)
    count = lambda a, pattern: pc.count_substring_regex(a, pattern).to_numpy(zero_copy_only=False)
    return np.column_stack([
        whole["length"], host["length"], pc.binary_length(paths).to_numpy(zero_copy_only=False), count(paths, "/"), count(hosts, r"[^.]+"), longest,
        whole["digits"] / np.maximum(whole["length"], 1), host["digits"] / np.maximum(host["length"], 1), whole["hyphens"], host["hyphens"],
        whole["entropy"], host["entropy"], count(query, "[^&]+"), suffixes[suffix_bins],
    ])


@dataclass
class Trees:
    """Complete binary trees of one depth: ``x[feature] > threshold`` goes right."""

    bias: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves, on the log-odds scale

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        total, rows, inner = np.full(len(x), self.bias), np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node.size and node[0] < inner:  # all rows are on the same level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.2, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees for 0/1 labels by second-order splits over quantile bins.

    A split needs a Hessian sum of ``least`` on both sides; ties go to the first feature and the lowest threshold. With no
    rows, or rows of one label, there are no trees and every probability is the smoothed share of label 1.
    """
    n, inner = len(x), 2**depth - 1
    bias = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    if not n or y.min() == y.max():
        return Trees(bias if n else -4.0, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    total, made = np.full(n, bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            cut = np.zeros(width, dtype=np.int64)
            for f in range(x.shape[1]):
                key = (node - first) * bins + codes[:, f]
                g = np.bincount(key, slope, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(key, curve, width * bins).reshape(width, bins).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
                gain[(h < least) | (all_h - h < least)] = 0
                gain[:, len(cuts[f]) :] = 0  # nothing lies beyond the last threshold
                place = gain.argmax(axis=1)
                better = gain[np.arange(width), place] > best
                best[better], cut[better] = gain[better, place[better]], place[better]
                feature[first : first + width][better] = f
            split = best > 1e-9
            for k in np.flatnonzero(split):
                threshold[first + k] = cuts[feature[first + k]][cut[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        place = node - inner
        leaf = rate * np.bincount(place, slope, inner + 1) / (np.bincount(place, curve, inner + 1) + l2)
        total = total + leaf[place]
        made.append((feature, threshold, leaf))
    return Trees(bias, *(np.array(part) for part in zip(*made)))


@dataclass
class UrlClassifier:
    """Trees with the suffix statistics they were grown on."""

    trees: Trees
    suffixes: np.ndarray

    def scores(self, urls: pa.Array, hosts: pa.Array, paths: pa.Array, suffix_bins: pa.Array) -> np.ndarray:
        return self.trees.probabilities(feature_matrix(urls, hosts, paths, self.suffixes, suffix_bins.to_numpy(zero_copy_only=False)))


def _parsed(df: DataFrame, url: str) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns that features are made of, under free names."""
    names = []
    for wanted, made in (("host", host_of(F.col(url))), ("path", path_of(F.col(url)))):
        names.append(free_name(df, f"url_{wanted}"))
        df = df.withColumn(names[-1], made)
    names.append(free_name(df, "suffix_bin"))
    return df.withColumn(names[-1], _suffix_bin(F.col(names[0]))), names


def fit(pages: DataFrame, labelled: DataFrame, *, url: str = "url", label: str = "block", max_rows: int = 20_000, **growing) -> UrlClassifier:
    """Grow trees on at most ``max_rows`` distinct URLs of ``labelled``, those with the smallest hashes.

    Null URLs and null labels are left out; a URL with several labels counts as blocked if one of them says so. Only the
    sample's features reach the driver, ``max_rows`` rows of numbers whatever the length of the URLs.
    """
    known = labelled.select(F.col(url).cast("string").alias("url"), F.col(label).cast("int").alias("block")).filter("url IS NOT NULL AND block IS NOT NULL")
    keyed = known.groupBy("url").agg(F.max("block").alias("block")).withColumn("order", F.xxhash64("url"))
    sample, names = _parsed(keyed.orderBy("order", "url").limit(max_rows), "url")
    suffixes = suffix_statistics(pages, url=url)
    shared = sample.sparkSession.sparkContext.broadcast(suffixes)

    def features(batches):
        for urls, hosts, paths, bins in batches:
            matrix = feature_matrix(urls, hosts, paths, shared.value, bins.to_numpy(zero_copy_only=False))
            yield [pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))]

    rows = append_columns(sample, ["url", *names], "features array<double>", features).select("order", "block", "features").toArrow()
    matrix = np.array(rows["features"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    labels = np.array(rows["block"].to_pylist(), dtype=float)
    order = np.lexsort((*matrix.T, rows["order"].to_numpy())) if len(rows) else np.zeros(0, dtype=int)
    return UrlClassifier(grow_trees(matrix[order], labels[order], **growing), suffixes)


def score(pages: DataFrame, classifier: UrlClassifier, *, url: str = "url", into: str = "score") -> DataFrame:
    """``pages`` with the probability of being unwanted in ``into`` (an existing column of that name is replaced).

    A null URL is scored as an empty one. Rows stay as they are, repeated ones too; an empty table stays empty.
    """
    shared = pages.sparkSession.sparkContext.broadcast(classifier)  # trees and suffix bins of a fixed number
    parsed, names = _parsed(pages, url)

    def run(batches):
        for arrays in batches:
            yield [pa.array(shared.value.scores(*arrays), pa.float64())]

    return append_columns(parsed, [url, *names], f"`{into}` double", run).drop(*names)


def judge(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", labelled: DataFrame | None = None, max_rows: int = 20_000) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (existing columns of these names are replaced).

    The longest rule that fits gives the verdict, otherwise the trees do. They learn from ``labelled(url, block)``; without it, from
    the URLs that a rule judges. If nothing is labelled, everything else is allowed.
    """
    spare = [free_name(pages, "found"), free_name(pages, "unwanted")]
    others = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"} or c == url]
    ruled = pages.select(*others, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = ruled.withColumn(spare[0], matching_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = ruled.select(F.col(url).alias("url"), F.col(f"{spare[0]}.block").alias("block"))
    classifier = fit(pages.select(F.col(url).alias("url")), labelled, max_rows=max_rows)
    blocked = F.coalesce(F.col(f"{spare[0]}.block"), F.col(spare[1]) >= 0.5)
    verdict = F.when(blocked, "block").otherwise("allow")
    scored = score(ruled, classifier, url=url, into=spare[1])
    return scored.select(*others, "host", "path", F.col(f"{spare[0]}.rule").alias("rule"), verdict.alias("verdict"))


def url_report(pages: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: host, path, the rule that fits (or null) and the verdict."""
    return judge(pages.select(page_id, F.col(url).cast("string").alias("url")), rules).select(page_id, "host", "path", "rule", "verdict")
