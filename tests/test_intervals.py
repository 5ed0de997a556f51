"""Interval joins of any length and region scans by overlap."""

import random

from pyspark.sql import functions as F

from allelespan.operators import filters, intervals, joins, sizing
from allelespan.sources import sinks, tables
from helpers import plan_of, rows_of, scanned_rows


def spans_of_any_length(n=150, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        start = rnd.randrange(1, 250_000_000)
        out.append((i, rnd.choice("1X"), start, start + rnd.choice([0, 1, 65_535, 65_536, 10**6, 10**7, 10**8, 249_000_000])))
    return [*out, (n, "1", 1, 250_000_000), (n + 1, "1", 500, 400), (n + 2, "2", 7, 7)]


def test_intervals_of_any_length_are_never_repeated(spark):
    rnd = random.Random(8)
    spans = spans_of_any_length()
    places = [(rnd.choice("12X"), rnd.randrange(1, 300_000_000)) for _ in range(400)] + [(c, p) for _, c, a, b in spans for p in (a, b, b + 1)]
    listed = spark.createDataFrame(spans, "id int, chrom string, start_pos long, end_pos long")
    variants = spark.createDataFrame(places, "chrom string, pos long")
    got = intervals.within_intervals(variants, listed).select("id", "chrom", "pos")
    assert rows_of(got) == sorted(((i, c, p) for c, p in places for i, ic, a, b in spans if ic == c and a <= p <= b), key=repr)
    assert intervals._placed(listed, intervals.INTERVAL_BIN).count() == len(spans) - 1  # one row each, without the reversed one
    assert "explode" not in plan_of(intervals._placed(listed, intervals.INTERVAL_BIN)).lower()
    some = intervals.inside_any(variants, listed)
    assert rows_of(some) == sorted(((c, p) for c, p in places if any(ic == c and a <= p <= b for _, ic, a, b in spans)), key=repr)


def test_no_intervals(spark):
    none = spark.createDataFrame([], "id int, chrom string, start_pos long, end_pos long")
    variants = spark.createDataFrame([("1", 5)], "chrom string, pos long")
    assert intervals.within_intervals(variants, none).collect() == [] and intervals.inside_any(variants, none).collect() == []


def test_merged_intervals(spark):
    rows = [("1", 1, 5), ("1", 4, 9), ("1", 2, 3), ("1", 11, 12), ("X", 1, 1), ("1", 9, 8)]
    merged = intervals.merged_intervals(spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long"))
    assert rows_of(merged.select("chrom", "start_pos", "end_pos")) == [("1", 1, 9), ("1", 11, 12), ("X", 1, 1)]


def test_overlap_reads_only_what_can_reach_the_region(spark, tmp_path):
    """One long deletion near the start of a chromosome doesn't open the scan of its end."""
    path = str(tmp_path / "sites")
    size = 400_000
    rows = spark.range(size).select(F.lit("1").alias("chrom"), (F.col("id") * 100 + 1).alias("pos"), F.expr("CASE WHEN id = 50 THEN repeat('A', 300000) WHEN id % 1000 = 0 THEN repeat('C', 250) ELSE 'G' END").alias("ref"))
    rows.coalesce(1).sortWithinPartitions("pos").write.option("parquet.block.size", 65_536).option("parquet.page.row.count.limit", 2_000).partitionBy("chrom").parquet(path)
    sinks.write_spans(spark, path)
    sites, spans = tables.read_sites(spark, path), tables.read_spans(spark, path)
    assert spans.count() == 39 and sites.count() == size
    for start, end in ((39_900_150, 39_950_000), (305_000, 305_050), (5_000, 5_000), (39_999_901, 50_000_000), (60_000_000, 70_000_000), (1, 100)):
        got = filters.overlapping_region(sites, "chr1", start, end, spans)
        assert rows_of(got) == rows_of(filters.overlapping_region(sites, "1", start, end))
    late = filters.overlapping_region(sites, "1", 39_900_150, 39_950_000, spans)
    assert late.count() == 499 and scanned_rows(late.select("pos")) < size // 20
    assert scanned_rows(filters.overlapping_region(sites, "1", 39_900_150, 39_950_000).select("pos")) > size // 2
    assert filters.overlapping_region(sites, "2", 1, 10**9, spans).count() == 0


def test_ranges_are_merged():
    assert str(sizing.range_predicate([(5, 9), (1, 4), (20, 30)])).count("pos") == 4
    assert str(sizing.range_predicate([(k * 10, k * 10 + 1) for k in range(500)])).count(">=") == 64
    assert joins.INTERVAL_BIN == 65_536


def test_positions_tested_stay_near_the_matches(spark):
    """A short interval across a large bin's border stays on the smallest level, and a long one meets few positions outside itself."""
    step, last = 100, 200_000
    short = [(k, "1", 4_194_304 * k - 50, 4_194_304 * k + 49) for k in range(1, 5)]
    long = [(10 + k, "1", 1_000_000 * k + 7, 1_000_000 * k + 9_000_000) for k in range(8)]
    listed = spark.createDataFrame(short + long, "id int, chrom string, start_pos long, end_pos long")
    variants = spark.range(last).select(F.lit("1").alias("chrom"), (F.col("id") * step).alias("pos"))
    placed = intervals._placed(listed, intervals.INTERVAL_BIN)
    assert {row._level for row in placed.filter("id < 10").collect()} == {0}
    tested = intervals._asking(variants, placed, intervals.INTERVAL_BIN).join(intervals._in_bins(placed), ["chrom", "_level", "_bin"]).groupBy("id").count()
    met = {row["id"]: row["count"] for row in tested.collect()}
    for k, _, start, end in short + long:
        assert met[k] * step <= 1.3 * (end - start) + 2 * intervals.INTERVAL_BIN + step
    assert intervals._in_bins(placed).groupBy("id").count().agg(F.max("count")).first()[0] <= 65
    whole = spark.createDataFrame([(1, "1", 0, 2**63 - 2)], "id int, chrom string, start_pos long, end_pos long")
    assert intervals._in_bins(intervals._placed(whole, intervals.INTERVAL_BIN)).count() <= 65
    assert intervals.within_intervals(variants, whole).count() == last


def test_long_intervals_are_covered_by_disjoint_bins(spark):
    """Every position in an interval meets it in one bin, whatever its sign; one outside meets it only at its ends."""
    rnd = random.Random(5)
    starts = [rnd.randrange(-3_000_000, 3_000_000) for _ in range(60)] + [0, -1, -64, -63, 64, 511, -512, 4096, 2**63 - 10**9]
    spans = [(i, "1", a, min(a + rnd.choice([0, 63, 64, 512, 5_000, 32_768, 300_000, 5_000_000]), 2**63 - 2)) for i, a in enumerate(starts)]
    spans += [(100, "1", -(10**18), 8 * 10**18), (101, "1", 9, 8), (102, "2", 1, 10**7)]
    edges = [p + d for _, _, a, b in spans for p in (a, b) for d in (-1, 0, 1)]
    places = sorted({*edges, *(rnd.randrange(-4_000_000, 8_000_000) for _ in range(300)), 0, -7, 7, 63, -63, 64, -64})
    listed = spark.createDataFrame(spans, "id int, chrom string, start_pos long, end_pos long")
    variants = spark.createDataFrame([("1", p) for p in places], "chrom string, pos long")
    smallest = 64
    placed = intervals._placed(listed, smallest)
    highest = intervals._used_levels(placed)[-1]
    covering = intervals._covering(placed, smallest, highest)
    assert covering.groupBy("id").count().agg(F.max("count")).first()[0] <= 65 + 14 * highest
    assert covering.filter("NOT _whole AND _level > 0").count() == 0
    met = intervals._asking(variants, placed, smallest, range(highest + 1)).join(covering, ["chrom", "_level", "_bin"])
    seen = [(row["id"], row.pos, row._whole) for row in met.select("id", "pos", "_whole").collect()]
    inside = {(i, p) for i, c, a, b in spans for p in places if c == "1" and a <= p <= b}
    assert len({(i, p) for i, p, _ in seen}) == len(seen) and inside <= {(i, p) for i, p, _ in seen}
    assert {(i, p) for i, p, whole in seen if whole} <= inside
    got = intervals.within_intervals(variants, listed, smallest)
    assert got.columns == ["chrom", "pos", "id", "start_pos", "end_pos"]
    assert rows_of(got.select("id", "pos")) == sorted(inside, key=repr)


def joined_rows(df) -> int:
    """Rows that the joins of a query put out; runs the query."""
    df.collect()
    nodes, output = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if "Join" in node.nodeName():
            output += node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
    return output


def test_long_intervals_are_joined_as_lists(spark, monkeypatch):
    """Positions that lie in thousands of long intervals are joined with lists of them, not one by one."""
    listed = spark.range(2_500).select(F.col("id").alias("region"), F.lit("1").alias("chrom"), (F.col("id") * 100).alias("start_pos"), (F.col("id") * 100 + 40_000_000).alias("end_pos"))
    variants = spark.range(400).select(F.lit("1").alias("chrom"), (F.col("id") * 100_000).alias("pos"))
    pairs = sum(1 for p in range(0, 40_000_000, 100_000) for k in range(2_500) if k * 100 <= p <= k * 100 + 40_000_000)
    counted = intervals.within_intervals(variants, listed).groupBy().count()
    assert joined_rows(counted) < pairs // 200
    assert counted.first()[0] == pairs
    monkeypatch.setattr(intervals, "LISTED_INTERVALS", 7)
    assert intervals.within_intervals(variants, listed).select("region", "pos").distinct().count() == pairs
