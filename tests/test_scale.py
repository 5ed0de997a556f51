"""Plans and skew: what has to hold when tables are large and a key is hot."""

import pytest
from pyspark.sql import functions as F

from allelespan import schemas
from allelespan.operators import filters, joins, layers, ranking, sizing
from allelespan.sources import sinks, tables, vcf
from helpers import plan_of, rows_of

SITE = schemas.SITE_KEY


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def hot_calls(spark, n=6000):
    """A third of all calls lie on one site."""
    pos = F.when(F.col("id") % 3 == 0, 500).otherwise(1000 + F.col("id") % 701)
    return spark.range(n).select(
        F.concat(F.lit("g"), F.col("id")).alias("genome"), F.lit("1").alias("chrom"), pos.cast("long").alias("pos"), F.lit(None).cast("string").alias("id"),
        F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.when(F.col("id") % 5 == 0, "1/1").otherwise("0/1").alias("gt"),
    )


def site_notes(spark):
    return spark.range(0, 2000).select(
        F.lit("1").alias("chrom"), F.col("id").alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.concat(F.lit("rs"), F.col("id")).alias("rsid"), F.lit("G1").alias("gene")
    ).filter("pos % 2 = 0")


def test_hot_key_is_found_and_salted(spark, no_broadcast):
    calls, notes = hot_calls(spark), site_notes(spark)
    assert len(sizing.hot_keys(calls, SITE)) == 1
    salted = joins.annotate(calls, notes, salted=True)
    assert "_salt" in plan_of(salted)
    assert rows_of(salted) == rows_of(joins.annotate(calls, notes))
    for how in ("inner", "left_semi", "left_anti"):
        assert rows_of(sizing.salted_join(calls, notes, SITE, how)) == rows_of(calls.join(notes, SITE, how))


def test_no_hot_key_means_the_plain_join(spark):
    even = spark.range(1000).select(F.col("id").alias("k"))
    assert sizing.hot_keys(even, ["k"]) == []
    assert "_salt" not in plan_of(sizing.salted_join(even, even, ["k"]))
    with pytest.raises(ValueError):
        sizing.salted_join(even, even, ["k"], "full")


def test_salt_depends_on_content_only(spark):
    rows = hot_calls(spark, 300)
    first = rows_of(rows.withColumn("s", sizing.content_salt(rows, 8)))
    again = rows.repartition(7)
    assert first == rows_of(again.withColumn("s", sizing.content_salt(again, 8)))


@pytest.mark.parametrize("n", [1, 3, 1500])
def test_top_rows_of_a_hot_group(spark, n):
    rows = spark.range(9000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % 9001).alias("v"))
    expected = {}
    for g, v in rows.collect():
        expected.setdefault(g, []).append(v)
    expected = sorted((g, v) for g, values in expected.items() for v in sorted(values)[:n])
    got = sizing.top_per_group(rows, ["g"], ["v"], n)
    assert sorted(map(tuple, got.collect())) == expected


def test_groups_are_cut_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("rsid").cast("string"), F.rand(1).alias("p_value"), "id")
    for df in (ranking.best_per_rsid(rows, ["id"]), sizing.top_per_group(rows, ["rsid"], ["id"], 2000)):
        plan = plan_of(df)
        first_exchange = plan.index("Exchange hashpartitioning")
        assert "Partial" in plan or plan.count("Window") >= 2
        assert "WindowGroupLimit" in plan[first_exchange:] or plan.count("Exchange hashpartitioning") >= 2


def test_layers_share_one_shuffle_of_the_base(spark, no_broadcast):
    base = spark.range(10).select(F.lit("1").alias("chrom"), "id", F.lit("A").alias("ref"), F.lit("G").alias("alt")).withColumnRenamed("id", "pos")
    effects = base.select(*SITE, *[F.lit("x").alias(n) for n in ["rsid", "rsid_source", *schemas.EFFECT_COLUMNS]])
    clinical = base.select(*SITE, *[F.lit("x").alias(n) for n in schemas.CLINICAL_COLUMNS])
    frequency = base.select(*SITE, F.lit(0.1).alias("af"), F.lit(0.1).alias("af_grpmax"))
    identifiers = base.select(*SITE, F.lit("rs1").alias("rsid"))
    plan = plan_of(layers.build_annotations(effects, clinical, frequency, identifiers))
    assert plan.count("Exchange hashpartitioning") == 4  # one per input, none between the joins


def test_bucketed_tables_join_without_a_shuffle(spark, no_broadcast, tmp_path):
    sinks.write_bucketed(hot_calls(spark, 500), "bucketed_calls_test", str(tmp_path / "calls"), 4)
    sinks.write_bucketed(site_notes(spark), "bucketed_notes_test", str(tmp_path / "notes"), 4)
    joined = joins.annotate(spark.table("bucketed_calls_test"), spark.table("bucketed_notes_test"))
    assert "Exchange" not in plan_of(joined)
    assert joined.count() == 500


def test_region_filter_reaches_the_scan(spark, tmp_path):
    sinks.write_sites(hot_calls(spark, 500), str(tmp_path / "calls"))
    calls = tables.read_sites(spark, str(tmp_path / "calls"))
    plan = plan_of(filters.in_region(calls, "chr1", 500, 1000).select("genome"))
    assert "PartitionFilters: [isnotnull(chrom" in plan and "GreaterThanOrEqual(pos,500)" in plan
    assert "gt:" not in plan.split("ReadSchema")[1]
    plan = plan_of(filters.in_regions(calls, ["chr1:1-5", "chr2:7-9"]))
    assert "PushedFilters: [Or(" in plan or "LessThanOrEqual(pos" in plan


def test_one_genome_reads_one_folder(spark, tmp_path):
    sinks.write_genomes(hot_calls(spark, 500), str(tmp_path / "calls"))
    calls = spark.read.parquet(str(tmp_path / "calls"))
    one = filters.of_genomes(calls, "g7")
    assert [row.genome for row in one.collect()] == ["g7"]
    assert "PartitionFilters: [isnotnull(genome_bucket" in plan_of(one) or "PartitionFilters: [(genome_bucket" in plan_of(one)
    files = {row[0] for row in one.select("_metadata.file_path").distinct().collect()}
    assert len({f.split("genome_bucket=")[1].split("/")[0] for f in files}) == 1
    assert filters.of_genomes(calls, filters.ALL_GENOMES).count() == 500


def test_identifier_lookup_prunes_the_calls(spark, tmp_path):
    sinks.write_sites(hot_calls(spark, 500), str(tmp_path / "calls"))
    calls = tables.read_sites(spark, str(tmp_path / "calls"))
    found = joins.calls_for_rsids(calls, site_notes(spark), ["rs500"])
    plan = plan_of(found)
    assert "BroadcastHashJoin" in plan and ("EqualTo(pos,500)" in plan or "In(pos" in plan)
    assert found.count() == 167


def test_many_sites_fall_back_to_a_shuffled_join(spark, no_broadcast):
    many = site_notes(spark).unionByName(spark.range(2000, 6000).select(F.lit("1").alias("chrom"), F.col("id").alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.lit("r").alias("rsid"), F.lit("g").alias("gene")))
    assert sizing.pin_if_small(many) is None
    calls = hot_calls(spark, 900)
    assert rows_of(joins.calls_at_sites(calls, many)) == rows_of(joins.annotate_inner(calls, many))
    assert "BroadcastHashJoin" not in plan_of(joins.calls_at_sites(calls, many))


def test_interval_join_equals_brute_force(spark):
    variants = spark.range(400).select(F.when(F.col("id") % 3 == 0, "X").otherwise("1").alias("chrom"), (F.col("id") * 331).alias("pos"))
    genes = [(f"G{i}", "X" if i % 2 else "1", i * 900, i * 900 + 4000 * (i % 5)) for i in range(120)]
    intervals = spark.createDataFrame(genes, "symbol string, chrom string, start_pos long, end_pos long")
    expected = sorted((c, p, g) for c, p in map(tuple, variants.collect()) for g, gc, a, b in genes if gc == c and a <= p <= b)
    for size in (100, 4096, joins.INTERVAL_BIN):
        got = joins.within_intervals(variants, intervals, size).select("chrom", "pos", "symbol")
        assert sorted(map(tuple, got.collect())) == expected
    assert "NestedLoop" not in plan_of(joins.within_intervals(variants, intervals))


def test_long_region_lists_become_a_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "X").otherwise("1").alias("chrom"), (F.col("id") % 1000 * 331).alias("pos"))
    regions = [f"chr{'X' if i % 2 else '1'}:{i * 700}-{i * 700 + 900}" for i in range(300)]
    spans = [(r.split(":")[0][3:], *map(int, r.split(":")[1].split("-"))) for r in regions]
    here = sorted(map(tuple, rows.collect()))
    expected = [(c, p) for c, p in here if any(c == rc and a <= p <= b for rc, a, b in spans)]
    assert sorted(map(tuple, filters.in_regions(rows, regions).collect())) == expected
    pairs = sorted((r, c, p) for c, p in here for r, (rc, a, b) in zip(regions, spans) if c == rc and a <= p <= b)
    assert sorted(map(tuple, filters.in_regions(rows, regions, labelled=True).collect())) == pairs
    few = filters.in_regions(rows, regions[:20])
    assert sorted(map(tuple, few.collect())) == [(c, p) for c, p in here if any(c == rc and a <= p <= b for rc, a, b in spans[:20])]
    assert filters.in_regions(rows, []).count() == 0


def test_identifier_of_every_genome_joins_by_sides_that_can_be_split(spark, no_broadcast):
    """One identifier over all genomes: the join that meets its calls is an inner one, and associations without a call keep one row."""
    calls, notes = hot_calls(spark, 900), site_notes(spark)
    wanted = spark.createDataFrame([("rs500", 1), ("rs500", 2), ("rs1999", 3), (None, 4)], "rsid string, k int")
    got = joins.association_genotypes(wanted, calls, notes)
    assert "LeftOuter" not in plan_of(got)
    counts = {row.k: (row.n, row.genomes) for row in got.groupBy("k").agg(F.count("*").alias("n"), F.count("genome").alias("genomes")).collect()}
    assert counts == {1: (300, 300), 2: (300, 300), 3: (1, 0), 4: (1, 0)}


def test_one_call_per_position_is_spread_by_genome(spark, no_broadcast):
    plan = plan_of(joins.first_calls_at(hot_calls(spark), site_notes(spark)))
    window = plan.index("Window")
    assert "hashpartitioning(genome" in plan[window:]


def test_vcf_fields_stay_in_generated_code(spark, tmp_path):
    """Searching and typing INFO fields needs no interpreted functions."""
    (tmp_path / "a.vcf").write_text("1\t5\trs1\tA\tG\t.\t.\tANN=a\n")
    for layer in (vcf.effect_layer, vcf.clinical_layer, vcf.identifier_layer):
        plan = plan_of(layer(vcf.read_vcf_lines(spark, str(tmp_path))))
        assert plan.lstrip().startswith("*(1) Project") and "lambda" not in plan


def test_missing_keys_do_not_meet_in_one_task(spark, no_broadcast):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 100 == 0, F.concat(F.lit("rs"), F.col("id"))).alias("rsid"))
    known = spark.range(0, 4000, 200).select(F.concat(F.lit("rs"), F.col("id")).alias("rsid"), F.lit(1).alias("hit"))
    joined = sizing.left_join_nullable(rows, known, {"rsid": F.col("rsid")})
    assert rows_of(joined) == rows_of(rows.join(known, "rsid", "left").select("id", "rsid", "hit"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [row[1] for row in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_python_workers_in_any_plan(spark):
    import __spark_entry__ as entry

    names = ["join_annotate", "fn_parse_genotype", "filter_smart", "calculate_prs", "query_gene", "query_gwas", "genome_summary", "join_gene_interval"]
    for name in names:
        plan = plan_of(entry.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "Python" not in plan and "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_scattered_positions_prune_row_groups(spark, tmp_path):
    """Fifty far-apart positions read a small share of the rows, not everything between the first and the last."""
    rows = spark.range(400_000).select(F.lit("1").alias("chrom"), (F.col("id") * 10).alias("pos"))
    rows.coalesce(1).write.option("parquet.block.size", 65_536).option("parquet.page.row.count.limit", 2_000).parquet(str(tmp_path / "sites"))
    wanted = [spark.createDataFrame([("1", 80_000 * k + 10)], "chrom string, pos long").first() for k in range(50)]
    found = spark.read.parquet(str(tmp_path / "sites")).filter(sizing.site_predicate(wanted))
    assert found.count() == 50
    scanned = spark.read.parquet(str(tmp_path / "sites")).filter(sizing.site_predicate(wanted))
    scanned.collect()
    nodes = [scanned._jdf.queryExecution().executedPlan()]
    output = []
    while nodes:
        node = nodes.pop()
        if "Scan" in node.nodeName() and "numOutputRows" in str(node.metrics()):
            output.append(node.metrics().apply("numOutputRows").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
    assert output and max(output) < 200_000
    merged = str(sizing.site_predicate(wanted, ranges=5))
    assert merged.count("chrom") == 5


def test_shuffled_tasks_stay_small(spark):
    """Calls unfold in sorts and hash tables, so a session without a setting merges only little of a shuffle into one task."""
    from allelespan.session import TASK_BYTES
    from testbed.registry import Tables

    setting, session = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.newSession()
    session.conf.unset(setting)
    Tables(session, "/root/testdata/sf0.001")
    assert session.conf.get(setting) == TASK_BYTES == "16m"
    session.conf.set(setting, "1g")
    Tables(session, "/root/testdata/sf0.001")
    assert session.conf.get(setting) == "1g"
