"""Versions of layers, the identifier index, packed genotypes, broken records and digests."""

import pytest
from pyspark.sql import functions as F

from allelespan.operators import joins, layers, packed, ranking
from allelespan.sources import sinks, tables, vcf
from helpers import plan_of, rows_of, scanned_rows

CLINICAL = "chrom string, pos long, ref string, alt string, clnsig string, clndn string, clnrevstat string"


def release(frame, word, n=3):
    return frame([("1", k, "A", "G", word, None, None) for k in range(n)], CLINICAL)


def test_two_writers_leave_two_whole_versions(spark, frame, tmp_path):
    one, two = (sinks.LayerStore(spark, str(tmp_path / "store")) for _ in range(2))
    first, second = one.claim("clinvar"), two.claim("clinvar")
    assert (first, second) == (1, 2) and one.versions("clinvar") == [] and one.read("clinvar") is None
    two.write("clinvar", release(frame, "second"), number=second)
    one.write("clinvar", release(frame, "first", 4), number=first)
    assert one.versions("clinvar") == [1, 2]
    assert {r.clnsig for r in one.read("clinvar").collect()} == {"second"} and one.read("clinvar", 1).count() == 4
    with pytest.raises(ValueError):
        one.read("clinvar", 3)


def test_only_the_newest_versions_stay(spark, frame, tmp_path):
    store = sinks.LayerStore(spark, str(tmp_path / "store"))
    claimed = store.claim("clinvar")
    for k in range(4):
        store.write("clinvar", release(frame, f"r{k}"), keep=2)
    assert store.versions("clinvar") == [4, 5] and claimed in store._claimed("clinvar")
    with pytest.raises(ValueError):
        store.write("clinvar", release(frame, "x"), keep=0)


def test_identifier_lookup_reads_few_row_groups(spark, tmp_path):
    """Identifiers are scattered over positions; the index leads to them without a pass over the annotations."""
    size, path = 200_000, str(tmp_path / "notes")
    notes = spark.range(size).select(F.lit("1").alias("chrom"), (F.col("id") * 5 + 1).alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.expr("CASE WHEN id % 9 > 0 THEN concat('rs', id * 77773 % 200000) END").alias("rsid"), F.lit("G1").alias("gene"))
    option = {"parquet.block.size": 65_536, "parquet.page.row.count.limit": 2_000}
    notes.coalesce(1).write.options(**option).parquet(path)
    sinks.write_identifiers(notes, str(tmp_path / "index"))
    stored, index = spark.read.parquet(path), spark.read.parquet(str(tmp_path / "index"))
    asked = ["rs77773", "rs155546", "rs4", "rs999999999"]
    got = joins.sites_for_rsids(stored, asked, index)
    assert rows_of(got) == rows_of(joins.sites_for_rsids(stored, asked)) and got.count() == 3
    assert scanned_rows(joins.sites_for_rsids(stored, asked, index).select("pos", "gene")) < size // 5
    assert index.count() == notes.filter("rsid IS NOT NULL").count()


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS0\tS1
chr1\t10\trs1\tA\tG\t.\tPASS\tDP=1\tGT:DP\t0/1:3\t1/1:4
chr1\t10\t.\tA\tC,T\t.\tPASS\tDP=1\tGT\t1/2\t./.
chr1\tx12\t.\tA\tG\t.\tPASS\tDP=1\tGT\t0/1\t0/1
chrX\t7\t.\tC\tT\t.\tPASS\tDP=1\tGT\t./.\t1|0
chrX\t8\t.\tC
"""


def test_packed_genotypes_score_like_calls(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    lines = vcf.read_vcf_lines(spark, str(tmp_path / "a.vcf"))
    rows, names = vcf.parse_packed(lines), vcf.sample_names(lines)
    assert rows.count() == 3 and rows_of(packed.unpack_calls(rows, names)) == rows_of(vcf.parse_calls(lines))
    weights = spark.createDataFrame([("P", "t", "rs1", "1", 10, "C", 0.5), ("P", "t", "r", "X", 7, "T", 2.0), ("Q", "u", "r", "1", 10, "T", 3.0), ("Q", "u", "r", "9", 1, "T", 3.0)], "prs_id string, trait string, rsid string, chrom string, pos long, effect_allele string, weight double")
    got = {(r.genome, r.prs_id): (r.score, r.found, r.no_call, r.total) for r in packed.packed_scores(weights, rows, names).collect()}
    assert got == {("S0", "P"): (0.5, 2, 1, 2), ("S1", "P"): (2.0, 2, 1, 2), ("S0", "Q"): (3.0, 1, 0, 2), ("S1", "Q"): (0.0, 1, 1, 2)}


def test_no_genotype_is_shuffled_for_scores(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    lines = vcf.read_vcf_lines(spark, str(tmp_path / "a.vcf"))
    weights = spark.createDataFrame([("P", "t", "rs1", "1", 10, "C", 0.5)], "prs_id string, trait string, rsid string, chrom string, pos long, effect_allele string, weight double")
    plan = plan_of(packed.packed_scores(weights, vcf.parse_packed(lines), vcf.sample_names(lines)))
    assert plan.index("sample_index") and "hashpartitioning(genome" not in plan.split("Generate posexplode")[-1]


def test_a_broken_position_is_told_and_left_out(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    lines = vcf.read_vcf_lines(spark, str(tmp_path / "a.vcf"))
    assert vcf.parse_vcf(lines).count() == 3 and vcf.parse_calls(lines).count() == 6 and vcf.parse_one_sample(lines, "S1").count() == 3
    marked = vcf.mark_records(lines)
    assert [r.loaded for r in marked.collect()] == [True, True, False, True, False]


def test_a_quoted_tab_stays_in_its_cell(spark, tmp_path):
    row = ["-"] * 38
    row[7], row[9], row[21], row[27] = '"Height\tadjusted ""x"""', '"a\tb\tc"', "rs5", "1E-9"
    torn = list(row)
    torn[9], torn[10] = '"never closed', 'x" y'
    (tmp_path / "g.tsv").write_text("\n".join(["DATE ADDED TO CATALOG\tX", "\t".join(row), "\t".join(torn), "\t" * 37, "a\tb"]) + "\n")
    raw = tables.read_gwas_rows(spark, str(tmp_path / "g.tsv"))
    assert [r[0] for r in raw.select(F.size("cells")).collect()] == [38, 38, 38, 2]
    got = rows_of(tables.gwas_associations(raw).select("rsid", "trait", "p_value"))
    assert got == [("rs5", 'Height\tadjusted "x"', 1e-9)] * 2 and raw.filter("NOT loaded").count() == 2


def test_equal_tables_shuffle_digests_only(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, "X").otherwise("1").alias("chrom"), (F.col("id") * 400).alias("pos"), F.lit("A").alias("ref"), (F.col("id") % 7).alias("v"))
    assert layers.differing_rows(rows, rows.repartition(9)).count() == 0
    assert layers.differing_bins(rows, rows.repartition(9)).count() == 0
    other = rows.filter("pos <> 4000").unionByName(spark.createDataFrame([("1", 7, "A", 1), ("1", 7, "A", 1), (None, None, "A", 1)], "chrom string, pos long, ref string, v long"))
    got = rows_of(layers.differing_rows(rows, other).select("chrom", "pos", "side", "copies"))
    assert got == sorted([("1", 4000, "left", 1), ("1", 7, "right", 2), (None, None, "right", 1)], key=repr)
    assert layers.differing_bins(rows, other).count() == 2  # the null place and the first bin of chromosome 1
    assert layers.differing_rows(rows.limit(0), rows).count() == 50_000


def test_places_in_a_sorted_table(spark):
    rows = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("k"), F.lit("x").alias("place_")).repartition(7)
    got = ranking.numbered(rows, [F.col("k").desc()])
    assert got.columns == ["k", "place_", "place"] and all(r.place == 5_000 - r.k for r in got.collect())
    assert "Window" not in plan_of(got)
    assert ranking.numbered(rows.limit(0), ["k"]).collect() == []
