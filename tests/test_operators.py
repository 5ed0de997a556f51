"""Operators and query functions on small tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from allelespan import schemas
from allelespan.operators import aggregates, filters, joins, layers, ranking, reference_builds
from allelespan.plans import traits, variants
from allelespan.plans.cohort import ALL_GENOMES, Cohort
from helpers import rows_of


def empty_annotation(**known):
    return tuple(known.get(f.name) for f in schemas.ANNOTATIONS.fields)


@pytest.fixture
def cohort(spark):
    sites = [
        dict(chrom="12", pos=21178615, ref="T", alt="C", rsid="rs4149056", rsid_source="vcf", gene="SLCO1B1", effect="missense_variant", impact="MODERATE", clnsig="drug_response", clndn="Statin_response", af=0.14, af_grpmax=0.21),
        dict(chrom="12", pos=21178700, ref="A", alt="G", rsid="rs2306283", rsid_source="dbsnp", gene="SLCO1B1", effect="missense_variant", impact="MODERATE", af=0.4),
        dict(chrom="12", pos=21178800, ref="ATCT", alt="A", gene="SLCO1B1", effect="frameshift_variant", impact="HIGH", clnsig="Pathogenic", clndn="."),
        dict(chrom="12", pos=21178900, ref="A", alt="G", gene="", clnsig="Likely_benign", af=0.001),
        dict(chrom="7", pos=117559590, ref="ATCT", alt="A", rsid="rs113993960", rsid_source="vcf", gene="CFTR", effect="inframe_deletion", impact="MODERATE", clnsig="Pathogenic", clndn="Cystic_fibrosis"),
    ]
    calls = [
        ("g1", "12", 21178615, "rs4149056", "T", "C", "0/1"), ("g1", "12", 21178700, None, "A", "G", "1/1"), ("g1", "12", 21178800, None, "ATCT", "A", "0/1"),
        ("g1", "12", 21178900, None, "A", "G", "0/1"), ("g1", "12", 21178950, "rs5", "A", "G", "0/1"), ("g1", "12", 21178960, None, "A", "G", "0/1"),
        ("g2", "12", 21178615, "rs4149056", "T", "C", "0/0"), ("g2", "7", 117559590, "rs113993960", "ATCT", "A", "0|1"),
    ]
    make = spark.createDataFrame
    genes = [("SLCO1B1", "transporter", "12", 21178000, 21179000, "+"), ("CFTR", "channel", "7", 117480025, 117668665, "+")]
    return Cohort(
        make(calls, schemas.CALLS),
        make([empty_annotation(**site) for site in sites], schemas.ANNOTATIONS),
        make(genes, schemas.GENES),
        make([("simvastatin", "SLCO1B1", "CPIC", None, "s", "A", None)], schemas.PGX_DRUGS),
        make([("SLCO1B1", "rs4149056", "12", 21178615, "T", "C", "*5", "Decreased function", None), ("SLCO1B1", "rs1", "12", 1, "T", "C", "*9", None, None), ("slco1b1", "rs2", None, None, "T", "C", "*10", None, None)], schemas.PGX_VARIANTS),
        make([("P1", "Shared", "rs4149056", "12", 21178615, "C", 0.5), ("P2", "Shared", "rs2306283", "12", 21178700, "G", -0.25), ("P2", "Shared", "rs0", "1", 5, "G", 9.0)], schemas.PRS_WEIGHTS),
        None,
        make([("cftr",)], schemas.WARNING_GENES),
        ("g1", "g2"),
    )


def test_choice_of_genome():
    assert filters.pick_genome(["a"], None) == "a"
    assert filters.pick_genome(["a", "b"], "b") == "b"
    assert filters.pick_genome(["a", "b"], ALL_GENOMES) == ALL_GENOMES
    with pytest.raises(ValueError, match="choose"):
        filters.pick_genome(["a", "b"], None)
    with pytest.raises(ValueError, match="unknown"):
        filters.pick_genome(["a", "b"], "c")


def test_query_gene(cohort):
    got = variants.query_gene(cohort, "slco1b1", genome="g1")
    # the common missense site is hidden, the drug response and the frameshift stay; sites without impact need an
    # identifier or a significance
    assert [row[0] for row in rows_of(got.select("pos"))] == [21178615, 21178800, 21178900]
    everything = variants.query_gene(cohort, "SLCO1B1", smart_filter=False, genome="g1")
    assert [row[0] for row in rows_of(everything.select("pos"))] == [21178615, 21178700, 21178800, 21178900, 21178950]
    assert rows_of(variants.query_gene(cohort, "SLCO1B1", "HIGH", genome="g1", smart_filter=False).select("pos")) == [(21178800,), (21178900,), (21178950,)]
    assert rows_of(variants.query_gene(cohort, "SLCO1B1", max_results=1, genome="g1").select("pos", "truncated")) == [(21178615, True)]
    assert rows_of(variants.query_gene(cohort, "SLCO1B1", max_results=3, genome="g1").select("truncated").distinct()) == [(False,)]
    assert variants.query_gene(cohort, "NOPE", genome="g1").count() == 0
    pair = variants.query_gene(cohort, "SLCO1B1", genome="g1", genome2="g2")
    assert rows_of(pair.groupBy("genome").count()) == [("g1", 3), ("g2", 1)]
    with pytest.raises(ValueError, match="impact"):
        variants.query_gene(cohort, "SLCO1B1", "SEVERE", genome="g1")


def test_query_genes_limits(cohort):
    got = variants.query_genes(cohort, ["slco1b1", "CFTR", "NOPE"], genome=ALL_GENOMES, max_results_per_gene=2)
    assert rows_of(got.groupBy("genome", "symbol").count()) == [("g1", "SLCO1B1", 2), ("g2", "CFTR", 1), ("g2", "SLCO1B1", 1)]
    many = variants.query_genes(cohort, ["slco1b1", *[f"G{i}" for i in range(500)]], genome="g1")
    assert rows_of(many) == rows_of(variants.query_genes(cohort, ["SLCO1B1"], genome="g1"))
    with pytest.raises(ValueError):
        variants.query_genes(cohort, [" "], genome="g1")


def test_query_variant(cohort):
    got = variants.query_variant(cohort, rsid="rs4149056", genome="g1", genome2="g2")
    assert rows_of(got.select("genome", "display", "zygosity", "significance", "global", "popmax", "sensitive")) == [
        ("g1", "T/C", "heterozygous", "drug response", 0.14, 0.21, False), ("g2", "T/T", "homozygous_ref", "drug response", 0.14, 0.21, False),
    ]
    assert rows_of(variants.query_variant(cohort, rsid="rs113993960", genome="g2").select("sensitive")) == [(True,)]
    # the window of a position lookup includes the next base
    assert rows_of(variants.query_variant(cohort, position="chr12:21178614", genome="g1").select("pos")) == [(21178615,)]
    assert variants.query_variant(cohort, position="12:21178613", genome="g1").count() == 0
    # a call without annotation keeps its own identifier
    assert rows_of(variants.query_variant(cohort, position="chr12:21178950", genome="g1").select("rsid", "gene")) == [("rs5", None)]
    for bad in (dict(), dict(position="chr12"), dict(position="chr12:x"), dict(rsid="12")):
        with pytest.raises(ValueError):
            variants.query_variant(cohort, genome="g1", **bad)
    with pytest.raises(ValueError):
        variants.query_variant(cohort, rsid="rs1")


def test_query_variants(cohort):
    got = variants.query_variants(cohort, ["rs4149056", "rs404", "rs4149056", "rs2306283"], "g1")
    assert rows_of(got.select("request_order", "rsid", "found", "display")) == [(1, "rs4149056", True, "T/C"), (2, "rs404", False, None), (3, "rs2306283", True, "G/G")]
    many = variants.query_variants(cohort, ["rs4149056", *[f"rs{i}" for i in range(5000)]], "g1")
    assert many.count() >= 5001 and rows_of(many.filter("found").select("rsid").distinct()) >= [("rs4149056",)]
    with pytest.raises(ValueError):
        variants.query_variants(cohort, [" "], "g1")


def test_query_clinvar(cohort):
    assert rows_of(variants.query_clinvar(cohort, genome=ALL_GENOMES).select("genome", "gene")) == [("g1", "SLCO1B1"), ("g2", "CFTR")]
    assert rows_of(variants.query_clinvar(cohort, condition="FIBRO", genome=ALL_GENOMES).select("gene", "condition")) == [("CFTR", "Cystic fibrosis")]
    assert rows_of(variants.query_clinvar(cohort, gene="SLCO1B1", genome=ALL_GENOMES).select("genome")) == [("g1",)]
    assert rows_of(variants.query_clinvar(cohort, "benign", genome="g1").select("gene")) == [("Unknown",)]


def test_query_pgx(cohort):
    got = traits.query_pgx(cohort, drug="Simvastatin", genome="g1").select("star_allele", "status")
    assert rows_of(got) == [("*10", "not found"), ("*5", "T/C (het)"), ("*9", "ref or not covered")]
    assert rows_of(traits.query_pgx(cohort, gene="slco1b1", genome="g2").filter("star_allele = '*5'").select("status")) == [("T/T (ref)",)]
    pair = traits.query_pgx(cohort, drug="simvastatin", genome="g1", genome2="g2").filter("star_allele = '*5'")
    assert rows_of(pair.select("genome", "status")) == [("g1", "T/C (het)"), ("g2", "T/T (ref)")]
    everyone = traits.query_pgx(cohort, drug="simvastatin", genome=ALL_GENOMES).filter("star_allele = '*5'")
    assert rows_of(everyone.select("genome", "status")) == [("g1", "T/C (het)"), ("g2", "T/T (ref)")]
    for bad in (dict(genome="g1"), dict(drug="simvastatin")):
        with pytest.raises(ValueError):
            traits.query_pgx(cohort, **bad)
    assert rows_of(traits.query_pgx_region(cohort, "SLCO1B1", "g2").select("pos")) == []


def test_query_pgx_with_all_variants(cohort):
    got = traits.query_pgx(cohort, drug="simvastatin", genome=ALL_GENOMES, include_all_variants=True, max_results=2)
    region = got.filter("part = 'region'").select("genome", "gene", "pos", "status", "effect", "truncated", "drug_name", "sensitive")
    # the second genome has reference calls only
    assert rows_of(region) == [
        ("g1", "SLCO1B1", 21178615, "T/C", "missense_variant", True, None, False), ("g1", "SLCO1B1", 21178700, "G/G", "missense_variant", True, None, False)
    ]
    assert got.filter("part = 'star_alleles'").count() == traits.query_pgx(cohort, drug="simvastatin", genome=ALL_GENOMES).count() == 6


def test_query_gwas_marks_warning_genes_and_tells_of_more(cohort, frame):
    gwas = frame(
        [("rs1", "t", "A - Cftr", 1e-9, "S1"), ("rs2", "t", None, 1e-8, "S2"), (None, "t", "CFTR", 1e-7, "S3"), (None, "t", "CFTR", 1e-7, "S3"), ("rs4149056", "t", "SLCO1B1", 1e-3, "S4")],
        "rsid string, trait string, mapped_gene string, p_value double, study_accession string",
    )
    cohort = replace(cohort, gwas=gwas.withColumn("mapped_trait", F.col("trait")))
    columns = ["rank", "rsid", "sensitive", "truncated"]
    got = traits.query_gwas(cohort, trait="T", max_results=4).select(columns)
    assert [tuple(row) for row in got.collect()] == [(1, "rs1", True, True), (2, "rs2", False, True), (3, None, True, True), (4, None, True, True)]
    called = traits.query_gwas(cohort, trait="T", max_results=5, check_calls=True, genome=ALL_GENOMES).select("rank", "rsid", "genome", "genotype", "truncated")
    assert rows_of(called)[:4] == [(k, rsid, None, None, False) for k, rsid in ((1, "rs1"), (2, "rs2"), (3, None), (4, None))]
    assert rows_of(called)[4:] == [(5, "rs4149056", "g1", "T/C (het)", False), (5, "rs4149056", "g2", "T/T (ref)", False)]


def test_scores_sharing_a_trait_stay_apart(cohort):
    got = traits.calculate_prs(cohort, trait="shared", genome=ALL_GENOMES).select("genome", "prs_id", "score", "found", "no_call", "total")
    assert rows_of(got) == [("g1", "P1", 0.5, 1, 0, 1), ("g1", "P2", -0.5, 1, 0, 2), ("g2", "P1", 0.0, 1, 0, 1), ("g2", "P2", 0.0, 0, 0, 2)]
    one = traits.calculate_prs(cohort, trait="shared", genome="g2").select("genome", "prs_id", "score", "found", "no_call", "total")
    assert rows_of(one) == [("g2", "P1", 0.0, 1, 0, 1), ("g2", "P2", 0.0, 0, 0, 2)]
    assert rows_of(traits.prs_details(cohort, prs_id="P2", genome="g1").select("rsid", "contribution")) == [("rs2306283", -0.5)]


def test_text_filter(cohort):
    assert rows_of(filters.with_text(cohort.annotations, "FRAMESHIFT").select("pos")) == [(21178800,)]
    assert rows_of(filters.with_text(cohort.annotations, 'ANN ~"cftr"').select("pos")) == [(117559590,)]
    assert filters.with_text(cohort.annotations, "").count() == 0


def test_like_wildcards_are_plain_text(frame):
    rows = frame([("100% fit",), ("a_b",), ("aXb",)], "trait string")
    assert rows_of(rows.filter(filters.contains_ignoring_case("trait", "A_B"))) == [("a_b",)]
    assert rows_of(rows.filter(filters.contains_ignoring_case("trait", "%"))) == [("100% fit",)]


def test_regions(frame):
    rows = frame([("1", 10), ("1", 20), ("2", 10)], "chrom string, pos long")
    assert rows_of(filters.in_regions(rows, ["chr1:1-15", "chr1:5-25"])) == [("1", 10), ("1", 20)]
    assert filters.in_regions(rows, ["chr1:1-15", "chr1:5-25"], labelled=True).count() == 3
    with pytest.raises(ValueError):
        filters.in_regions(rows, ["1:1-15"])


KEY = "chrom string, pos long, ref string, alt string"


def annotation_rows(spark, *sites):
    return spark.createDataFrame([empty_annotation(**site) for site in sites], schemas.ANNOTATIONS)


def site(pos, **known):
    return dict(chrom="1", pos=pos, ref="A", alt="G", **known)


def test_upsert_keeps_other_layers(spark, frame):
    base = annotation_rows(spark, site(1, rsid="rs1", rsid_source="vcf", gene="OLD", impact="LOW", clnsig="Benign", af=0.5), site(2, gene="KEPT"))
    names = ["rsid", "rsid_source", *schemas.EFFECT_COLUMNS]
    fresh = frame(
        [("1", 1, "A", "G", None, None, "NEW", None, None, None, None, None), ("1", 3, "A", "G", "rs3", "vcf", "G3", None, "HIGH", None, None, None)],
        KEY + ", " + ", ".join(f"{n} string" for n in names),
    )
    got = layers.upsert_effects(base, fresh).select("pos", "rsid", "rsid_source", "gene", "impact", "clnsig", "af")
    assert rows_of(got) == [(1, "rs1", "vcf", "NEW", None, "Benign", 0.5), (2, None, None, "KEPT", None, None, None), (3, "rs3", "vcf", "G3", "HIGH", None, None)]


def test_update_touches_only_matches(spark, frame):
    base = annotation_rows(spark, site(1, clnsig="Benign", clndn="x"), site(2, clnsig="Benign"))
    layer = frame([("1", 1, "A", "G", "Pathogenic", None, None), ("1", 9, "A", "G", "Pathogenic", None, None), ("1", 2, "A", "T", "Pathogenic", None, None)], KEY + ", clnsig string, clndn string, clnrevstat string")
    assert rows_of(layers.update_layer(base, layer, schemas.CLINICAL_COLUMNS).select("pos", "clnsig", "clndn")) == [(1, "Pathogenic", None), (2, "Benign", None)]


def test_backfill_never_overwrites(spark, frame):
    base = annotation_rows(spark, site(1, rsid="rsVCF", rsid_source="vcf"), site(2), site(3))
    known = frame([("1", p, "A", "G", f"rs{p}") for p in (1, 2)], KEY + ", rsid string")
    got = layers.backfill_rsids(base, known)
    assert rows_of(got.select("pos", "rsid", "rsid_source")) == [(1, "rsVCF", "vcf"), (2, "rs2", "dbsnp"), (3, None, None)]
    cleared = layers.clear_layer(got, "dbsnp")
    assert rows_of(cleared.select("pos", "rsid", "rsid_source")) == [(1, "rsVCF", "vcf"), (2, None, None), (3, None, None)]
    with pytest.raises(ValueError):
        layers.clear_layer(got, "nope")


def test_differing_rows_counts_copies(frame):
    left, right = frame([(1,), (1,), (2,)], "x int"), frame([(1,), (2,), (3,)], "x int")
    assert rows_of(layers.differing_rows(left, right)) == [(1, "left", 1), (3, "right", 1)]
    assert layers.differing_rows(left, left).count() == 0


def test_best_association_per_identifier(frame):
    rows = frame([("rs1", 1e-5, 1), ("rs1", 1e-9, 2), ("rs1", None, 3), (None, 0.1, 4), (None, None, 5), ("rs2", None, 6)], "rsid string, p_value double, k int")
    assert rows_of(ranking.best_per_rsid(rows, ["k"]).select("k")) == [(2,), (4,), (5,), (6,)]
    assert [row.k for row in ranking.top_associations(rows, ["k"], 3).collect()] == [2, 4, 5]
    assert ranking.top_associations(rows, ["k"], 0).count() == 1
    assert [row.k for row in ranking.top_associations(rows, ["k"], 2, deduplicate=False).collect()] == [2, 1]


def test_cap_tells_whether_more_was_there(frame):
    rows = frame([("a", "1", p, "A", "G") for p in range(3)] + [("b", "1", p, "A", "G") for p in range(4)], "genome string, chrom string, pos long, ref string, alt string")
    assert rows_of(ranking.capped(rows, 3).select("genome", "pos", "truncated")) == [("a", p, False) for p in range(3)] + [("b", p, True) for p in range(3)]


def test_traits_for_gene_with_unknown_p(frame):
    rows = frame([("FTO", "BMI", "body mass", None), ("FTO - X", "bmi", "body", 1e-9), ("FTO", "Height", None, None)], "mapped_gene string, trait string, mapped_trait string, p_value double")
    assert rows_of(aggregates.traits_for_gene(rows, "fto")) == [("Height", None, None, 1), ("bmi", "body", 1e-9, 2)]


def test_star_alleles_meet_by_identifier(frame):
    tables = {
        "pair": frame([("x", "A", None, None, "G1"), ("y", "A", None, None, "G2")], "drugname string, cpiclevel string, pgxtesting string, guidelineurl string, genesymbol string"),
        "gene": frame([("G1", "chr10"), ("G2", None)], "symbol string, chr string"),
        "allele": frame([("G1", "*2", "No function")], "genesymbol string, name string, clinicalfunctionalstatus string"),
        "allele_definition": frame([(1, "G1", "*2"), (2, "G1", "*3")], "id long, genesymbol string, name string"),
        # two locations share an identifier, so each carries the other's star alleles; the first place is kept
        "sequence_location": frame(
            [(10, "G1", "rs1", "g.5C>T", 5), (11, "G1", "rs1", "g.6C>T", 6), (12, "G1", "rs2", "g.7C>T", 7), (13, "G1", "rs3", "g.8_9insA", 8), (14, "G2", "rs4", "g.5C>T", 5)],
            "id long, genesymbol string, dbsnpid string, chromosomelocation string, position long",
        ),
        "allele_location_value": frame([(1, 10, "T"), (2, 11, "T")], "alleledefinitionid long, locationid long, variantallele string"),
    }
    got = reference_builds.star_allele_table(tables).select("gene", "rsid", "chrom", "pos", "star_allele", "function_impact")
    assert rows_of(got) == [("G1", "rs1", "10", 5, "*2", "No function"), ("G1", "rs1", "10", 5, "*3", None), ("G1", "rs2", "10", 7, None, None)]


def test_warning_list(frame):
    a, b, c = (frame([(s,) for s in text], "symbol string") for text in ("ABCD", "BCDE", "D"))
    assert [row.symbol for row in reference_builds.warning_gene_list(a, b, c).collect()] == ["B", "C"]


def test_pair_of_genomes(cohort):
    got = joins.pair_genomes(cohort.calls, "g1", "g2").filter("pos in (21178615, 117559590)")
    assert rows_of(got.select("pos", "display_1", "display_2")) == [(117559590, None, "ATCT/A"), (21178615, "T/C", "T/T")]


def test_coverage_of_an_empty_table(spark):
    assert rows_of(aggregates.rsid_coverage(spark.createDataFrame([], schemas.ANNOTATIONS))) == [(0, 0, False)]


def test_records_with_empty_groups(cohort):
    records = joins.variant_records(joins.annotate(cohort.calls, cohort.annotations))
    row = records.filter("genome = 'g1' AND pos = 21178900").first()
    assert row.annotation is None and row.clinvar.significance == "Likely benign" and row.population_freq["global"] == 0.001
    row = records.filter("pos = 21178960").first()
    assert row.annotation is None and row.clinvar is None and row.population_freq is None and row.genotype.display == "A/G"
    assert records.filter(F.col("rsid") == "rs5").count() == 1


def test_pairs_and_repeated_records(spark):
    """A genome without a call has a row of its own; one record per genome and site speaks for it."""
    schema = "genome string, chrom string, pos long, id string, ref string, alt string, gt string"
    calls = spark.createDataFrame([("g1", "1", 5, "rs5", "A", "G", "0/1"), ("g1", "1", 5, "rs5", "A", "G", "0/0"), ("g2", "1", 5, "rs5", "A", "G", "1/1"), ("g1", "1", 9, "rs9", "C", "T", "0/1")], schema)
    pair = joins.pair_genomes(calls, "g1", "g2").filter("pos = 5").first()
    assert (pair.display_1, pair.zygosity_1, pair.display_2, pair.zygosity_2) == ("A/A", "homozygous_ref", "G/G", "homozygous_alt")
    notes = spark.createDataFrame([("1", 5, "A", "G", "rs5", "X"), ("1", 9, "C", "T", "rs9", "Y")], "chrom string, pos long, ref string, alt string, rsid string, gene string")
    rows = joins.rsid_batch(calls, notes, ["rs9", "rs404"], ["g1", "g2"]).select("rsid", "genome", "found", "pos")
    assert rows_of(rows) == [("rs404", "g1", False, None), ("rs404", "g2", False, None), ("rs9", "g1", True, 9), ("rs9", "g2", False, None)]


def test_limits_are_the_callers(spark):
    rows = spark.range(900).selectExpr("concat('rs', id) AS rsid", "id / 1000D AS p_value", "id AS k")
    assert ranking.top_associations(rows, ["k"], 500).count() == 500


def test_cohort_scores_list_every_genome(cohort):
    listed = Cohort(cohort.calls, cohort.annotations, prs_weights=cohort.prs_weights, genomes=("g1", "g2", "silent"))
    from allelespan.plans import traits

    got = traits.calculate_prs(listed, trait=cohort.prs_weights.first().trait, genome=ALL_GENOMES)
    assert {r.genome for r in got.collect()} == {"g1", "g2", "silent"}
    assert got.filter("genome = 'silent' AND score = 0 AND found = 0").count() == got.select("prs_id").distinct().count()
