"""Readers and writers on small files."""

import gzip

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from allelespan.functions.contigs import accession_table
from allelespan.operators.layers import fingerprints
from allelespan.sources import sinks, tables, vcf
from helpers import rows_of

FAILED = (PySparkException, Py4JJavaError)
HEADER = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{}\n"


def test_vcf_records(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(
        HEADER.format("NA1")
        + "chr12\t21178615\trs4149056\tT\tC\t.\tPASS\tCLNSIG=drug_response;AF=0.14\tGT\t0/1\n"
        + "chrM\t5\t.\tA\tG\t.\tPASS\tAF_grpmax=0.2\tGT\t1\n"
        + "short\tline\n\n"
    )
    got = vcf.parse_vcf(vcf.read_vcf_lines(spark, str(tmp_path)), ["AF", "CLNSIG"])
    assert rows_of(got) == [("12", 21178615, "T", "C", "rs4149056", "0.14", "drug_response"), ("MT", 5, "A", "G", None, None, None)]


def test_many_member_gzip(spark, tmp_path):
    """Block-gzipped files are gzip files of many members."""
    members = [gzip.compress(f"1\t{i}\t.\tA\tG\t.\t.\tDP=1\n".encode()) for i in range(1, 6)]
    (tmp_path / "a.vcf.gz").write_bytes(b"".join(members))
    assert vcf.parse_vcf(vcf.read_vcf_lines(spark, str(tmp_path))).count() == 5


def test_samples_of_several_files(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(HEADER.format("S1\tS2") + "1\t10\t.\tA\tG\t.\t.\t.\tGT:DP\t0/1:5\t1/1:6\n")
    (tmp_path / "b.vcf").write_text(HEADER.format("S3\tS1x") + "2\t20\trs1\tC\tT\t.\t.\t.\tGT\t./.\t0|1\n")
    lines = vcf.read_vcf_lines(spark, str(tmp_path))
    assert rows_of(vcf.parse_calls(lines).select("genome", "chrom", "pos", "gt")) == [
        ("S1", "1", 10, "0/1"), ("S1x", "2", 20, "0|1"), ("S2", "1", 10, "1/1"), ("S3", "2", 20, "./."),
    ]
    assert rows_of(vcf.parse_one_sample(lines).select("genome", "gt")) == [("S1", "0/1"), ("S3", "./.")]
    with pytest.raises(FAILED, match="S2"):
        vcf.parse_one_sample(lines, "S2").collect()  # file b has no such sample


def test_layers_from_differing_contig_spellings(spark, tmp_path):
    (tmp_path / "dbsnp.vcf").write_text("NC_000022.11\t7\trs9\tA\tG\t.\t.\tRS=9\nNC_000022.11\t8\t.\tA\tG\t.\t.\tRS=9\nNT_1\t9\trs8\tA\tG\t.\t.\t.\n")
    got = vcf.identifier_layer(vcf.read_vcf_lines(spark, str(tmp_path)), accession_table(spark))
    assert rows_of(got) == [("22", 7, "A", "G", "rs9"), ("NT_1", 9, "A", "G", "rs8")]


def test_frequency_layer(spark, frame):
    info = ["AF=0.14;AF_grpmax=0.21", "AF_popmax=0.3;AF_grpmax=0.1", "AF_popmax=;AF_grpmax=0.18", "AF=.,.", "DP=1", "AF_popmax=x;AF_grpmax=0.1;AF=0.2"]
    lines = frame([(f"1\t{i}\t.\tA\tG\t.\t.\t{text}",) for i, text in enumerate(info)], "value string")
    assert rows_of(vcf.frequency_layer(lines).select("pos", "af", "af_grpmax")) == [(0, 0.14, 0.21), (1, None, 0.3), (2, None, 0.18), (5, 0.2, None)]


def test_clinical_layer_drops_unset(spark, frame):
    info = ["CLNSIG=Benign;CLNDN=a_b", "CLNSIG=;CLNDN=x", "CLNDN=x", "CLNSIG=."]
    lines = frame([(f"1\t{i}\t.\tA\tG\t.\t.\t{text}",) for i, text in enumerate(info)], "value string")
    assert rows_of(vcf.clinical_layer(lines).select("pos", "clnsig", "clndn", "clnrevstat")) == [(0, "Benign", "a_b", None), (3, ".", None, None)]


def test_seed_files(spark, tmp_path):
    good = tmp_path / "genes.tsv"
    good.write_text("# note\n# note\nsymbol\tname\tchrom\tstart\tend\tstrand\nBRCA1\t.\tchr17\t43044295\t43170245\t-\nX1\t\tchrX\t1\t2\t+\n")
    assert rows_of(tables.read_seed(spark, str(good), "genes")) == [("BRCA1", None, "17", 43044295, 43170245, "-"), ("X1", None, "X", 1, 2, "+")]
    bad = tmp_path / "bad.tsv"
    bad.write_text("symbol\ttitle\tchrom\tstart\tend\tstrand\nBRCA1\tx\tchr17\t1\t2\t-\n")
    with pytest.raises(FAILED):
        tables.read_seed(spark, str(bad), "genes").collect()
    typo = tmp_path / "typo.tsv"
    typo.write_text("symbol\tname\tchrom\tstart\tend\tstrand\nBRCA1\tx\tchr17\tone\t2\t-\n")
    with pytest.raises(FAILED):
        tables.read_seed(spark, str(typo), "genes").collect()


def test_gwas_rows(spark, tmp_path):
    row = ["-"] * 38
    row[7], row[11], row[12], row[14], row[20], row[21] = " Type 2 diabetes ", "16", "53786615", "FTO", "rs9939609-A", "rs9939609"
    row[26], row[27], row[30], row[31], row[34], row[36] = "NR", "5E-120", "1.34", '"[1.2-1.4] ""x"""', "", "GCST1"
    blank = list(row)
    blank[7] = "  "
    old = row[:36]
    (tmp_path / "g.tsv").write_text("\n".join(["DATE ADDED TO CATALOG\tPUBMEDID", "\t".join(row), "\t".join(blank), "a\tb", "\t".join(old)]) + "\n")
    raw = tables.read_gwas_rows(spark, str(tmp_path / "g.tsv"))
    got = rows_of(tables.gwas_associations(raw).select("rsid", "chrom", "pos", "trait", "risk_allele", "risk_allele_freq", "p_value", "or_beta", "ci_text", "mapped_trait", "study_accession"))
    known = ("rs9939609", "16", 53786615, "Type 2 diabetes", "A", None, 5e-120, 1.34, '[1.2-1.4] "x"', None)
    assert got == [(*known, "GCST1"), (*known, None)]
    assert raw.filter("NOT loaded").count() == 2


def test_scoring_file(spark, tmp_path):
    (tmp_path / "PGS000010_hmPOS_GRCh38.txt").write_text(
        "#pgs_id=PGS000010\nchr_name\tchr_position\trsID\teffect_allele\tother_allele\teffect_weight\thm_rsID\thm_chr\thm_pos\n"
        "1\t100\trs1\tA\tG\t0.5\trs1\t1\t200\n1\t101\trs2\tA\tG\t-0.25\t\t\t\nGL1\t1\trs3\tA\tG\t1\t\t\t\n1\t\trs4\tA\tG\t1\t\t\t\n1\t5\trs5\tA\tG\tbad\t\t\t\n"
    )
    scores = spark.createDataFrame([("PGS000010", "PGS000010", "CAD")], "file_stem string, prs_id string, trait string")
    got = tables.score_weights(tables.read_scoring_files(spark, str(tmp_path)), scores)
    assert rows_of(got) == [("PGS000010", "CAD", "rs1", "1", 200, "A", 0.5), ("PGS000010", "CAD", "rs2", "1", 101, "A", -0.25)]


def test_layer_store(spark, frame, tmp_path):
    store = sinks.LayerStore(spark, str(tmp_path / "store"))
    schema = "chrom string, pos long, ref string, alt string, clnsig string, clndn string, clnrevstat string"
    old = frame([("1", 5, "A", "G", "Benign", None, None), ("X", 6, "A", "G", "Benign", None, None)], schema)
    assert store.read("clinvar") is None
    assert store.write("clinvar", old) == 1
    broken = old.withColumn("clnsig", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(FAILED):
        store.write("clinvar", broken)
    assert store.versions("clinvar") == [1] and rows_of(store.read("clinvar")) == rows_of(old)
    assert store.write("clinvar", old.filter("chrom = 'X'")) == 2
    assert rows_of(store.read("clinvar").select("chrom", "pos")) == [("X", 6)]
    store.clear("clinvar")
    assert store.read("clinvar") is None
    for call in (lambda: store.read("nope"), lambda: store.clear("nope"), lambda: store.clear("sites")):
        with pytest.raises(ValueError):
            call()


def test_replace_chromosomes(spark, frame, tmp_path):
    schema = "chrom string, pos long, ref string, alt string, note string"
    path = str(tmp_path / "sites")
    sinks.write_sites(frame([("1", 1, "A", "G", "old"), ("2", 2, "A", "G", "old")], schema), path)
    sinks.replace_chromosomes(frame([("2", 3, "A", "G", "new")], schema), path)
    assert rows_of(tables.read_sites(spark, path)) == [("1", 1, "A", "G", "old"), ("2", 3, "A", "G", "new")]


def test_fingerprints(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("x")
    (tmp_path / "b.vcf").write_text("xyz")
    assert sorted(row.size for row in fingerprints(spark, str(tmp_path)).collect()) == [1, 3]


def test_scoring_files_are_read_by_column_name(spark, tmp_path):
    """Published files differ in their columns and in their order."""
    (tmp_path / "A_hmPOS_GRCh38.txt").write_text("#x\nrsID\tchr_name\tchr_position\teffect_allele\tother_allele\teffect_weight\tallelefrequency_effect\thm_source\thm_rsID\thm_chr\thm_pos\thm_inferOtherAllele\nrs1\t1\t5\tA\tG\t0.5\t0.1\tliftover\trs9\t2\t50\t\n")
    (tmp_path / "B_hmPOS_GRCh38.txt").write_text("#y\neffect_weight\teffect_allele\tchr_position\tchr_name\trsID\n0.25\tT\t7\t3\trs2\n")
    (tmp_path / "C_hmPOS_GRCh38.txt").write_text("#z\neffect_weight\teffect_allele\tchr_position\tchr_name\trsID\n1.5\tC\t8\tX\trs3\n")
    scores = spark.createDataFrame([(s, s, "t") for s in "ABC"], "file_stem string, prs_id string, trait string")
    got = tables.score_weights(tables.read_scoring_files(spark, str(tmp_path)), scores)
    assert rows_of(got) == [("A", "t", "rs9", "2", 50, "A", 0.5), ("B", "t", "rs2", "3", 7, "T", 0.25), ("C", "t", "rs3", "X", 8, "C", 1.5)]
    with pytest.raises(ValueError):
        tables.read_scoring_files(spark, [str(tmp_path / "none")]) if (tmp_path / "none").write_text("#only comments\n") else None
