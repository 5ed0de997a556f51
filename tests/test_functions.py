"""Column functions on single values."""

import pytest
from pyspark.sql import functions as F

from allelespan.functions import associations, clinical, contigs, genotypes, numbers, vcf_fields


def values(spark, expression, rows, names):
    frame = spark.createDataFrame([row if isinstance(row, tuple) else (row,) for row in rows], ", ".join(f"{n} string" for n in names))
    return [row[0] for row in frame.select(expression).collect()]


def test_chromosome_names(spark):
    given = ["chr1", "1", "chrX", "M", "chrM", "chrMT", "MT", "chrUn"]
    assert values(spark, contigs.normalize_chrom(F.col("c")), given, ["c"]) == ["1", "1", "X", "MT", "MT", "MT", "MT", "Un"]
    assert values(spark, contigs.gwas_chrom(F.col("c")), ["1", " 22 ", "23", "0", "X", "MT", "M", "", "1a"], ["c"]) == [
        "chr1", "chr22", None, None, "chrX", "chrMT", None, None, None,
    ]
    assert values(spark, contigs.chrom_rank(F.col("c")), ["chr2", "10", "X", "chrY", "M", "chrMT", "GL1"], ["c"]) == [2, 10, 23, 24, 25, 25, 99]


def test_accessions_are_the_grch38_set(spark):
    table = {row.contig: row.new_name for row in contigs.accession_table(spark).collect()}
    assert len(table) == 25
    assert table["NC_000001.11"] == "1" and table["NC_000022.11"] == "22"
    assert table["NC_000023.11"] == "X" and table["NC_000024.10"] == "Y" and table["NC_012920.1"] == "MT"


def test_contig_in_a_files_own_spelling(spark):
    rows = [("MT", "chrM"), ("MT", None), ("7", "chrM")]
    spelled = contigs.contig_in_style(F.col("c"), F.lit(True), F.col("m"))
    assert values(spark, spelled, rows, ["c", "m"]) == ["chrM", "chrMT", "chr7"]
    assert values(spark, contigs.contig_in_style(F.col("c"), F.lit(False), F.col("m")), [("MT", None)], ["c", "m"]) == ["MT"]


def test_parameters_are_checked():
    assert contigs.parse_region("chr22:10-20") == ("22", 10, 20)
    assert contigs.parse_region("chrMT:1-2") == ("MT", 1, 2)
    for bad in ("22:10-20", "chr22:10", "chr22", "chrABC:1-2"):
        with pytest.raises(ValueError):
            contigs.parse_region(bad)
    for bad in ("rs", "12", "rs12x"):
        with pytest.raises(ValueError):
            contigs.check_rsid(bad)


@pytest.mark.parametrize(
    "info, expected",
    [("AF=0.1;DP=3", "0.1"), ("DP=3;AF=0.1", "0.1"), ("AF_grpmax=0.5", None), ("AF_grpmax=0.5;AF=0.2", "0.2"), ("XAF=1", None), ("AF=", ""), ("AF", None), ("AF=1;AF=2", "1"), ("", None), ("AF=a=b", "a=b")],
)
def test_info_field(spark, info, expected):
    assert values(spark, vcf_fields.info_field(F.col("i"), "AF"), [info], ["i"]) == [expected]


def test_effect_entry_needs_eleven_parts(spark):
    full = "T|missense_variant|MODERATE|SLCO1B1|g|transcript|NM_1|coding|5/15|c.521T>C|p.Val174Ala|1,T|other|HIGH|X"
    got = values(spark, vcf_fields.effect_fields(F.col("a")), [full, "T|missense", "", ".", None], ["a"])
    assert tuple(got[0]) == ("SLCO1B1", "missense_variant", "MODERATE", "NM_1", "c.521T>C", "p.Val174Ala")
    assert got[1:] == [None, None, None, None]


def test_first_frequency(spark):
    given = ["0.03,.", ".,0.05", ".,.", "0.14", "1e-5", "", None, "x,0.2", "7d"]
    assert values(spark, vcf_fields.first_frequency(F.col("f")), given, ["f"]) == [0.03, 0.05, None, 0.14, 1e-5, None, None, 0.2, None]


@pytest.mark.parametrize(
    "gt, ref, alt, display, zygosity",
    [
        ("0/1", "T", "C", "T/C", "heterozygous"),
        ("1|0", "T", "C", "C/T", "heterozygous"),
        ("0/0", "T", "C", "T/T", "homozygous_ref"),
        ("1/1", "T", "C", "C/C", "homozygous_alt"),
        ("1/2", "A", "T,G", "T/G", "heterozygous"),
        ("2/2", "A", "T,G", "G/G", "homozygous_alt"),
        ("./.", "A", "G", "no call", "no_call"),
        (".|.", "A", "G", "no call", "no_call"),
        (".", "A", "G", "no call", "no_call"),
        ("0/.", "A", "G", "no call", "no_call"),
        (None, "A", "G", "no call", "no_call"),
        ("1", "A", "G", "G", "heterozygous"),
        ("0/3", "A", "G", "A/?", "heterozygous"),
        ("0/0/1", "A", "G", "A/A/G", "homozygous_ref"),
        ("0/1", "ATCT", "A", "ATCT/A", "heterozygous"),
    ],
)
def test_genotype(spark, gt, ref, alt, display, zygosity):
    genotype = genotypes.genotype_struct(genotypes.called_alleles(F.col("g"), F.col("r"), F.col("a")), F.col("r"))
    assert tuple(values(spark, genotype, [(gt, ref, alt)], ["g", "r", "a"])[0]) == (display, zygosity)


def test_dosage(spark):
    count = genotypes.dosage(genotypes.called_alleles(F.col("g"), F.lit("A"), F.lit("G")), F.col("e"))
    rows = [("0/1", "G"), ("1/1", "G"), ("0/0", "G"), ("./.", "G"), ("1", "G"), ("0/0", "A"), ("1/1/1", "G"), ("1/1", "T")]
    assert values(spark, count, rows, ["g", "e"]) == [1, 2, 0, 0, 1, 2, 3, 0]


def test_variant_class(spark):
    rows = [("A", "G"), ("A", "G,T"), ("ATCT", "A"), ("A", "GT"), ("A", "G,TT"), ("A", "."), ("A", "TTT,G")]
    assert values(spark, genotypes.variant_class(F.col("r"), F.col("a")), rows, ["r", "a"]) == ["SNP", "SNP", "Indel", "Indel", "Indel", None, "Indel"]
    assert values(spark, genotypes.alt_count(F.col("a")), rows, ["r", "a"]) == [1, 2, 1, 1, 2, 0, 2]


def test_clinical_fields(spark):
    fields = clinical.clinical_struct(F.col("a"), F.col("b"), F.col("c"))
    got = values(spark, fields, [("drug_response", "Statin_response", "."), (".", "x", "y"), ("", "x", "y"), ("Benign", None, "a_b")], ["a", "b", "c"])
    assert tuple(got[0]) == ("drug response", "Statin response", None)
    assert got[1] is None and got[2] is None
    assert tuple(got[3]) == ("Benign", None, "a b")


@pytest.mark.parametrize(
    "known, impact, clnsig, af, hidden",
    [
        (True, "LOW", None, 0.9, False),
        (False, "HIGH", None, 0.9, False),
        (False, "MODERATE", "Pathogenic", 0.9, False),
        (False, "MODERATE", "Benign/Likely_pathogenic", 0.9, False),
        (False, "MODERATE", "risk_factor", 0.9, False),
        (False, "MODERATE", None, 0.3, True),
        (False, "MODERATE", None, 0.05, False),
        (False, "MODERATE", None, 0.01, False),
        (False, "MODERATE", "Benign", 0.3, True),
        (False, "MODERATE", "Benign/Likely_benign", 0.3, True),
        (False, "MODERATE", "Benign, other", 0.3, False),
        (False, "MODERATE", "Uncertain_significance", 0.3, False),
        (False, "MODERATE", None, None, True),
        (False, None, None, None, True),
        (False, "MODERATE", "Benign", None, False),
        (False, "MODERATE", ".", None, True),
    ],
)
def test_smart_filter(spark, known, impact, clnsig, af, hidden):
    row = spark.createDataFrame([(known, impact, clnsig, af)], "known boolean, impact string, clnsig string, af double")
    verdict = clinical.is_suppressed(F.col("known"), F.col("impact"), F.col("clnsig"), F.col("af"))
    assert row.select(verdict).first()[0] is hidden


def test_association_fields(spark):
    given = ["rs12345", "rs12345; rs67890", "rs12345-A", "rsABC", "", None, "kgp1; rs7-?", "rs12 -A", "chr1:5;rs9 "]
    assert values(spark, associations.gwas_rsid(F.col("s")), given, ["s"]) == ["rs12345", "rs12345", "rs12345", None, None, None, "rs7", None, "rs9"]
    given = ["rs1-A", "rs1-?", "rs1", "rs1- ", "rs1-ACGTACGTAC", "rs1-ACGTACGTACG", "rs1-A-B", None]
    assert values(spark, associations.risk_allele(F.col("s")), given, ["s"]) == ["A", None, None, None, "ACGTACGTAC", None, "A-B", None]
    given = ["NR", "NS", "", "0.5", "5E-8", "about", None, "2f"]
    assert values(spark, numbers.to_double(F.col("s")), given, ["s"]) == [None, None, None, 0.5, 5e-8, None, None, None]
    assert values(spark, associations.gene_symbols(F.col("s")), ["FTO", "A - B", "A-B"], ["s"]) == [["FTO"], ["A", "B"], ["A-B"]]


def test_hgvs_alleles(spark):
    given = ["g.94761900C>T", "g.5del", "g.5delAG", "g.5_6insA", "", None]
    got = values(spark, associations.hgvs_alleles(F.col("s")), given, ["s"])
    assert [tuple(v) if v else None for v in got] == [("C", "T"), ("N", "del"), ("AG", "del"), None, None, None]


def test_gene_and_drug_texts(spark):
    given = ["BRCA1 DNA repair [Source:HGNC Symbol;Acc:HGNC:1100]", None, "plain", "a [Source:x] b [Source:y]"]
    assert values(spark, associations.clean_description(F.col("s")), given, ["s"]) == ["BRCA1 DNA repair", "", "plain", "a b"]
    rows = [("A", "Testing Required"), ("B", None), ("B", "")]
    assert values(spark, associations.drug_summary(F.col("l"), F.col("t")), rows, ["l", "t"]) == [
        "CPIC Level A drug-gene pair. PGx testing: Testing Required.", "CPIC Level B drug-gene pair.", "CPIC Level B drug-gene pair.",
    ]
