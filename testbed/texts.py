"""Source files laid out from the domain tables, as text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.functions.contigs import accession_table
from allelespan.session import local_table
from testbed.registry import Tables

EFFECT_INFO = """
    CASE WHEN gene IS NOT NULL THEN 'DP=10;ANN=' || alt || '|' || effect || '|' || impact || '|' || gene || '|ENSG|transcript|' || transcript
              || '|protein_coding|1/1|' || hgvs_c || '|' || hgvs_p || '|1/2|,T|other_variant|LOW|OTHER|ENSG|transcript|ENST|x|1/1|c.1|p.1|'
         WHEN k % 23 = 5 THEN 'ANN=A|short' ELSE 'DP=10' END"""
# a comma would end the first entry, so its allele field holds one allele
EFFECT_INFO = EFFECT_INFO.replace("'DP=10;ANN=' || alt ||", "'DP=10;ANN=' || substr(alt, 1, 1) ||")
CLINICAL_INFO = """
    'ALLELEID=' || cast(k AS string) || coalesce(';CLNDN=' || clndn, '') || coalesce(';CLNREVSTAT=' || clnrevstat, '')
    || CASE WHEN clnsig IS NOT NULL THEN ';CLNSIG=' || clnsig WHEN k % 2 = 0 THEN ';CLNSIG=' ELSE '' END"""
FREQUENCY_INFO = """
    'AN=100' || CASE WHEN af_grpmax IS NULL THEN CASE WHEN k % 3 = 0 THEN ';AF_grpmax=.' ELSE '' END
                     WHEN k % 3 = 1 THEN ';AF_popmax=' || cast(af_grpmax AS string) || ';AF_grpmax=0.999'
                     WHEN k % 3 = 2 THEN ';AF_popmax=;AF_grpmax=' || cast(af_grpmax AS string)
                     ELSE ';AF_grpmax=.,' || cast(af_grpmax AS string) END
             || CASE WHEN af IS NULL THEN CASE WHEN k % 4 = 2 THEN ';AF=.,.' ELSE '' END
                     WHEN k % 29 = 0 THEN ';AF=.,' || cast(af AS string) ELSE ';AF=' || cast(af AS string) || CASE WHEN k % 31 = 0 THEN ',0.5' ELSE '' END END"""


def with_headers(t: Tables, lines: DataFrame, *extra: str) -> DataFrame:
    """Lines plus file headers a record that is too short to count, and one whose position is no number."""
    head = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO", "1\t17\t.\tA\tC", "1\tx12\trs1\tA\tC\t.\tPASS\tCLNSIG=x;AF=0.5;ANN=C|x|HIGH|X", *extra]
    return lines.unionByName(local_table(t.spark, [(line,) for line in head], "value string"))


def site_lines(t: Tables, info: str, identifier: str = "vcf_id", contig: str = "CASE WHEN chrom = 'MT' THEN 'chrM' ELSE 'chr' || chrom END") -> DataFrame:
    """One line per site."""
    fields = f"{contig}, cast(pos AS string), coalesce({identifier}, '.'), ref, alt, '.', 'PASS', {info}"
    return with_headers(t, t.sql(f"SELECT concat_ws('\t', {fields}) AS value FROM d_sites"))


def identifier_lines(t: Tables) -> DataFrame:
    """One line per site under its RefSeq accession."""
    named = t.sites.join(accession_table(t.spark).withColumnRenamed("new_name", "chrom"), "chrom")
    columns = ["contig", F.col("pos").cast("string"), F.coalesce("dbsnp_id", F.lit(".")), "ref", "alt", F.lit("."), F.lit("."), F.lit("RS=1")]
    return with_headers(t, named.select(F.concat_ws("\t", *columns).alias("value")))


# a stretch of a chromosome, so that a large chromosome becomes many files
STRETCH = "chrom || '_' || cast(cast(floor(pos / 100000) AS bigint) AS string)"


def write_files(t: Tables, lines: DataFrame, head: list[str]) -> str:
    """One text file per ``file_key`` of ``lines(value, file_key)``, each beginning with the head lines."""
    path = t.folder()
    heads = lines.select("file_key").distinct().select(F.posexplode(F.array(*map(F.lit, head))).alias("place", "value"), "file_key")
    body = lines.select(F.lit(len(head)).alias("place"), "value", "file_key")
    whole = heads.unionByName(body).repartition("file_key").sortWithinPartitions("file_key", "place")
    whole.select("value", "file_key").write.partitionBy("file_key").text(path)
    return path


def sample_files(t: Tables) -> str:
    """Three-sample files: one line per called site, samples S0, S1 and S2."""
    cells = ", ".join(f"coalesce(min(CASE WHEN s % 3 = {i} THEN gt END), './.') || ':30:{i}'" for i in range(3))
    fields = f"'chr' || chrom, cast(pos AS string), coalesce(id, '.'), ref, alt, '.', 'PASS', 'DP=3', 'GT:DP:GQ', {cells}"
    lines = t.sql(f"SELECT concat_ws('\t', {fields}) AS value, {STRETCH} AS file_key FROM d_calls GROUP BY chrom, pos, id, ref, alt")
    head = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS0\tS1\tS2"]
    return write_files(t, lines, head)


GWAS_HEADER = "DATE ADDED TO CATALOG\tPUBMEDID\tFIRST AUTHOR\tDATE\tJOURNAL\tLINK\tSTUDY\tDISEASE/TRAIT"


def gwas_lines(t: Tables) -> DataFrame:
    """Catalogue rows of 37 columns; every order gives one, and some give a malformed one besides."""
    chrom = "CASE WHEN chrom IN ('X', 'Y', 'MT') THEN chrom ELSE ' ' || chrom END"
    cells = {
        0: "'2020-01-01'", 1: "pubmed_id", 2: "' ' || first_author", 7: "trait || ' '", 9: "CASE WHEN k % 7 = 0 THEN '\"two\tcells\"' ELSE '-' END", 11: chrom, 12: "cast(pos AS string)",
        14: "coalesce(mapped_gene, '')", 20: "coalesce(rsid, 'x') || '-' || coalesce(risk_allele, '?')",
        21: "CASE WHEN rsid IS NULL THEN 'chr1:55; kgp7' WHEN k % 3 = 0 THEN 'kgp1; ' || rsid || '-A' ELSE rsid || '; rs0' END",
        26: "coalesce(cast(risk_allele_freq AS string), 'NR')", 27: "coalesce(cast(p_value AS string), 'NS')",
        30: "coalesce(cast(or_beta AS string), '')", 31: "CASE WHEN k % 2 = 0 THEN '\"' || ci_text || '\"' ELSE coalesce(ci_text, ' ') END",
        34: "coalesce(mapped_trait, '')", 36: "study_accession",
    }
    row = ", ".join(cells.get(i, "'-'") for i in range(37))
    rows = t.sql(f"SELECT concat_ws('\t', {row}) AS value FROM d_gwas")
    # per customer a row that is too short
    short = t.sql("SELECT concat_ws('\t', 'short', cast(c_custkey AS string)) AS value FROM customer")
    head = local_table(t.spark, [(GWAS_HEADER,)], "value string")
    return head.unionByName(rows).unionByName(short)
