"""Fields of association-study, drug-gene and gene-catalogue sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SNP_PART = r"(?:^|;)\s*(rs[0-9]+)(?:-[^;]*|\s*)(?:;|$)"


def gwas_rsid(snps: Column) -> Column:
    """First ``;`` part whose text before ``-`` is an rs identifier."""
    return F.nullif(F.regexp_extract(snps, _SNP_PART, 1), F.lit(""))


def risk_allele(text: Column) -> Column:
    """Text after the first ``-``; NULL if unknown, blank or longer than ten characters."""
    dash = F.instr(text, "-")
    allele = F.trim(F.substring(text, dash + F.lit(1), F.length(text)))
    return F.when((dash > 0) & (allele != "") & (allele != "?") & (F.length(allele) <= 10), allele)


def gene_symbols(mapped_gene: Column) -> Column:
    """Mapped genes ``A - B`` as an array of trimmed symbols."""
    return F.transform(F.split(mapped_gene, " - "), lambda part: F.trim(part))


def hgvs_alleles(hgvs: Column) -> Column:
    """Alleles of a genomic substitution or deletion name; NULL for anything else."""
    substitution = r"g\.[0-9]+([A-Z]+)>([A-Z]+)"
    deletion = r"g\.[0-9]+del([A-Z]*)"
    deleted = F.regexp_extract(hgvs, deletion, 1)
    return F.when(
        hgvs.rlike(substitution),
        F.struct(F.regexp_extract(hgvs, substitution, 1).alias("ref"), F.regexp_extract(hgvs, substitution, 2).alias("alt")),
    ).when(
        hgvs.rlike(deletion),
        F.struct(F.when(deleted == "", "N").otherwise(deleted).alias("ref"), F.lit("del").alias("alt")),
    )


def clean_description(text: Column) -> Column:
    """Gene description without its ``[Source:...]`` tail; missing becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\[Source:.*?\]", ""))


def drug_summary(level: Column, testing: Column) -> Column:
    """Sentence about evidence level and, where given, recommended testing."""
    tail = F.when(F.coalesce(testing, F.lit("")) != "", F.concat(F.lit(" PGx testing: "), testing, F.lit("."))).otherwise("")
    return F.concat(F.lit("CPIC Level "), F.coalesce(level, F.lit("")), F.lit(" drug-gene pair."), tail)
