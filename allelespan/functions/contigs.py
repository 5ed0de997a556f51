"""Chromosome names, regions and genome order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelespan.fixed_values import GRCH38_ACCESSIONS
from allelespan.session import local_table

REGION_PATTERN = r"^chr[\dXYMT]{1,2}:\d+-\d+$"
RSID_PATTERN = r"^rs\d+$"


def normalize_chrom(contig: Column) -> Column:
    """Bare chromosome name: no ``chr``, and ``M`` becomes ``MT``."""
    bare = F.when(contig.startswith("chr"), F.substring(contig, 4, 1 << 20)).otherwise(contig)
    return F.when(bare == "M", F.lit("MT")).otherwise(bare)


def chr_name(chrom: Column) -> Column:
    """Bare name with the ``chr`` prefix."""
    return F.concat(F.lit("chr"), chrom)


def accession_table(spark: SparkSession) -> DataFrame:
    """The 25 RefSeq accessions of GRCh38 and their bare chromosome names."""
    return local_table(spark, GRCH38_ACCESSIONS, "contig string, new_name string")


def rename_contigs(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Replace contig names found in ``names(contig, new_name)``; others stay as they are.

    ``names`` has one row per contig of an assembly. Spark broadcasts it if its size allows.
    """
    lookup = names.select(F.col("contig").alias(column), F.col("new_name").alias("_new_name"))
    renamed = df.join(lookup, column, "left")
    return renamed.withColumn(column, F.coalesce("_new_name", column)).select(*df.columns)


def contig_in_style(chrom: Column, uses_chr: Column, mito_name: Column | None = None) -> Column:
    """Bare name rendered in a file's own spelling; ``mito_name`` is the file's mitochondrial contig, if it has one."""
    spelled = F.when(uses_chr, chr_name(chrom)).otherwise(chrom)
    return spelled if mito_name is None else F.when((chrom == "MT") & mito_name.isNotNull(), mito_name).otherwise(spelled)


def chrom_rank(chrom: Column) -> Column:
    """1..22, X=23, Y=24, M and MT=25, everything else 99; works on bare and ``chr`` names."""
    bare = normalize_chrom(chrom)
    number = bare.try_cast("int")
    return (
        F.when(bare == "X", 23)
        .when(bare == "Y", 24)
        .when(bare == "MT", 25)
        .when(number.between(1, 22), number)
        .otherwise(99)
    )


def is_catalog_chrom(chrom: Column) -> Column:
    """Digits, X, Y, M or MT, with or without ``chr``; keeps scaffolds and patches out of the gene catalogue."""
    return chrom.rlike(r"^(chr)?([0-9]+|X|Y|M|MT)$")


def is_score_chrom(chrom: Column) -> Column:
    """Digits, X, Y or MT, as polygenic scoring files spell them."""
    return chrom.rlike(r"^([0-9]+|X|Y|MT)$")


def gwas_chrom(text: Column) -> Column:
    """``chr`` name for 1..22, X, Y and MT, otherwise NULL."""
    bare = F.trim(text)
    number = bare.try_cast("int")
    return F.when(bare.isin("X", "Y", "MT"), chr_name(bare)).when(number.between(1, 22), chr_name(number.cast("string")))


def region_parts(region: Column) -> Column:
    """``chrom:start-end`` as a struct of bare chrom, start and end."""
    span = F.substring_index(region, ":", -1)
    return F.struct(
        normalize_chrom(F.substring_index(region, ":", 1)).alias("chrom"),
        F.substring_index(span, "-", 1).try_cast("bigint").alias("start_pos"),
        F.substring_index(span, "-", -1).try_cast("bigint").alias("end_pos"),
    )


def bare_chrom(name: str) -> str:
    """The same rule as ``normalize_chrom`` for one name given as a parameter."""
    bare = name.removeprefix("chr")
    return "MT" if bare == "M" else bare


def parse_region(region: str) -> tuple[str, int, int]:
    """A region given as a parameter; raises ValueError if it is malformed."""
    if not re.match(REGION_PATTERN, region):
        raise ValueError(f"not a region: {region!r}; expected chr<N>:<start>-<end>")
    chrom, span = region.split(":")
    start, end = span.split("-")
    return bare_chrom(chrom), int(start), int(end)


def check_rsid(rsid: str) -> str:
    """An identifier given as a parameter; raises ValueError if it is malformed."""
    if not re.match(RSID_PATTERN, rsid):
        raise ValueError(f"not an rs identifier: {rsid!r}")
    return rsid
