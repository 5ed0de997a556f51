"""Genotypes, zygosity, dosage and variant classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def called_alleles(gt: Column, ref: Column, alt: Column) -> Column:
    """Allele letters of a genotype; NULL if any allele is missing, ``?`` for an unknown index.

    One or two alleles, nearly all genotypes there are, are cut out as text; only higher ploidy takes
    the higher-order function.
    """
    plain = F.translate(gt, "|", "/")
    separators = F.length(plain) - F.length(F.replace(plain, F.lit("/"), F.lit("")))

    def letter(index: Column) -> Column:
        listed = F.get(F.split(alt, ","), index.try_cast("int") - 1)
        return F.when(index == "0", ref).when((index == "1") & ~alt.contains(","), alt).otherwise(F.coalesce(listed, F.lit("?")))

    first, last = letter(F.substring_index(plain, "/", 1)), letter(F.substring_index(plain, "/", -1))
    return (
        F.when(gt.isNull() | gt.contains("."), F.lit(None))
        .when(separators == 1, F.array(first, last))
        .when(separators == 0, F.array(first))
        .otherwise(F.transform(F.split(plain, "/"), letter))
    )


def zygosity_of(alleles: Column, ref: Column) -> Column:
    """Zygosity from the first two alleles; one allele alone counts as heterozygous."""
    first, second = F.get(alleles, F.lit(0)), F.get(alleles, F.lit(1))
    return (
        F.when(alleles.isNull(), F.lit("no_call"))
        .when((F.size(alleles) >= 2) & (first == second), F.when(first == ref, "homozygous_ref").otherwise("homozygous_alt"))
        .otherwise("heterozygous")
    )


def genotype_struct(alleles: Column, ref: Column) -> Column:
    """Display text (alleles joined by ``/``, phase dropped) and zygosity."""
    display = F.when(alleles.isNull(), F.lit("no call")).otherwise(F.array_join(alleles, "/"))
    return F.struct(display.alias("display"), zygosity_of(alleles, ref).alias("zygosity"))


def with_genotype(calls: DataFrame) -> DataFrame:
    """Calls with ``genotype{display, zygosity}`` added.

    The alleles are a step of their own: they are read several times and should be built once.
    """
    listed = calls.withColumn("_alleles", called_alleles(F.col("gt"), F.col("ref"), F.col("alt")))
    return listed.withColumn("genotype", genotype_struct(F.col("_alleles"), F.col("ref"))).drop("_alleles")


def zygosity_label(zygosity: Column) -> Column:
    """Short form for result tables."""
    return (
        F.when(zygosity == "homozygous_ref", "ref")
        .when(zygosity == "heterozygous", "het")
        .when(zygosity == "homozygous_alt", "hom alt")
        .when(zygosity == "no_call", "no call")
        .otherwise(zygosity)
    )


def dosage(alleles: Column, effect_allele: Column) -> Column:
    """How many called alleles equal the effect allele; 0 where nothing was called."""
    one = F.when(F.get(alleles, F.lit(0)) == effect_allele, 1).otherwise(0)
    two = F.when(F.get(alleles, F.lit(1)) == effect_allele, 1).otherwise(0)
    counted = F.when(F.size(alleles) <= 2, one + two).otherwise(
        F.size(F.filter(alleles, lambda allele: allele == effect_allele))
    )
    return F.when(alleles.isNull(), 0).otherwise(counted).cast("bigint")


def alt_count(alt: Column) -> Column:
    """Number of alternate alleles; ``.`` has none."""
    return F.when(alt == ".", 0).otherwise(F.length(alt) - F.length(F.replace(alt, F.lit(","), F.lit(""))) + 1)


def is_single_base(ref: Column, alt: Column) -> Column:
    """Reference and every alternate allele are one base long."""
    return (F.length(ref) == 1) & (alt != ".") & ((F.length(alt) == 1) | alt.rlike("^[^,](,[^,])*$"))


def variant_class(ref: Column, alt: Column) -> Column:
    """``SNP`` or ``Indel``, NULL where there is no alternate allele."""
    return F.when(alt_count(alt) == 0, F.lit(None)).when(is_single_base(ref, alt), "SNP").otherwise("Indel")
