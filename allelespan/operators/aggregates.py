"""Counts and summaries. All combine partial results before the shuffle, so hot groups are harmless."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelespan.functions.clinical import matches_significance
from allelespan.functions.contigs import RSID_PATTERN
from allelespan.functions.genotypes import alt_count, called_alleles, variant_class, zygosity_of
from allelespan.operators.filters import contains_ignoring_case
from allelespan.operators.joins import first_calls_at
from allelespan.schemas import SITE_KEY


def record_counts() -> dict[str, Column]:
    """Aggregates over calls: all records, SNPs, indels and multi-allelic records."""
    kind = variant_class(F.col("ref"), F.col("alt"))
    return {
        "total": F.count("*"),
        "snps": F.count_if(kind == "SNP"),
        "indels": F.count_if(kind == "Indel"),
        "multi_allelic": F.count_if(alt_count(F.col("alt")) > 1),
    }


def layer_counts() -> dict[str, Column]:
    """Aggregates over annotated calls: how many each layer reaches."""
    return {
        "snpeff": F.count("gene"),
        "clinvar": F.count("clnsig"),
        "gnomad": F.count(F.coalesce("af", "af_grpmax")),
        "dbsnp": F.count("rsid"),
    }


def _named(counts: dict[str, Column]) -> list[Column]:
    return [count.alias(name) for name, count in counts.items()]


def variant_stats(calls: DataFrame) -> DataFrame:
    """Per genome: all records, SNPs, indels and multi-allelic records."""
    return calls.groupBy("genome").agg(*_named(record_counts()))


def traits_for_gene(gwas: DataFrame, gene: str, n: int = 20) -> DataFrame:
    """Traits associated with a gene, ignoring case: best p-value, number of associations and the names of the best row."""
    best = F.struct(F.col("p_value").isNull().alias("unknown"), "p_value", "trait", "mapped_trait")
    grouped = (
        gwas.filter(contains_ignoring_case("mapped_gene", gene))
        .groupBy(F.upper("trait").alias("trait_key"))
        .agg(F.min(best).alias("best"), F.count("*").alias("n_associations"))
    )
    rows = grouped.select("best.trait", "best.mapped_trait", F.col("best.p_value").alias("best_pvalue"), "n_associations")
    return rows.orderBy(F.col("best_pvalue").asc_nulls_last(), "trait").limit(n)


def polygenic_scores(contributions: DataFrame, weights: DataFrame, genomes: Sequence[str] | None = None) -> DataFrame:
    """Per genome and score: sum of contributions, positions found, those without a called genotype, and all positions.

    Each of the named ``genomes`` gets a row for every score, with zeros where it has no call. Without names
    only genomes with calls have rows.
    """
    totals = weights.groupBy("prs_id").agg(F.min("trait").alias("trait"), F.count("*").alias("total"))
    found = contributions.groupBy("genome", "prs_id").agg(
        F.sum("contribution").alias("score"),
        F.count("*").alias("found"),
        F.count_if(F.col("alleles").isNull()).alias("no_call"),
    )
    if genomes is None:
        scores = found.join(totals, "prs_id")
    else:
        asked = totals.withColumn("genome", F.explode(F.array(*[F.lit(genome) for genome in genomes])))
        scores = asked.join(found, ["genome", "prs_id"], "left").fillna(0, ["score", "found", "no_call"])
    return scores.select("genome", "prs_id", "trait", "score", "found", "no_call", "total")


def significance_summary(annotated: DataFrame, term: str = "athogenic") -> DataFrame:
    """Per genome: calls whose significance contains the term, and how many genes they lie in."""
    hits = annotated.filter(matches_significance(F.col("clnsig"), term))
    per_gene = hits.groupBy("genome", "gene").agg(F.count("*").alias("calls"))
    named = F.when(F.coalesce("gene", F.lit("")) != "", 1)
    return per_gene.groupBy("genome").agg(F.sum("calls").alias("calls"), F.count(named).alias("genes"))


def non_reference_star_alleles(pgx_variants: DataFrame, calls: DataFrame, genes: list[str]) -> DataFrame:
    """Per genome and listed gene: star-allele rows with a call other than homozygous reference. Zero rows are left out."""
    rows = pgx_variants.filter(F.upper("gene").isin(*[gene.upper() for gene in genes]))
    called = first_calls_at(calls, rows)
    zygosity = zygosity_of(called_alleles(F.col("gt"), F.col("ref"), F.col("alt")), F.col("ref"))
    other = called.filter(zygosity != "homozygous_ref").select("genome", "chrom", "pos")
    return other.join(rows.select("gene", "chrom", "pos"), ["chrom", "pos"]).groupBy("genome", "gene").agg(F.count("*").alias("non_reference"))


def counts_by_gene(hits: DataFrame) -> DataFrame:
    """Hits per genome and gene; without a gene under ``Unknown``."""
    gene = F.coalesce(F.nullif("gene", F.lit("")), F.lit("Unknown"))
    return hits.groupBy("genome", gene.alias("gene")).agg(F.count("*").alias("variants"))


def rsid_coverage(annotations: DataFrame, enough: float = 0.9) -> DataFrame:
    """Rows, rows with an identifier, and whether a backfill can be skipped; counted over the whole table."""
    return annotations.agg(F.count("*").alias("total"), F.count("rsid").alias("has_rsid")).withColumn(
        "skip_backfill", (F.col("total") > 0) & (F.col("has_rsid") > F.col("total") * enough)
    )


def distinct_traits(weights: DataFrame) -> DataFrame:
    """Scores on offer."""
    return weights.select("prs_id", "trait").distinct().orderBy("trait", "prs_id")


def frequency_known(annotated: DataFrame) -> DataFrame:
    """Per genome: does any variant carry a frequency?"""
    return annotated.groupBy("genome").agg(F.bool_or(F.col("af").isNotNull()).alias("has_af"))


def suppressed_counts(marked: DataFrame) -> DataFrame:
    """Per genome: rows seen and rows the smart filter hides."""
    return marked.groupBy("genome").agg(F.count("*").alias("variants"), F.count_if("suppressed").alias("suppressed"))


def update_counts(base: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Base rows each layer would change; identifiers count only where one is missing."""
    parts = []
    for name, layer in layers.items():
        rows = base.filter(F.col("rsid").isNull()) if name == "dbsnp" else base
        hit = rows.select(*SITE_KEY).join(layer.select(*SITE_KEY), SITE_KEY, "left_semi")
        parts.append(hit.agg(F.lit(name).alias("layer"), F.count("*").alias("updated")))
    return reduce(DataFrame.unionByName, parts)


def ingest_quality(marked: DataFrame) -> DataFrame:
    """Rows loaded and rows skipped, from a ``loaded`` mark."""
    return marked.agg(F.count_if("loaded").alias("loaded"), F.count_if(~F.col("loaded")).alias("skipped"))


def genes_in_result(annotated: DataFrame) -> DataFrame:
    """Distinct genes per genome."""
    return annotated.filter(F.coalesce("gene", F.lit("")) != "").select("genome", "gene").distinct()


def layer_coverage(annotated: DataFrame) -> DataFrame:
    """Per genome and layer: calls, annotated calls and their share."""
    counts = layer_counts()
    wide = annotated.groupBy("genome").agg(F.count("*").alias("calls"), *_named(counts))
    long = wide.unpivot(["genome", "calls"], list(counts), "layer", "annotated")
    return long.withColumn("share", F.round(F.col("annotated") / F.col("calls"), 4))


def contig_styles(records: DataFrame) -> DataFrame:
    """Per genome: do its raw contig names carry ``chr``, and which mitochondrial name does it use?"""
    contig = F.col("contig")
    return records.groupBy("genome").agg(
        F.bool_or(contig.startswith("chr")).alias("uses_chr"),
        F.min(F.when(contig.isin("chrM", "chrMT", "M", "MT"), contig)).alias("mito_name"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every lookup table."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name, df in tables.items()])


def valid_id_counts(df: DataFrame, column: str = "rsid") -> DataFrame:
    """Well-formed and malformed identifiers."""
    good = F.coalesce(F.col(column).rlike(RSID_PATTERN), F.lit(False))
    return df.agg(F.count_if(good).alias("valid"), F.count_if(~good).alias("invalid"))
