"""Lookups by variant, region, gene and clinical significance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.functions.clinical import spaced
from allelespan.functions.genotypes import with_genotype
from allelespan.operators import filters, joins, ranking
from allelespan.plans.cohort import Cohort
from allelespan.session import local_table


def _annotated(cohort: Cohort, calls: DataFrame) -> DataFrame:
    return joins.annotate(calls, cohort.annotations)


def query_variant(
    cohort: Cohort, rsid: str | None = None, position: str | None = None, genome: str | None = None, genome2: str | None = None
) -> DataFrame:
    """Variant records of an identifier or a position, for one genome or a pair, marked if their gene is sensitive."""
    if not rsid and not position:
        raise ValueError("give an identifier or a position")
    calls = cohort.calls_of(genome, genome2)
    if rsid:
        rows = joins.calls_for_rsids(calls, cohort.annotations, [rsid], cohort.rsid_index)
    else:
        rows = joins.annotate(filters.at_position(calls, position), filters.at_position(cohort.annotations, position))
    flat = joins.flatten_records(joins.variant_records(rows))
    return joins.mark_warning(flat, "gene", cohort.warning_genes) if cohort.warning_genes is not None else flat


def query_variants(cohort: Cohort, rsids: Sequence[str], genome: str | None = None, genome2: str | None = None) -> DataFrame:
    """Every requested identifier, found or not, for one genome or for each of a pair; any number of them."""
    asked = _asked(rsids)
    names = cohort.named(genome, genome2)
    batch = joins.rsid_batch(cohort.calls_of(genome, genome2), cohort.annotations, asked, None if filters.ALL_GENOMES in names else names, cohort.rsid_index)
    shown = with_genotype(batch).select(
        "request_order",
        "rsid",
        "found",
        "genome",
        "chrom",
        "pos",
        "ref",
        "alt",
        F.when(F.col("found"), F.col("genotype.display")).alias("display"),
        "gene",
        "effect",
        "impact",
        spaced(F.when(F.col("clnsig") != ".", F.col("clnsig"))).alias("significance"),
        "af",
    )
    return _marked(cohort, shown, "gene")


def _asked(values: Sequence[str]) -> list[str]:
    """The non-blank values of a request list; there must be one."""
    kept = [text for text in map(str.strip, values) if text]
    if not kept:
        raise ValueError("the request list is empty")
    return kept


def _gene_rows(cohort: Cohort, calls: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Annotated calls inside the padded genes; the intervals prune the scans of calls and annotations alike."""
    region = joins.gene_region(cohort.genes, symbols)
    rows = joins.annotate(calls.filter(region.near), cohort.annotations.filter(region.near))
    return joins.within_intervals(rows, region.table.select("symbol", F.col("name").alias("gene_name"), "chrom", "start_pos", "end_pos"))


def _marked(cohort: Cohort, rows: DataFrame, gene_column: str) -> DataFrame:
    """Adds ``sensitive`` where the cohort has a list of warning genes."""
    return rows if cohort.warning_genes is None else joins.mark_warning(rows, gene_column, cohort.warning_genes)


def _gene_columns(cohort: Cohort, rows: DataFrame) -> DataFrame:
    shown = with_genotype(rows).select(
        "genome",
        "symbol",
        "chrom",
        "pos",
        "ref",
        "alt",
        "rsid",
        F.col("genotype.display").alias("display"),
        F.nullif("effect", F.lit("")).alias("effect"),
        "impact",
        spaced(F.when(F.col("clnsig") != ".", F.col("clnsig"))).alias("significance"),
        "af",
        *[name for name in ("truncated",) if name in rows.columns],
    )
    return _marked(cohort, shown, "symbol")


def query_gene(
    cohort: Cohort,
    gene: str,
    impact_filter: str = "HIGH,MODERATE",
    max_results: int = 50,
    smart_filter: bool = True,
    genome: str | None = None,
    genome2: str | None = None,
) -> DataFrame:
    """Variants of a gene after the impact, information and smart filters; the first ``max_results`` per genome.

    The limit comes last, so it never hides a variant that would have passed the filters; ``truncated`` tells
    whether a genome had more.
    """
    filters.impact_levels(impact_filter)
    rows = _gene_rows(cohort, cohort.calls_of(genome, genome2), [gene])
    rows = filters.informative(filters.with_impact(rows, impact_filter))
    if smart_filter:
        rows = filters.smart(rows, cohort.pgx_variants, gene)
    return _gene_columns(cohort, ranking.capped(rows, max_results, ["genome"]))


def query_genes(
    cohort: Cohort,
    genes: Sequence[str],
    impact_filter: str = "HIGH,MODERATE",
    max_results_per_gene: int = 20,
    genome: str | None = None,
    report_unknown: bool = False,
) -> DataFrame:
    """Variants of any number of genes, without the smart filter; the first ``max_results_per_gene`` per genome and gene.

    ``truncated`` tells whether a gene had more in that genome. With ``report_unknown`` a symbol that the gene table doesn't know gives a
    row of its own, in upper case and with ``known`` false; all other rows have it true.
    """
    symbols = _asked(genes)
    filters.impact_levels(impact_filter)
    rows = _gene_rows(cohort, cohort.calls_of(genome), symbols)
    rows = filters.informative(filters.with_impact(rows, impact_filter))
    shown = _gene_columns(cohort, ranking.capped(rows, max_results_per_gene, ["genome", "symbol"]))
    if not report_unknown:
        return shown
    listed = local_table(cohort.genes.sparkSession, [(s,) for s in dict.fromkeys(symbol.upper() for symbol in symbols)], "symbol string")
    unknown = _marked(cohort, joins.missing_symbols(cohort.genes, listed), "symbol")
    return shown.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)), allowMissingColumns=True)


def gene_overview(cohort: Cohort, gene: str, impact_filter: str = "HIGH,MODERATE", genome: str | None = None, genome2: str | None = None) -> DataFrame:
    """What ``query_gene`` leaves unsaid, per genome: variants before the smart filter, those it hides, and whether any has a frequency."""
    filters.impact_levels(impact_filter)
    rows = _gene_rows(cohort, cohort.calls_of(genome, genome2), [gene])
    marked = filters.mark_suppressed(filters.informative(filters.with_impact(rows, impact_filter)), cohort.pgx_variants, gene)
    return marked.groupBy("genome").agg(
        F.count("*").alias("variants"), F.count_if("suppressed").alias("suppressed"), F.bool_or(F.col("af").isNotNull()).alias("has_af")
    )


def query_clinvar(
    cohort: Cohort,
    significance: str = "Pathogenic",
    gene: str | None = None,
    condition: str | None = None,
    max_results: int = 50,
    genome: str | None = None,
    genome2: str | None = None,
) -> DataFrame:
    """Calls with a clinical significance, optionally in one gene's region or for a condition.

    The first ``max_results`` per genome; ``truncated`` tells whether a genome had more.
    """
    calls, notes = cohort.calls_of(genome, genome2), filters.with_significance(cohort.annotations, significance)
    if gene:
        region = joins.gene_region(cohort.genes, [gene])
        calls, notes = calls.filter(region.near), joins.inside_genes(notes, region)
    if condition:
        notes = filters.with_condition(notes, condition)
    rows = ranking.capped(joins.annotate_inner(calls, notes), max_results, ["genome"])
    flat = joins.flatten_records(joins.variant_records(rows))
    shown = flat.withColumn("gene", F.coalesce("gene", F.lit("Unknown"))).select(
        "genome", "gene", "rsid", "chrom", "pos", "ref", "alt", "display", "significance", "condition", "truncated"
    )
    return _marked(cohort, shown, "gene")
