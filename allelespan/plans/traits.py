"""Drug-gene, association and polygenic-score queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.functions.associations import gene_symbols
from allelespan.functions.genotypes import with_genotype, zygosity_label
from allelespan.operators import aggregates, filters, joins, ranking
from allelespan.operators.intervals import padded_genes, within_intervals
from allelespan.plans.cohort import Cohort


def _drug_rows(cohort: Cohort, drug: str | None, gene: str | None) -> DataFrame:
    if not drug and not gene:
        raise ValueError("give a drug or a gene")
    column, value = ("drug_name", drug) if drug else ("gene", gene)
    return filters.equals_ignoring_case(cohort.pgx_drugs, column, value)


def query_pgx(
    cohort: Cohort,
    drug: str | None = None,
    gene: str | None = None,
    genome: str | None = None,
    genome2: str | None = None,
    include_all_variants: bool = False,
    max_results: int = 20,
) -> DataFrame:
    """Star-allele positions of a drug's (or gene's) entries with the genotypes of one genome, a pair, or every listed genome.

    ``sensitive`` marks genes on the cohort's warning list, if it has one. With ``include_all_variants`` there are rows of two kinds, told
    apart by ``part``: ``star_alleles``, and ``region`` for the first ``max_results`` non-reference calls of each genome in each of the
    entries' genes; ``truncated`` tells whether there were more. Region rows name no drug and come once per gene and genome.
    """
    genomes = cohort.named(genome, genome2)
    if filters.ALL_GENOMES in genomes:
        if not cohort.genomes:
            raise ValueError("a report over all genomes needs the cohort's list of genomes")
        genomes = list(cohort.genomes)
    entries = _drug_rows(cohort, drug, gene)
    rows = joins.pgx_genotypes(entries, cohort.pgx_variants, cohort.calls, genomes)
    rows = rows.select("genome", "drug_name", "gene", "cpic_level", "rsid", "star_allele", "chrom", "pos", "function_impact", "status")
    if include_all_variants:
        calls = filters.of_genomes(cohort.calls, *genomes)
        rows = rows.withColumn("part", F.lit("star_alleles")).unionByName(_region_rows(cohort, entries, calls, max_results), allowMissingColumns=True)
    return rows if cohort.warning_genes is None else joins.mark_warning(rows, "gene", cohort.warning_genes)


def _region_rows(cohort: Cohort, entries: DataFrame, calls: DataFrame, n: int) -> DataFrame:
    """First ``n`` non-reference calls of each genome in the region of each gene that ``entries`` name."""
    named = entries.select(F.upper("gene").alias("_gene")).distinct()
    region = joins.region_of(padded_genes(cohort.genes.join(named, F.upper("symbol") == F.col("_gene"), "left_semi")))
    inside = within_intervals(filters.non_reference(with_genotype(calls.filter(region.near))), region.table)
    # cut before the annotation is looked up
    rows = joins.annotate(ranking.capped(inside, n, ["genome", "symbol"]), cohort.annotations.filter(region.near))
    shown = [F.col("symbol").alias("gene"), F.col("genotype.display").alias("status")]
    return rows.select(F.lit("region").alias("part"), "genome", "rsid", "chrom", "pos", "ref", "alt", "effect", "truncated", *shown)


def query_pgx_region(cohort: Cohort, gene: str, genome: str | None = None, max_results: int = 20) -> DataFrame:
    """First non-reference calls in a drug gene's region."""
    region = joins.gene_region(cohort.genes, [gene])
    calls = filters.non_reference(with_genotype(joins.inside_genes(cohort.calls_of(genome), region)))
    rows = joins.annotate(calls, cohort.annotations.filter(region.near))
    capped = ranking.capped(rows, max_results, ["genome"])
    return capped.select("genome", "rsid", "chrom", "pos", "ref", "alt", F.col("genotype.display").alias("display"), "effect", "truncated")


def query_gwas(
    cohort: Cohort,
    trait: str | None = None,
    gene: str | None = None,
    rsid: str | None = None,
    max_results: int = 30,
    deduplicate: bool = True,
    check_calls: bool = False,
    genome: str | None = None,
    tie: tuple[str, ...] = ("rsid", "trait", "study_accession"),
) -> DataFrame:
    """Most significant associations by ``rank``, optionally with a genome's genotype; ``truncated`` tells whether there were more.

    Where the cohort has a list of warning genes, ``sensitive`` marks associations with one among their mapped genes;
    ``sensitive_associations`` gives these genes.
    """
    found = filters.associations_matching(cohort.gwas, trait, gene, rsid)
    rows = ranking.top_associations(found, list(tie), max_results, deduplicate)
    if cohort.warning_genes is not None:
        rows = joins.mark_any_warning(rows, gene_symbols(F.col("mapped_gene")), cohort.warning_genes).orderBy("rank")
    if check_calls:
        # only the identifiers of the rows that are left are looked up
        calls = cohort.calls_of(cohort.check(genome))
        shown = joins.association_genotypes(rows, calls, cohort.annotations)
        label = F.concat(F.col("genotype.display"), F.lit(" ("), zygosity_label(F.col("genotype.zygosity")), F.lit(")"))
        rows = shown.withColumn("genotype", label)
    return rows


def sensitive_associations(associations: DataFrame, warning_genes: DataFrame) -> DataFrame:
    """Warning genes among the mapped genes of the associations."""
    symbols = associations.select(F.explode(gene_symbols(F.col("mapped_gene"))).alias("symbol")).distinct()
    return joins.in_warning_genes(symbols, warning_genes)


def _weights(cohort: Cohort, trait: str | None, prs_id: str | None) -> DataFrame:
    if not trait and not prs_id:
        raise ValueError("give a trait or a score")
    rows = cohort.prs_weights
    if trait:
        rows = rows.filter(filters.contains_ignoring_case("trait", trait))
    return rows.filter(F.col("prs_id") == prs_id) if prs_id else rows


def calculate_prs(
    cohort: Cohort, trait: str | None = None, prs_id: str | None = None, genome: str | None = None, genome2: str | None = None
) -> DataFrame:
    """Scores of one genome, a pair or the cohort; scores sharing a trait stay apart.

    Each named genome, and over the cohort each listed one (``Cohort.genomes``), has a row for every score.
    """
    weights = _weights(cohort, trait, prs_id)
    contributions = joins.score_contributions(weights, cohort.calls_of(genome, genome2))
    names = cohort.named(genome, genome2)
    return aggregates.polygenic_scores(contributions, weights, cohort.genomes or None if filters.ALL_GENOMES in names else names)


def prs_details(cohort: Cohort, trait: str | None = None, prs_id: str | None = None, genome: str | None = None, n: int = 15) -> DataFrame:
    """Largest contributions behind the scores."""
    rows = joins.score_contributions(_weights(cohort, trait, prs_id), cohort.calls_of(genome))
    return ranking.top_contributions(rows, n)
