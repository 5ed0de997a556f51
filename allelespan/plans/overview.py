"""Cohort overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.operators import aggregates, joins
from allelespan.plans.cohort import ALL_GENOMES, Cohort
from allelespan.schemas import SITE_KEY

# The drug genes of the quick check.
QUICK_CHECK_GENES = ("CYP2D6", "CYP2C19", "CYP2C9", "SLCO1B1", "DPYD", "VKORC1", "TPMT")

_NOTES = ["rsid", "gene", "clnsig", "af", "af_grpmax"]


def _noted_calls(cohort: Cohort, calls: DataFrame) -> DataFrame:
    """Calls with the few annotation columns an overview counts."""
    calls = calls.select("genome", *SITE_KEY, "id")
    return joins.annotate(calls, cohort.annotations.select(*SITE_KEY, *_NOTES))


def genome_summary(
    cohort: Cohort, genome: str | None = ALL_GENOMES, genome2: str | None = None, genes: tuple[str, ...] = QUICK_CHECK_GENES
) -> DataFrame:
    """Per genome: variant counts, annotated calls per layer, pathogenic findings and drug-gene findings.

    All counts over the calls come from one pass: first per genome and gene, then per genome, which also
    counts the genes without collecting them.
    """
    pathogenic = F.coalesce(F.lower("clnsig").contains("athogenic"), F.lit(False))
    counts = {**aggregates.record_counts(), **aggregates.layer_counts(), "pathogenic": F.count_if(pathogenic)}
    calls = cohort.calls_of(genome, genome2)
    per_gene = _noted_calls(cohort, calls).groupBy("genome", "gene").agg(*[count.alias(name) for name, count in counts.items()])
    affected = (F.coalesce("gene", F.lit("")) != "") & (F.col("pathogenic") > 0)
    summary = per_gene.groupBy("genome").agg(*[F.sum(name).alias(name) for name in counts], F.count_if(affected).alias("pathogenic_genes"))
    drugs = aggregates.non_reference_star_alleles(cohort.pgx_variants, calls, list(genes))
    per_genome = drugs.groupBy("genome").agg(F.sum("non_reference").alias("pgx_non_reference"), F.count("*").alias("pgx_genes"))
    return summary.join(per_genome, "genome", "left").fillna(0, ["pgx_non_reference", "pgx_genes"])


def list_genomes(cohort: Cohort) -> DataFrame:
    """Genomes present, with their calls and the annotated calls per layer."""
    counts = {"calls": F.count("*"), **aggregates.layer_counts()}
    return _noted_calls(cohort, cohort.calls_of(ALL_GENOMES)).groupBy("genome").agg(*[count.alias(name) for name, count in counts.items()])
