"""The tables a query works on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from allelespan.operators.filters import ALL_GENOMES, of_genomes, pick_genome


@dataclass(frozen=True)
class Cohort:
    """Calls of any number of genomes, their shared annotation table and the lookup tables.

    ``genomes`` are the labels a query may name. They are a parameter of the caller, never read off the
    calls; without them any label is accepted but one has to be given. ``rsid_index`` is the identifier index of the annotations, if there is one.
    """

    calls: DataFrame
    annotations: DataFrame
    genes: DataFrame | None = None
    pgx_drugs: DataFrame | None = None
    pgx_variants: DataFrame | None = None
    prs_weights: DataFrame | None = None
    gwas: DataFrame | None = None
    warning_genes: DataFrame | None = None
    genomes: tuple[str, ...] = field(default=())
    rsid_index: DataFrame | None = None

    def check(self, genome: str | None) -> str:
        """The genome to use; raises ValueError for an unknown or missing choice."""
        if not self.genomes:
            if genome is None:
                raise ValueError("name a genome, or list the cohort's genomes")
            return genome
        return pick_genome(self.genomes, genome)

    def named(self, genome: str | None, genome2: str | None = None) -> list[str]:
        """The checked labels of one genome or a pair."""
        return [self.check(genome)] + ([self.check(genome2)] if genome2 else [])

    def calls_of(self, genome: str | None, genome2: str | None = None) -> DataFrame:
        """Calls of one genome, of a pair, or of all (``ALL_GENOMES``)."""
        return of_genomes(self.calls, *self.named(genome, genome2)).drop("genome_bucket")


__all__ = ["ALL_GENOMES", "Cohort"]
