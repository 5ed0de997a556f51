"""Per-group choices, sorts, top rows and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelespan.functions.contigs import chrom_rank
from allelespan.operators.sizing import top_per_group
from allelespan.session import local_table, shared_folder


def significance_order(tie: list[str]) -> list[Column]:
    """Smallest p-value first, unknown last, then the tie-break columns."""
    return [F.col("p_value").asc_nulls_last(), *[F.col(name).asc_nulls_last() for name in tie]]


def best_per_rsid(associations: DataFrame, tie: list[str]) -> DataFrame:
    """Most significant association of each identifier; associations without one are all kept."""
    named = associations.filter(F.col("rsid").isNotNull() & (F.col("rsid") != ""))
    nameless = associations.filter(F.col("rsid").isNull() | (F.col("rsid") == ""))
    return top_per_group(named, ["rsid"], significance_order(tie), 1).unionByName(nameless)


def top_associations(associations: DataFrame, tie: list[str], n: int = 30, deduplicate: bool = True) -> DataFrame:
    """The ``n`` most significant associations (at least one), after keeping the best per identifier; ``rank`` from 1.

    Ties beyond the ``tie`` columns are broken by all other columns, so the rows are always the same ones. ``truncated`` tells
    whether there were more.
    """
    n = max(1, n)
    rows = best_per_rsid(associations, tie) if deduplicate else associations
    order = [*significance_order(tie), *[F.col(name).asc_nulls_last() for name in associations.columns if name not in ("p_value", *tie)]]
    # only the rows that the limit leaves, one more than asked for, meet in one task
    first, together = rows.orderBy(*order).limit(n + 1), Window.partitionBy(F.lit(0))
    placed = first.withColumn("rank", F.row_number().over(together.orderBy(*order)))
    return placed.withColumn("truncated", F.count("*").over(together) > n).filter(F.col("rank") <= n)


def top_per_gene(df: DataFrame, n: int = 20, by: list[str] = ("genome", "symbol")) -> DataFrame:
    """First ``n`` variants of each gene in genome order."""
    return top_per_group(df, list(by), record_order(df), n)


def genome_order() -> list[Column]:
    """Chromosome, position, alleles."""
    return [chrom_rank(F.col("chrom")), F.col("pos"), F.col("ref"), F.col("alt")]


def record_order(df: DataFrame) -> list[Column]:
    """Genome order, with genotype and identifier to tell repeated records apart."""
    return [*genome_order(), *[F.col(name).asc_nulls_last() for name in ("gt", "rsid", "id") if name in df.columns]]


def sort_by_genome(df: DataFrame, position: str = "start_pos", tie: list[str] = ()) -> DataFrame:
    """Global genome order: chromosomes 1..22, X, Y, MT, then position."""
    return df.orderBy(chrom_rank(F.col("chrom")), position, *tie)


def numbered(df: DataFrame, order: list[Column | str], into: str = "place") -> DataFrame:
    """All rows with their place (from 1) in a stated order, for tables of any size.

    The rows are range-partitioned, sorted and written once, each with its part and its place there; the parts' row counts, one number each, give the
    offsets. No window gathers the table in one task. ``order`` must leave no ties, or tied rows come in any order.
    """
    path = shared_folder(df.sparkSession)
    placed = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    placed.write.parquet(path)
    stored = df.sparkSession.read.schema(placed.schema).parquet(path)
    counts = sorted(tuple(row) for row in stored.groupBy("_part").agg(F.min("_row"), F.count("*")).collect())  # one row per part
    offsets, before = [], 0
    for part, first, rows in counts:
        offsets.append((part, before - first + 1))
        before += rows
    table = F.broadcast(local_table(df.sparkSession, offsets, "_part int, _offset long"))
    return stored.join(table, "_part").withColumn(into, F.col("_row") + F.col("_offset")).select(*df.columns, into)


def star_allele_order() -> list[Column]:
    """Gene, identifier, star allele, then the place."""
    return [F.col(name).asc_nulls_first() for name in ("gene", "rsid", "star_allele", "chrom", "pos", "ref", "alt")]


def top_weights(weights: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest weights of each score by absolute value."""
    return top_per_group(weights, ["prs_id"], [F.abs("weight").desc(), "chrom", "pos", "rsid", "effect_allele"], n)


def top_contributions(contributions: DataFrame, n: int = 15) -> DataFrame:
    """Per genome and score, the largest non-zero contributions among the first ``n`` by absolute value."""
    order = [F.abs("contribution").desc(), "chrom", "pos", "rsid", "effect_allele"]
    # zero contributions sort last, so hiding them first leaves the same rows
    return top_per_group(contributions.filter(F.col("contribution") != 0), ["genome", "prs_id"], order, n, rank="rank")


def one_star_allele(rows: DataFrame) -> DataFrame:
    """First row per gene, identifier and star allele in position order."""
    order = ["pos", "ref", "alt", F.col("function_impact").asc_nulls_last()]
    return top_per_group(rows, ["gene", "rsid", "star_allele"], order, 1)


def capped(df: DataFrame, n: int, by: list[str] = ("genome",)) -> DataFrame:
    """First ``n`` rows of each group in genome order, and whether the group had more.

    Each task keeps ``n + 1`` rows per group, enough to tell.
    """
    kept = top_per_group(df, list(by), record_order(df), n + 1, rank="_place")
    more = F.max("_place").over(Window.partitionBy(*by)) > n
    return kept.withColumn("truncated", more).filter(F.col("_place") <= n).drop("_place")


def first_rows(df: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)
