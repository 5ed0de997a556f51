"""Joins of calls with annotations, genes, weights and associations."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelespan.functions.clinical import clinical_struct
from allelespan.functions.contigs import check_rsid
from allelespan.functions.genotypes import called_alleles, dosage, with_genotype, zygosity_label
from allelespan.functions.vcf_fields import frequency_struct
from allelespan.operators.filters import LISTED_VALUES, of_genomes, with_rsids, with_significance
from allelespan.operators.intervals import GENE_PADDING, INTERVAL_BIN, padded_genes, within_intervals
from allelespan.operators.sizing import interval_predicate, left_join_nullable, pin_if_small, salted_join, site_predicate, top_per_group
from allelespan.schemas import EFFECT_COLUMNS, SITE_KEY
from allelespan.session import local_table, written


def annotate(calls: DataFrame, annotations: DataFrame, salted: bool = False) -> DataFrame:
    """Calls with their annotation, left join on the site; an unannotated call keeps its own identifier.

    The annotation table has one row per site. A site called in very many genomes makes a hot key, which
    adaptive execution splits; ``salted`` spreads such keys explicitly, at the price of one more pass
    over the keys of ``calls``.
    """
    notes = annotations.withColumn("_hit", F.lit(True))
    joined = salted_join(calls, notes, SITE_KEY) if salted else calls.join(notes, SITE_KEY, "left")
    rsid = F.when(F.col("_hit"), F.col("rsid")).otherwise(F.col("id"))
    others = [name for name in annotations.columns if name not in SITE_KEY and name != "rsid"]
    kept = [name for name in calls.columns if name not in SITE_KEY and name != "id"]
    return joined.select(*SITE_KEY, rsid.alias("rsid"), *kept, *others)


def variant_records(annotated: DataFrame) -> DataFrame:
    """Flat annotated calls as nested variant records; an empty group of fields is a NULL struct."""
    effect = F.when(F.coalesce("gene", F.lit("")) != "", F.struct(*EFFECT_COLUMNS))
    rows = annotated if "genotype" in annotated.columns else with_genotype(annotated)
    return rows.select(
        *[name for name in ("genome",) if name in annotated.columns],
        "chrom",
        "pos",
        "rsid",
        "ref",
        "alt",
        "genotype",
        effect.alias("annotation"),
        clinical_struct(F.col("clnsig"), F.col("clndn"), F.col("clnrevstat")).alias("clinvar"),
        frequency_struct(F.col("af"), F.col("af_grpmax")).alias("population_freq"),
        *[name for name in ("truncated",) if name in annotated.columns],
    )


def flatten_records(records: DataFrame) -> DataFrame:
    """Variant records as plain columns."""
    nested = {
        "genotype": ["display", "zygosity"],
        "annotation": EFFECT_COLUMNS,
        "clinvar": ["significance", "condition", "review_status"],
        "population_freq": ["global", "popmax"],
    }
    columns: list[Column | str] = []
    for name in records.columns:
        columns += [F.col(f"{name}.{part}").alias(part) for part in nested[name]] if name in nested else [name]
    return records.select(*columns)


def calls_at_sites(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """Calls joined with annotated sites on the exact site.

    Few sites are pinned: their places prune the scan of ``calls`` and the join is a broadcast of known
    size. Many sites take an ordinary shuffled join.
    """
    pinned = pin_if_small(sites)
    if pinned is None:
        return annotate_inner(calls, sites)
    return annotate_inner(calls.filter(site_predicate(pinned.rows)), F.broadcast(pinned.table))


def annotate_inner(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """Calls that have a row in ``sites``, with that row's annotation."""
    return calls.drop("id").join(sites, SITE_KEY)


def sites_for_rsids(annotations: DataFrame, rsids: Sequence[str], index: DataFrame | None = None) -> DataFrame:
    """Annotated sites that carry one of the identifiers.

    ``index(rsid, chrom, pos, ref, alt)`` is sorted by identifier (``sinks.write_identifiers``), so it gives up the places from a few row groups;
    few places then prune the scan of the position-sorted annotations. Without it, every row group has to be tested.
    """
    if index is not None:
        pinned = pin_if_small(with_rsids(index, rsids).select(*SITE_KEY))
        if pinned is not None:
            annotations = annotations.filter(site_predicate(pinned.rows))
    return with_rsids(annotations, rsids)


def calls_for_rsids(calls: DataFrame, annotations: DataFrame, rsids: Sequence[str], index: DataFrame | None = None) -> DataFrame:
    """Annotated calls of the sites that carry one of the identifiers."""
    return calls_at_sites(calls, sites_for_rsids(annotations, rsids, index))


def requested_rsids(spark, rsids: Sequence[str]) -> DataFrame:
    """The request list as a table, in request order; a parameter, so its size is the caller's."""
    unique = list(dict.fromkeys(check_rsid(rsid) for rsid in rsids))
    return local_table(spark, list(enumerate(unique, 1)), "request_order long, rsid string")


def rsid_batch(
    calls: DataFrame, annotations: DataFrame, rsids: Sequence[str], genomes: Sequence[str] | None = None, index: DataFrame | None = None
) -> DataFrame:
    """Every requested identifier with its annotated calls; identifiers without a call give one row of NULLs.

    With ``genomes``, every one of them gets a row for each identifier, found or not. The calls of an identifier are
    on the side of the join that can be split, so one identifier over all genomes is no single task.
    """
    request = requested_rsids(calls.sparkSession, rsids)
    hits = calls_for_rsids(calls, annotations, rsids, index).join(request, "rsid")
    keys = ["rsid"]
    if genomes is not None:
        keys = ["rsid", "genome"]
        request = request.withColumn("genome", F.explode(F.array(*[F.lit(genome) for genome in genomes])))
    misses = request.join(hits.select(*keys).distinct(), keys, "left_anti")
    return hits.withColumn("found", F.lit(True)).unionByName(misses.withColumn("found", F.lit(False)), allowMissingColumns=True)


def missing_rsids(calls: DataFrame, annotations: DataFrame, rsids: Sequence[str]) -> DataFrame:
    """Requested identifiers without any call."""
    request = requested_rsids(calls.sparkSession, rsids)
    return request.join(calls_for_rsids(calls, annotations, rsids).select("rsid").distinct(), "rsid", "left_anti")


def missing_symbols(genes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that the gene table does not know, whatever the case."""
    known = genes.select(F.upper("symbol").alias("_symbol")).distinct()
    return symbols.withColumn("_symbol", F.upper("symbol")).join(known, "_symbol", "left_anti").drop("_symbol")


def calls_with_significance(calls: DataFrame, annotations: DataFrame, term: str) -> DataFrame:
    """Annotated calls whose clinical significance contains the term; the filter runs before the join."""
    return annotate_inner(calls, with_significance(annotations, term))


def named_genes(genes: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Gene rows with one of the symbols, whatever the case; a long list is joined instead of listed in the filter."""
    wanted = list(dict.fromkeys(symbol.upper() for symbol in symbols))
    if len(wanted) <= LISTED_VALUES:
        return genes.filter(F.upper("symbol").isin(*wanted))
    listed = local_table(genes.sparkSession, [(symbol,) for symbol in wanted], "_symbol string")
    return genes.join(listed, F.upper("symbol") == F.col("_symbol"), "left_semi")


class GeneRegion(NamedTuple):
    """Intervals, a filter on (chrom, pos) that lets everything inside them through, and whether it keeps everything else out."""

    near: Column
    table: DataFrame
    exact: bool


def gene_region(genes: DataFrame, symbols: Sequence[str], padding: int = GENE_PADDING) -> GeneRegion:
    """Padded intervals of the named genes.

    Few intervals are pinned: their filter prunes scans and their table is a broadcast of known size. Many take the
    ordinary interval join, with a filter that lets everything through.
    """
    return region_of(padded_genes(named_genes(genes, symbols), padding))


def region_of(intervals: DataFrame) -> GeneRegion:
    """The region that padded intervals make up."""
    pinned = pin_if_small(intervals)
    if pinned is None:
        return GeneRegion(F.lit(True), intervals, False)
    exact = len(pinned.rows) <= LISTED_VALUES
    return GeneRegion(interval_predicate(pinned.rows) if exact else F.lit(True), F.broadcast(pinned.table), exact)


def inside_genes(df: DataFrame, region: GeneRegion) -> DataFrame:
    """Rows at positions inside any of the region's intervals, each once."""
    rows = df.filter(region.near)
    if region.exact:
        return rows
    places = within_intervals(rows.select("chrom", "pos").distinct(), region.table).select("chrom", "pos").distinct()
    return rows.join(places, ["chrom", "pos"], "left_semi")


def pgx_genotypes(drugs: DataFrame, pgx_variants: DataFrame, calls: DataFrame, genomes: Sequence[str]) -> DataFrame:
    """Drug, gene and star-allele positions with the genotypes of the named genomes."""
    keyed = pgx_variants.withColumn("_gene", F.upper("gene")).drop("gene")
    positions = drugs.withColumn("_gene", F.upper("gene")).join(keyed, "_gene").drop("_gene")
    return star_allele_genotypes(positions, of_genomes(calls, *genomes), genomes)


def star_allele_genotypes(positions: DataFrame, calls: DataFrame, genomes: Sequence[str]) -> DataFrame:
    """Star-allele positions with the genotype each named genome has there.

    A position without a call keeps its row. Calls are cut to the listed positions before one is chosen
    per position; few positions also prune the scan.
    """
    at_places = first_calls_at(calls, positions.filter("chrom IS NOT NULL AND pos IS NOT NULL"))
    called = with_genotype(at_places).select("genome", "chrom", "pos", "genotype")
    report = positions.withColumn("genome", F.explode(F.array(*[F.lit(genome) for genome in genomes])))
    joined = report.join(called, ["genome", "chrom", "pos"], "left")
    return joined.withColumn("status", genotype_status())


def genotype_status() -> Column:
    """Display text with zygosity, or why there is none."""
    shown = F.concat(F.col("genotype.display"), F.lit(" ("), zygosity_label(F.col("genotype.zygosity")), F.lit(")"))
    no_place = F.col("chrom").isNull() | F.col("pos").isNull()
    return F.when(no_place, "not found").otherwise(F.coalesce(shown, F.lit("ref or not covered")))


def first_calls(calls: DataFrame) -> DataFrame:
    """One call per genome and position, the first by alleles."""
    return top_per_group(calls, ["genome", "chrom", "pos"], ["ref", "alt", F.col("gt").asc_nulls_last()], 1)


def first_calls_at(calls: DataFrame, places: DataFrame) -> DataFrame:
    """One call per genome at the positions of ``places(chrom, pos)``.

    Few places are pinned: they prune the scan of ``calls`` and are broadcast at a known size. The rows are spread by genome and position before
    the choice. Without that, the choice would ride on the join's own spread by position, and a position called in every genome would stay in one task.
    """
    wanted = places.select("chrom", "pos").distinct()
    pinned = pin_if_small(wanted)
    if pinned is not None:
        calls, wanted = calls.filter(site_predicate(pinned.rows)), F.broadcast(pinned.table)
    return first_calls(calls.join(wanted, ["chrom", "pos"], "left_semi").repartition("genome", "chrom", "pos"))


def score_contributions(weights: DataFrame, calls: DataFrame) -> DataFrame:
    """Weights joined with the calls at their positions: allele dosage and contribution per genome.

    All genomes and all scores in one join. Weights a genome has no call for give no row; totals come
    from the weight table itself.
    """
    # only positions that some score uses take part in the per-position choice of a call
    called = first_calls_at(calls, weights).select("genome", "chrom", "pos", "ref", "alt", "gt")
    joined = weights.join(called, ["chrom", "pos"]).withColumn("alleles", called_alleles(F.col("gt"), F.col("ref"), F.col("alt")))
    count = dosage(F.col("alleles"), F.col("effect_allele"))
    return joined.withColumn("dosage", count).withColumn("contribution", F.col("dosage") * F.col("weight"))


def association_genotypes(associations: DataFrame, calls: DataFrame, annotations: DataFrame) -> DataFrame:
    """Associations with the genotype of the first call that carries their identifier.

    Identifiers lead to sites, sites to calls; only identifiers that occur in the associations are
    followed. ``associations`` may repeat an identifier any number of times. Those with a call are found by an inner join, whose
    sides can both be split, so one identifier over all genomes is no single task; the others get a row of NULLs.
    """
    wanted = associations.filter(F.col("rsid").rlike(r"^rs\d+$")).select("rsid").distinct()
    sites = annotations.select(*SITE_KEY, "rsid").join(wanted, "rsid", "left_semi")
    hits = annotate_inner(calls, sites)
    order = ["chrom", "pos", "ref", "alt", F.col("gt").asc_nulls_last()]
    by = ["genome", "rsid"]
    first = top_per_group(hits, by, order, 1)
    called = written(with_genotype(first).select("genome", "rsid", "genotype"))
    named, nameless = associations.filter("rsid IS NOT NULL"), associations.filter("rsid IS NULL")
    uncalled = named.join(called.select("rsid").distinct(), "rsid", "left_anti")
    rows = [rows.select(associations.columns) for rows in (uncalled, nameless)]
    met = named.join(called, "rsid").select(*associations.columns, "genome", "genotype")
    return met.unionByName(rows[0].unionByName(rows[1]), allowMissingColumns=True)


def pair_genomes(calls: DataFrame, first: str, second: str) -> DataFrame:
    """Two genomes side by side: one row per site that either of them has.

    One grouped pass instead of a self-join; the scan is filtered to the two genomes. Of a genome's repeated
    records of a site the first by genotype and identifier counts, with its own display and zygosity.
    """
    chosen = calls.filter(F.col("genome").isin(first, second))
    order = [F.col("gt").asc_nulls_last(), F.col("id").asc_nulls_last()]
    rows = with_genotype(top_per_group(chosen, ["genome", *SITE_KEY], order, 1))

    def of(genome: str) -> Column:
        return F.max(F.when(F.col("genome") == genome, F.struct(F.col("genotype.display").alias("display"), F.col("genotype.zygosity").alias("zygosity"))))

    pairs = rows.groupBy(*SITE_KEY).agg(F.max("id").alias("id"), of(first).alias("_1"), of(second).alias("_2"))
    shown = [F.col(f"_{k}.{part}").alias(f"{part}_{k}") for k in (1, 2) for part in ("display", "zygosity")]
    return pairs.select(*SITE_KEY, "id", *shown)


def in_warning_genes(symbols: DataFrame, warning_genes: DataFrame) -> DataFrame:
    """Rows of ``symbols(symbol, ...)`` on the warning list, whatever the case."""
    listed = warning_genes.select(F.upper("symbol").alias("_symbol")).distinct()
    return symbols.withColumn("_symbol", F.upper("symbol")).join(listed, "_symbol", "left_semi").drop("_symbol")


def mark_warning(df: DataFrame, gene_column: str, warning_genes: DataFrame) -> DataFrame:
    """Adds ``sensitive``: the row's gene is on the warning list."""
    listed = warning_genes.select(F.upper("symbol").alias("symbol")).distinct().withColumn("_listed", F.lit(True))
    marked = left_join_nullable(df, listed, {"symbol": F.upper(gene_column)})
    return marked.withColumn("sensitive", F.coalesce("_listed", F.lit(False))).drop("_listed")


def mark_any_warning(df: DataFrame, symbols: Column, warning_genes: DataFrame) -> DataFrame:
    """Adds ``sensitive``: one of the row's gene ``symbols`` (an array) is on the warning list. Rows must differ from each other."""
    listed = warning_genes.select(F.upper("symbol").alias("_symbol")).distinct().withColumn("_listed", F.lit(True))
    spread = df.withColumn("_symbol", F.explode_outer(F.transform(symbols, lambda symbol: F.upper(symbol))))
    marked = left_join_nullable(spread, listed, {"_symbol": F.col("_symbol")})
    return marked.groupBy(*df.columns).agg(F.coalesce(F.bool_or("_listed"), F.lit(False)).alias("sensitive"))


def gene_coordinates(symbols: DataFrame, records: DataFrame) -> DataFrame:
    """Symbol list joined with coordinate records; symbols without a record keep NULL coordinates."""
    return symbols.join(records, "symbol", "left")

