"""Predicates and filters over variant, annotation and association tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelespan.functions.clinical import is_suppressed, matches_significance, spaced
from allelespan.functions.contigs import RSID_PATTERN, bare_chrom, check_rsid, parse_region
from allelespan.operators.intervals import inside_any, within_intervals
from allelespan.operators.sizing import left_join_nullable, pin_if_small, range_predicate
from allelespan.schemas import GENOME_BUCKETS
from allelespan.session import local_table

IMPACT_LEVELS = ("HIGH", "MODERATE", "LOW", "MODIFIER")  # fixed values
TEXT_FIELDS = ("impact", "effect", "gene", "transcript", "hgvs_c", "hgvs_p")
ALL_GENOMES = "*"
MAX_REGION_TESTS = 200

# Longer lists of values are joined instead of written into a filter.
LISTED_VALUES = 200


def in_region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows whose position lies in the interval, both ends included."""
    return df.filter((F.col("chrom") == bare_chrom(chrom)) & F.col("pos").between(start, end))


def overlapping_region(df: DataFrame, chrom: str, start: int, end: int, spans: DataFrame | None = None) -> DataFrame:
    """Rows whose reference allele touches the interval, as an indexed file fetch returns them.

    ``spans`` is the table's summary (``intervals.longest_spans``). With it only the stretches from which a record can reach the interval are
    scanned; without it everything of the chromosome up to the interval's end. The rows are the same.
    """
    last = F.col("pos") + F.length("ref") - 1
    rows = df.filter((F.col("chrom") == bare_chrom(chrom)) & (F.col("pos") <= end) & (last >= start))
    if spans is None:
        return rows
    reaching = (F.col("first_pos") <= end) & (F.col("last_pos") + F.col("longest") > start)
    pinned = pin_if_small(spans.filter((F.col("chrom") == bare_chrom(chrom)) & reaching))
    if pinned is None:
        return rows
    stretches = [(max(bin.first_pos, start - bin.longest + 1), min(bin.last_pos, end)) for bin in pinned.rows]
    return rows.filter(range_predicate([(low, high) for low, high in stretches if low <= high]))


def in_regions(df: DataFrame, regions: Sequence[str], labelled: bool = False) -> DataFrame:
    """Rows in any of the listed intervals; with ``labelled`` one row per (region, row).

    A short list becomes a filter that reaches the scan; a long one becomes a join on position bins.
    """
    parsed = [(region, *parse_region(region)) for region in dict.fromkeys(regions)]
    intervals = local_table(df.sparkSession, parsed, "region string, chrom string, start_pos long, end_pos long")
    short = len(parsed) <= MAX_REGION_TESTS
    if short:
        tests = [(F.col("chrom") == chrom) & F.col("pos").between(start, end) for _, chrom, start, end in parsed]
        df = df.filter(reduce(lambda left, right: left | right, tests, F.lit(False)))
    if labelled:
        return within_intervals(df, intervals).select("region", *df.columns)
    return df if short else inside_any(df, intervals)


def at_position(df: DataFrame, position: str) -> DataFrame:
    """Rows at ``chrom:pos`` or the next base, the window of a position lookup."""
    chrom, _, pos = position.partition(":")
    if not pos.isdigit():
        raise ValueError(f"not a position: {position!r}; expected chr<N>:<pos>")
    return in_region(df, chrom, int(pos), int(pos) + 1)


def at_site(df: DataFrame, chrom: str, pos: int, ref: str, alt: str) -> DataFrame:
    """The exact site; the spelling of the chromosome does not matter."""
    return df.filter((F.col("chrom") == bare_chrom(chrom)) & (F.col("pos") == pos) & (F.col("ref") == ref) & (F.col("alt") == alt))


def pick_genome(genomes: Sequence[str], genome: str | None) -> str:
    """The asked genome, or the only one; raises ValueError for an unknown or a missing choice."""
    if genome is None:
        if len(genomes) == 1:
            return genomes[0]
        raise ValueError(f"several genomes are loaded, choose one of: {', '.join(genomes)}")
    if genome != ALL_GENOMES and genome not in genomes:
        raise ValueError(f"unknown genome {genome!r}, loaded: {', '.join(genomes)}")
    return genome


def genome_bucket(genome: Column) -> Column:
    """Folder of a genome in the genome layout."""
    return F.pmod(F.hash(genome), F.lit(GENOME_BUCKETS))


def of_genomes(df: DataFrame, *genomes: str) -> DataFrame:
    """Rows of the named genomes; all rows for ``ALL_GENOMES``.

    On a table in the genome layout only those genomes' folders are read.
    """
    if ALL_GENOMES in genomes:
        return df
    rows = df.filter(F.col("genome").isin(*genomes))
    if "genome_bucket" not in df.columns:
        return rows
    return rows.filter(F.col("genome_bucket").isin(*[genome_bucket(F.lit(genome)) for genome in genomes]))


def with_rsids(df: DataFrame, rsids: Sequence[str]) -> DataFrame:
    """Rows with one of the identifiers; a malformed identifier is an error.

    A short list becomes a filter of the scan, a long one a join.
    """
    wanted = list(dict.fromkeys(check_rsid(rsid) for rsid in rsids))
    if len(wanted) <= LISTED_VALUES:
        return df.filter(F.col("rsid").isin(*wanted))
    return df.join(local_table(df.sparkSession, [(rsid,) for rsid in wanted], "rsid string"), "rsid", "left_semi").select(df.columns)


def valid_rsids(df: DataFrame, column: str = "rsid") -> DataFrame:
    """Rows whose identifier is well formed."""
    return df.filter(F.col(column).rlike(RSID_PATTERN))


def without_rsid(df: DataFrame) -> DataFrame:
    """Rows that still need an identifier."""
    return df.filter(F.col("rsid").isNull())


def with_significance(df: DataFrame, term: str) -> DataFrame:
    """Clinical significance contains the term. A substring: ``Pathogenic`` also hits ``Likely_pathogenic``."""
    return df.filter(matches_significance(F.col("clnsig"), term))


def with_condition(df: DataFrame, text: str) -> DataFrame:
    """Condition (spaces for underscores) contains the text, whatever the case."""
    known = F.when((F.col("clndn") != "") & (F.col("clndn") != "."), spaced(F.col("clndn")))
    return df.filter(F.upper(known).contains(text.upper()))


def impact_levels(text: str) -> list[str]:
    """Levels of a comma list; raises ValueError for an unknown one."""
    levels = [level.strip().upper() for level in text.split(",") if level.strip()]
    unknown = sorted(set(levels) - set(IMPACT_LEVELS))
    if unknown:
        raise ValueError(f"unknown impact levels: {', '.join(unknown)}; known: {', '.join(IMPACT_LEVELS)}")
    return levels


def with_impact(df: DataFrame, text: str) -> DataFrame:
    """Impact among the levels, or unknown. An empty list filters nothing."""
    levels = impact_levels(text)
    return df.filter(F.col("impact").isNull() | (F.col("impact") == "") | F.upper("impact").isin(*levels)) if levels else df


def is_informative() -> Column:
    """Has an impact, a clinical significance or an identifier."""
    return (
        (F.coalesce("impact", F.lit("")) != "")
        | ~F.coalesce("clnsig", F.lit("")).isin("", ".")
        | (F.coalesce("rsid", F.lit("")) != "")
    )


def informative(df: DataFrame) -> DataFrame:
    """Drops rows without impact, clinical significance and identifier."""
    return df.filter(is_informative())


def mark_suppressed(df: DataFrame, pgx_variants: DataFrame, gene: str | None = None) -> DataFrame:
    """Adds ``suppressed``, the smart filter's verdict.

    Protected identifiers are the known drug-gene variants of ``gene``, or of each row's own gene.
    """
    known = pgx_variants.filter(F.col("rsid").isNotNull())
    if gene is not None:
        known = known.filter(F.upper("gene") == gene.upper())
        keys, on = known.select("rsid").distinct(), {"rsid": F.col("rsid")}
    else:
        keys = known.select(F.upper("gene").alias("gene"), "rsid").distinct()
        on = {"gene": F.upper("gene"), "rsid": F.col("rsid")}
    marked = left_join_nullable(df, keys.withColumn("_known", F.lit(True)), on)
    verdict = is_suppressed(F.coalesce("_known", F.lit(False)), F.col("impact"), F.col("clnsig"), F.col("af"))
    return marked.withColumn("suppressed", verdict).select(*df.columns, "suppressed")


def smart(df: DataFrame, pgx_variants: DataFrame, gene: str | None = None) -> DataFrame:
    """Rows the smart filter keeps."""
    return mark_suppressed(df, pgx_variants, gene).filter(~F.col("suppressed")).drop("suppressed")


def with_text(df: DataFrame, text: str) -> DataFrame:
    """Any effect field contains the text, whatever the case; the form ``field~"text"`` is also understood."""
    quoted = re.search(r'~"([^"]+)"', text)
    needle = (quoted.group(1) if quoted else text).upper()
    if not needle:
        return df.filter(F.lit(False))
    # a row without a gene has no effect annotation at all
    hit = F.lit(False)
    for field in TEXT_FIELDS:
        hit = hit | F.coalesce(F.upper(field).contains(needle), F.lit(False))
    return df.filter((F.coalesce("gene", F.lit("")) != "") & hit)


def non_reference(df: DataFrame) -> DataFrame:
    """Calls other than homozygous reference; uncalled sites stay."""
    return df.filter(F.col("genotype.zygosity") != "homozygous_ref")


def equals_ignoring_case(df: DataFrame, column: str, value: str) -> DataFrame:
    """Case-insensitive equality."""
    return df.filter(F.upper(column) == value.upper())


def contains_ignoring_case(column: str, text: str) -> Column:
    """Case-insensitive substring, taken literally (``%`` and ``_`` are ordinary characters)."""
    return F.upper(column).contains(text.upper())


def associations_matching(gwas: DataFrame, trait: str | None = None, gene: str | None = None, rsid: str | None = None) -> DataFrame:
    """Associations for a trait (own or mapped name), a mapped gene and an identifier; at least one is needed."""
    if not (trait or gene or rsid):
        raise ValueError("give a trait, a gene or an identifier")
    rows = gwas
    if trait:
        rows = rows.filter(contains_ignoring_case("trait", trait) | contains_ignoring_case("mapped_trait", trait))
    if gene:
        rows = rows.filter(contains_ignoring_case("mapped_gene", gene))
    return rows.filter(F.col("rsid") == rsid) if rsid else rows
