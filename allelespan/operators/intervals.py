"""Positions inside genomic intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENE_PADDING = 2_000
INTERVAL_BIN = 65_536
# Intervals in one list, when positions meet them a list at a time.
LISTED_INTERVALS = 1_024


def padded_genes(genes: DataFrame, padding: int = GENE_PADDING) -> DataFrame:
    """Genes with their intervals widened on both sides, not below 1."""
    start = F.greatest(F.lit(1).cast("bigint"), F.col("start_pos") - padding)
    return genes.withColumn("start_pos", start).withColumn("end_pos", F.col("end_pos") + padding)


def _bin(position: Column, size: int) -> Column:
    return F.call_function("div", position, F.lit(size).cast("bigint"))


def _level_sizes(smallest: int) -> list[int]:
    """Bin sizes of the levels, each eight times the one before; the last one cuts every interval there can be into few bins."""
    sizes = [smallest]
    while sizes[-1] < 2**57:
        sizes.append(sizes[-1] * 8)
    return sizes


def _placed(intervals: DataFrame, smallest: int) -> DataFrame:
    """Intervals with their level and the first and last bin they touch there; reversed ones are left out.

    The level is the largest whose bins are at most an eighth of the interval, or the smallest. So an interval touches at most 65 bins.
    """
    sizes = _level_sizes(smallest)
    length = F.col("end_pos") - F.col("start_pos")
    level = F.coalesce(*[F.when(length >= 8 * sizes[k], k) for k in range(len(sizes) - 1, 0, -1)], F.lit(0))
    placed = intervals.filter("start_pos <= end_pos").withColumn("_level", level)
    ends = [F.coalesce(*[F.when(F.col("_level") == k, _bin(F.col(name), size)) for k, size in enumerate(sizes)]) for name in ("start_pos", "end_pos")]
    return placed.withColumn("_first", ends[0]).withColumn("_last", ends[1])


def _used_levels(placed: DataFrame) -> list[int]:
    return sorted(row[0] for row in placed.select("_level").distinct().collect())  # at most one row a level


def _asking(variants: DataFrame, placed: DataFrame, smallest: int, used: Sequence[int] | None = None) -> DataFrame:
    """Variants, once for each level that some interval lies on (or each of ``used``), with their bin there."""
    sizes = _level_sizes(smallest)
    bins = [F.struct(F.lit(k).alias("_level"), _bin(F.col("pos"), sizes[k]).alias("_bin")) for k in (_used_levels(placed) if used is None else used)]
    if len(bins) == 1:
        return variants.withColumn("_level", bins[0]["_level"]).withColumn("_bin", bins[0]["_bin"])
    asked = variants.withColumn("_ask", F.explode(F.array(*bins) if bins else F.lit(None).cast("array<struct<_level:int,_bin:bigint>>")))
    return asked.withColumn("_level", F.col("_ask._level")).withColumn("_bin", F.col("_ask._bin")).drop("_ask")


def _in_bins(placed: DataFrame) -> DataFrame:
    """A row for each bin that an interval touches on its level."""
    return placed.withColumn("_bin", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def _children(of: Column) -> Column:
    """The bins of the next smaller level that make up a bin; around 0 division cuts off on both sides."""
    return F.sequence(of * 8 - F.when(of <= 0, 7).otherwise(0), of * 8 + F.when(of >= 0, 7).otherwise(0))


def _covering(placed: DataFrame, smallest: int, highest: int) -> DataFrame:
    """Each interval as disjoint bins of several levels: ``_whole`` ones lie inside it, the others hold its two ends.

    Inside are the bins of its own level without the outermost two, then on each smaller level what is left of the outermost two of the level
    above, at most 14 bins. The ends are in one or two bins of the smallest level.
    """
    sizes = _level_sizes(smallest)
    ends = [[_bin(F.col(name), size) for name in ("start_pos", "end_pos")] for size in sizes[: highest + 1]]

    def piece(level: Column, bins: Column, whole: bool) -> Column:
        return F.transform(bins, lambda place: F.struct(level.alias("_level"), place.alias("_bin"), F.lit(whole).alias("_whole")))

    def left_over(k: int) -> list[Column]:
        (first, last), (over_first, over_last), below = ends[k], ends[k + 1], F.col("_level") > k
        sides = [F.filter(_children(over_first), lambda place: below & (place > first)), F.filter(_children(over_last), lambda place: below & (place < last))]
        return [piece(F.lit(k), bins, True) for bins in sides]

    own = F.filter(F.sequence("_first", "_last"), lambda place: (place > F.col("_first")) & (place < F.col("_last")))
    pieces = [piece(F.col("_level"), own, True), piece(F.lit(0), F.array_distinct(F.array(*ends[0])), False)]
    for k in range(highest):
        pieces += left_over(k)
    pieced = placed.withColumn("_piece", F.explode(F.concat(*pieces))).drop("_level", "_first", "_last")
    return pieced.select(*[name for name in pieced.columns if name != "_piece"], "_piece.*")


def _listed(covering: DataFrame) -> DataFrame:
    """The intervals of each bin in lists of at most ``LISTED_INTERVALS``."""
    key = ["chrom", "_level", "_bin", "_whole"]
    number = F.row_number().over(Window.partitionBy(*key).orderBy("start_pos", "end_pos"))
    numbered = covering.withColumn("_part", _bin(number - 1, LISTED_INTERVALS))
    fields = [name for name in covering.columns if name not in key]
    return numbered.groupBy(*key, "_part").agg(F.collect_list(F.struct(*fields)).alias("_list")).drop("_part")


def within_intervals(variants: DataFrame, intervals: DataFrame, bin_size: int = INTERVAL_BIN) -> DataFrame:
    """Each variant with every interval of ``intervals(..., chrom, start_pos, end_pos)`` that contains it.

    Bins form levels, the smallest of ``bin_size`` positions and each next one eight times as large. An interval lies on the level that cuts it into
    8 to 65 bins (a short one into at most 9), and a position asks its one bin on each level in use. The join is an equality on (chrom, level, bin)
    and gives each pair once.

    Where all intervals lie on the smallest level, an interval is a row for each bin and every pair of a bin is tested. Otherwise intervals are covered
    by bins of all levels up to their own, and those of a bin are joined as lists: positions are tested at the ends of intervals only, in bins of the
    smallest level, and the join handles a row for a list instead of one for each pair.
    """
    placed = _placed(intervals, bin_size)
    used = _used_levels(placed)
    key = ["chrom", "_level", "_bin"]
    inside = F.col("pos").between(F.col("start_pos"), F.col("end_pos"))
    if not any(used):
        pairs = _asking(variants, placed, bin_size, used).join(_in_bins(placed), key)
        return pairs.filter(inside).drop("_level", "_bin")
    met = _asking(variants, placed, bin_size, range(used[-1] + 1)).join(_listed(_covering(placed, bin_size, used[-1])), key)
    others = [name for name in variants.columns if name != "chrom"]
    return met.select("chrom", *others, "_whole", F.inline("_list")).filter(F.col("_whole") | inside).drop("_whole")


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """(chrom, start_pos, end_pos) of disjoint intervals that cover the same positions; sorted by chromosome, so meant for lookups."""
    by_start = Window.partitionBy("chrom").orderBy("start_pos", "end_pos")
    before = F.max("end_pos").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.filter("start_pos <= end_pos").select("chrom", "start_pos", "end_pos")
    marked = rows.withColumn("_opens", (F.coalesce(before, F.lit(-1)) < F.col("start_pos")).cast("int"))
    grouped = marked.withColumn("_group", F.sum("_opens").over(by_start))
    return grouped.groupBy("chrom", "_group").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("_group")


def inside_any(variants: DataFrame, intervals: DataFrame, bin_size: int = INTERVAL_BIN) -> DataFrame:
    """Variants that lie in at least one interval, each as often as it occurs."""
    return within_intervals(variants, merged_intervals(intervals), bin_size).drop("start_pos", "end_pos").select(variants.columns)


# Positions of one row of a span summary.
SPAN_BIN = 1 << 20


def longest_spans(sites: DataFrame, bin_size: int = SPAN_BIN) -> DataFrame:
    """(chrom, first_pos, last_pos, longest): the longest reference allele among the records of each position bin.

    A genome has a few thousand bins, whatever the number of records and genomes.
    """
    binned = sites.groupBy("chrom", _bin(F.col("pos"), bin_size).alias("_bin")).agg(F.max(F.length("ref")).cast("bigint").alias("longest"))
    first = F.col("_bin") * bin_size
    return binned.select("chrom", first.alias("first_pos"), (first + bin_size - 1).alias("last_pos"), "longest")
