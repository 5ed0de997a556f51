"""Genotypes packed by site: one row per record with an array over the samples of its file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.functions.genotypes import called_alleles, dosage
from allelespan.operators.sizing import pin_if_small, site_predicate, top_per_group


def unpack_calls(packed: DataFrame, names: DataFrame) -> DataFrame:
    """One row per (genome, record); ``names(file, sample_index, sample)`` are the samples of each file."""
    cells = packed.select("file", "chrom", "pos", "id", "ref", "alt", F.posexplode("gts").alias("sample_index", "gt"))
    return cells.join(names, ["file", "sample_index"]).select(F.col("sample").alias("genome"), "chrom", "pos", "id", "ref", "alt", "gt")


def packed_scores(weights: DataFrame, packed: DataFrame, names: DataFrame) -> DataFrame:
    """Scores of all genomes from packed genotypes, with the columns of ``aggregates.polygenic_scores``.

    Sites meet the weights as they are packed, and few positions prune the scan. Each task adds up dosage times weight by (file, sample, score) in its own rows,
    so only these sums are shuffled, never a genotype; names come last. Of several records at one position of a file the first by alleles
    counts, as for unpacked calls. A genome's positions must not be spread over files that repeat them.
    """
    places = weights.select("chrom", "pos").distinct()
    pinned = pin_if_small(places)
    if pinned is not None:
        packed, places = packed.filter(site_predicate(pinned.rows)), F.broadcast(pinned.table)
    at_places = packed.join(places, ["chrom", "pos"], "left_semi")
    first = top_per_group(at_places, ["file", "chrom", "pos"], ["ref", "alt", "gts"], 1)
    matched = first.join(weights, ["chrom", "pos"])
    counts = F.transform("gts", lambda gt: F.struct(dosage(called_alleles(gt, F.col("ref"), F.col("alt")), F.col("effect_allele")).alias("n"), called_alleles(gt, F.col("ref"), F.col("alt")).isNull().alias("missing")))
    cells = matched.select("file", "prs_id", "weight", F.posexplode(counts).alias("sample_index", "count"))
    sums = cells.groupBy("file", "sample_index", "prs_id").agg(
        F.sum(F.col("count.n") * F.col("weight")).alias("score"), F.count("*").alias("found"), F.count_if("count.missing").alias("no_call")
    )
    named = sums.join(names, ["file", "sample_index"]).groupBy(F.col("sample").alias("genome"), "prs_id")
    scores = named.agg(F.sum("score").alias("score"), F.sum("found").alias("found"), F.sum("no_call").alias("no_call"))
    totals = weights.groupBy("prs_id").agg(F.min("trait").alias("trait"), F.count("*").alias("total"))
    return scores.join(totals, "prs_id").select("genome", "prs_id", "trait", "score", "found", "no_call", "total")
