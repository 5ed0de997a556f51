"""Annotation layers: update, insert-or-update, backfill, clear, build and compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelespan.operators.sizing import pin_if_small, top_per_group
from allelespan.schemas import ANNOTATIONS, CLINICAL_COLUMNS, EFFECT_COLUMNS, FREQUENCY_COLUMNS, LAYERS, SITE_KEY


def one_row_per_site(layer: DataFrame, order: list[Column | str] | None = None) -> DataFrame:
    """One row per site: the first in ``order``, by default the smallest by all other columns.

    Copies of a site are cut inside each task before the shuffle.
    """
    others = [F.col(name).asc_nulls_last() for name in layer.columns if name not in SITE_KEY]
    return top_per_group(layer, SITE_KEY, order or others, 1)


def update_layer(base: DataFrame, layer: DataFrame, columns: list[str]) -> DataFrame:
    """Set ``columns`` from the layer where a base row has a match; no rows are added or removed.

    ``layer`` must hold one row per site.
    """
    fresh = layer.select(*SITE_KEY, F.lit(True).alias("_hit"), *[F.col(name).alias(f"_new_{name}") for name in columns])
    values = [
        F.when(F.col("_hit"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name) if name in columns else F.col(name)
        for name in base.columns
    ]
    return base.join(fresh, SITE_KEY, "left").select(*values)


def upsert_effects(base: DataFrame, layer: DataFrame) -> DataFrame:
    """Insert or update the effect layer.

    Effects are replaced by the new ones, an identifier only where the new one is known, and all other
    columns keep their values. ``layer`` must hold one row per site (``one_row_per_site``).
    """
    renamed = layer.select(*SITE_KEY, F.lit(True).alias("_hit"), *[F.col(n).alias(f"_new_{n}") for n in ["rsid", "rsid_source", *EFFECT_COLUMNS]])
    joined = base.join(renamed, SITE_KEY, "full_outer")
    values = []
    for field in base.columns:
        if field in EFFECT_COLUMNS:
            values.append(F.when(F.col("_hit"), F.col(f"_new_{field}")).otherwise(F.col(field)).alias(field))
        elif field in ("rsid", "rsid_source"):
            values.append(F.coalesce(f"_new_{field}", field).alias(field))
        else:
            values.append(F.col(field))
    return joined.select(*values)


def backfill_rsids(base: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Fill missing identifiers, marking them ``dbsnp``; existing ones are never touched.

    Rows that already have an identifier skip the join altogether.
    """
    known = base.filter(F.col("rsid").isNotNull())
    found = identifiers.select(*SITE_KEY, F.col("rsid").alias("_new"))
    filled = base.filter(F.col("rsid").isNull()).join(found, SITE_KEY, "left")
    source = F.when(F.col("_new").isNotNull(), F.lit("dbsnp")).otherwise(F.col("rsid_source"))
    return known.unionByName(filled.withColumn("rsid", F.col("_new")).withColumn("rsid_source", source).drop("_new"))


def clear_layer(annotations: DataFrame, layer: str) -> DataFrame:
    """Blank one layer's columns; for identifiers only those that the backfill brought."""
    if layer not in LAYERS:
        raise ValueError(f"unknown annotation layer: {layer!r}")
    emptied = F.lit(True) if layer != "dbsnp" else F.coalesce(F.col("rsid_source") == "dbsnp", F.lit(False))
    return annotations.select(
        *[
            F.when(~emptied, F.col(name)).cast(annotations.schema[name].dataType).alias(name) if name in LAYERS[layer] else F.col(name)
            for name in annotations.columns
        ]
    )


def build_annotations(
    effects: DataFrame, clinical: DataFrame | None = None, frequency: DataFrame | None = None, identifiers: DataFrame | None = None
) -> DataFrame:
    """The flat annotation table: effect rows with the other layers joined on the site.

    All joins share one key, so the base is shuffled once; a layer that is None leaves NULLs.
    Identifiers are joined like the others and only used where the record has none.
    """
    rows = effects.select(*SITE_KEY, "rsid", "rsid_source", *EFFECT_COLUMNS)
    for layer, columns in ((clinical, CLINICAL_COLUMNS), (frequency, FREQUENCY_COLUMNS)):
        if layer is not None:
            rows = rows.join(layer.select(*SITE_KEY, *columns), SITE_KEY, "left")
    if identifiers is not None:
        rows = rows.join(identifiers.select(*SITE_KEY, F.col("rsid").alias("_new")), SITE_KEY, "left")
        brought = F.col("rsid").isNull() & F.col("_new").isNotNull()
        rows = rows.withColumn("rsid_source", F.when(brought, "dbsnp").otherwise(F.col("rsid_source")))
        rows = rows.withColumn("rsid", F.coalesce("rsid", "_new"))
    present = set(rows.columns)
    return rows.select(
        *[F.col(f.name) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name) for f in ANNOTATIONS.fields]
    )


DIGEST_BIN = 1 << 20


def _binned(df: DataFrame) -> DataFrame:
    return df.withColumn("_place", F.xxhash64("chrom", F.floor(F.col("pos") / DIGEST_BIN)))


def bin_digests(df: DataFrame) -> DataFrame:
    """(place, rows, total, mixed) of each position bin: digests of its rows that don't depend on their order."""
    row = F.xxhash64(*df.columns)
    grouped = _binned(df).groupBy("_place")
    return grouped.agg(F.count("*").alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64(row)).alias("mixed"))


def differing_bins(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bins whose digests differ or that only one table has; nothing but digests is shuffled."""
    both = bin_digests(left).withColumn("_side", F.lit(1)).unionByName(bin_digests(right.select(*left.columns)).withColumn("_side", F.lit(2)))
    same = (F.count("*") == 2) & (F.min(F.struct("rows", "total", "mixed")) == F.max(F.struct("rows", "total", "mixed")))
    return both.groupBy("_place").agg(same.alias("_same")).filter(~F.col("_same")).select("_place")


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found on one side only, with the side's name; empty if both tables hold the same rows.

    Tables of sites are compared by the digests of their position bins first, and only the rows of differing bins are grouped. Copies are counted per
    side in one grouped pass instead of two set differences.
    """
    columns = left.columns
    right = right.select(*columns)
    if {"chrom", "pos"} <= set(columns):
        bins = pin_if_small(differing_bins(left, right))
        if bins is not None:
            left, right = (_binned(side).join(F.broadcast(bins.table), "_place", "left_semi").select(*columns) for side in (left, right))
    both = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))
    counted = both.groupBy(*columns).agg(F.sum("_side").alias("_balance")).filter(F.col("_balance") != 0)
    side = F.when(F.col("_balance") > 0, "left").otherwise("right")
    return counted.select(*columns, side.alias("side"), F.abs("_balance").alias("copies"))


def changed_files(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files whose size or time differs from the recorded fingerprint, or that are new or gone."""
    stamp = F.concat_ws(":", F.col("size").cast("string"), F.col("modified").cast("string"))
    now = current.select("file", stamp.alias("now"))
    before = recorded.select("file", stamp.alias("before"))
    state = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("before"), "changed")
    return now.join(before, "file", "full_outer").select("file", state.alias("state")).filter(F.col("state").isNotNull())


def fingerprints(spark, paths: str | list[str]) -> DataFrame:
    """(file, path, size, modified) of every input file, from the listing alone.

    ``file`` is spelled as the readers' ``_metadata.file_path`` spells it, ``path`` as readers take it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")  # folder names mean nothing here
    meta = reader.load(paths)  # the content column is pruned, files are only listed
    return meta.select(
        F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified")
    )
