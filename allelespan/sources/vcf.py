"""VCF text as DataFrames.

Plain text splits over tasks. Block-gzipped ``.vcf.gz`` reads with one task per file, so a corpus
is landed as many files and converted to Parquet once (``sinks.write_sites``); ``.bgz`` names must be
renamed to ``.gz`` first, as Spark picks the codec by extension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelespan.functions.contigs import normalize_chrom
from allelespan.functions.vcf_fields import effect_fields, first_frequency, info_field
from allelespan.operators.sizing import pin_if_small
from allelespan.schemas import CLINICAL_COLUMNS, EFFECT_COLUMNS, SITE_KEY


def read_vcf_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of VCF files with the file each came from."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def _record_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("value").startswith("#"))


def _has_place(cells: Column) -> Column:
    return F.coalesce(_column(cells, 1).try_cast("bigint").isNotNull(), F.lit(False))


def mark_records(lines: DataFrame) -> DataFrame:
    """Record lines with ``loaded``: false for lines of fewer than eight columns or whose position is no number, which the parsers leave out."""
    cells = F.split("value", "\t", 9)
    return _record_lines(lines).withColumn("loaded", (F.size(cells) >= 8) & _has_place(cells))


def _column(cells: Column, index: int) -> Column:
    return F.get(cells, F.lit(index))


def parse_vcf(lines: DataFrame, info_fields: list[str] = (), contig_names: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Records with typed key, identifier and the asked INFO fields.

    Headers, lines with fewer than eight columns and lines whose position is no number are skipped, ``.`` as identifier is NULL.
    ``contig_names(contig, new_name)`` maps accessions to chromosome names. Sample columns are
    not split at all. Columns of ``lines`` in ``keep`` stay with their records.
    """
    cells = F.split("value", "\t", 9)
    contig = _column(cells, 0)
    records = _record_lines(lines).filter(F.size(cells) >= 8)
    if contig_names is not None:
        records = records.withColumn("_contig", contig).join(
            contig_names.select(F.col("contig").alias("_contig"), "new_name"), "_contig", "left"
        )
        contig = F.coalesce("new_name", "_contig")
    # a position that is no number makes no record; ``mark_records`` tells them
    records = records.filter(_has_place(cells))
    return records.select(
        normalize_chrom(contig).alias("chrom"),
        _column(cells, 1).try_cast("bigint").alias("pos"),
        _column(cells, 3).alias("ref"),
        _column(cells, 4).alias("alt"),
        F.nullif(_column(cells, 2), F.lit(".")).alias("rsid"),
        *[info_field(_column(cells, 7), field).alias(field) for field in info_fields],
        *keep,
    )


def sample_names(lines: DataFrame) -> DataFrame:
    """One row per (file, sample): the names of the ``#CHROM`` header line and their place."""
    header = lines.filter(F.col("value").startswith("#CHROM\t"))
    cells = F.split("value", "\t")
    names = F.slice(cells, F.lit(10), F.greatest(F.size(cells) - 9, F.lit(0)))
    return header.select("file", F.posexplode(names).alias("sample_index", "sample"))


def _small_names(names: DataFrame) -> DataFrame:
    """Names counted to be few are a broadcast of known size, so the records are not shuffled to find them."""
    pinned = pin_if_small(names)
    return names if pinned is None else F.broadcast(pinned.table)


def _typed_call(cells: Column, sample_cell: Column) -> list[Column]:
    return [
        normalize_chrom(_column(cells, 0)).alias("chrom"),
        _column(cells, 1).try_cast("bigint").alias("pos"),
        F.nullif(_column(cells, 2), F.lit(".")).alias("id"),
        _column(cells, 3).alias("ref"),
        _column(cells, 4).alias("alt"),
        F.substring_index(sample_cell, ":", 1).alias("gt"),
    ]


def _sample_cells() -> Column:
    """The cells after the ninth; none on a short line, whose length Spark may ask for before it drops the line."""
    return F.slice("cells", F.lit(10), F.greatest(F.size("cells") - 9, F.lit(0)))


def parse_calls(lines: DataFrame) -> DataFrame:
    """All samples: one row per (genome, site). The genome is the sample name in the file's header.

    Each record carries its own sample cells into ``posexplode``; the names are joined afterwards on
    (file, place), so no record ever holds the list of names.
    """
    cells = F.split("value", "\t")
    records = _record_lines(lines).filter((F.size(cells) >= 10) & _has_place(cells)).select("file", cells.alias("cells"))
    exploded = records.select(
        "file", "cells", F.posexplode(_sample_cells()).alias("sample_index", "sample_cell")
    ).select("file", "sample_index", *_typed_call(F.col("cells"), F.col("sample_cell")))
    named = exploded.join(_small_names(sample_names(lines)), ["file", "sample_index"])
    return named.select(F.col("sample").alias("genome"), "chrom", "pos", "id", "ref", "alt", "gt")


def parse_packed(lines: DataFrame) -> DataFrame:
    """One row per record: its site and the genotypes of all samples as an array in header order.

    ``sample_names`` gives the names by file and place. A table of this kind stays one row per site however many genomes there are.
    """
    cells = F.split("value", "\t")
    records = _record_lines(lines).filter((F.size(cells) >= 10) & _has_place(cells)).select("file", cells.alias("cells"))
    genotypes = F.transform(_sample_cells(), lambda cell: F.substring_index(cell, ":", 1))
    return records.select("file", *_typed_call(F.col("cells"), F.lit(""))[:-1], genotypes.alias("gts"))


def parse_one_sample(lines: DataFrame, sample: str | None = None) -> DataFrame:
    """One sample per file: the named one, or the first. A file without that sample is an error."""
    cells = F.split("value", "\t")
    picked = _small_names(sample_names(lines).filter(F.col("sample_index") == 0 if sample is None else F.col("sample") == sample))
    records = _record_lines(lines).filter((F.size(cells) >= 10) & _has_place(cells))
    joined = records.join(picked, "file", "left")
    place = F.coalesce("sample_index", F.raise_error(F.lit(f"sample {sample!r} is not in the file")).cast("int"))
    rows = joined.select(F.col("sample").alias("genome"), *_typed_call(cells, F.get(cells, place + F.lit(9))))
    return rows


def effect_layer(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Functional effects and the file's own identifiers; every record gives a row."""
    parsed = parse_vcf(lines, ["ANN"], keep=keep).withColumn("_effect", effect_fields(F.col("ANN")))
    source = F.when(F.col("rsid").isNotNull(), F.lit("vcf")).alias("rsid_source")
    return parsed.select(*SITE_KEY, "rsid", source, *[F.col(f"_effect.{name}").alias(name) for name in EFFECT_COLUMNS], *keep)


def clinical_layer(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Clinical significance; records without one are dropped."""
    parsed = parse_vcf(lines, ["CLNSIG", "CLNDN", "CLNREVSTAT"], keep=keep).filter(F.coalesce("CLNSIG", F.lit("")) != "")
    return parsed.select(*SITE_KEY, *[F.col(name.upper()).alias(name) for name in CLINICAL_COLUMNS], *keep)


def frequency_layer(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Population frequencies; records with neither number are dropped. The older group field wins if filled."""
    parsed = parse_vcf(lines, ["AF", "AF_popmax", "AF_grpmax"], keep=keep)
    grouped = F.coalesce(F.nullif("AF_popmax", F.lit("")), "AF_grpmax")
    rows = parsed.select(*SITE_KEY, first_frequency(F.col("AF")).alias("af"), first_frequency(grouped).alias("af_grpmax"), *keep)
    return rows.filter(F.col("af").isNotNull() | F.col("af_grpmax").isNotNull())


def identifier_layer(lines: DataFrame, contig_names: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Identifiers; records without one are dropped."""
    parsed = parse_vcf(lines, contig_names=contig_names, keep=keep)
    return parsed.filter(F.coalesce("rsid", F.lit("")) != "").select(*SITE_KEY, "rsid", *keep)
