"""Writers: site tables, versioned layers and ordered text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from allelespan.operators.filters import genome_bucket
from allelespan.operators.intervals import longest_spans
from allelespan.schemas import LAYERS, SITE_KEY


# Columns that are looked up by value; their row groups get Bloom filters.
LOOKUP_COLUMNS = ("rsid", "genome", "gene")


def _site_writer(df: DataFrame) -> DataFrameWriter:
    """Writer of rows spread by ranges of (chrom, pos), not by chromosome.

    A chromosome with a third of all rows becomes many files written by many tasks, each holding one
    sorted stretch of positions, so position filters skip files and row groups.
    """
    order = [name for name in ("chrom", "pos", "ref", "alt", "genome") if name in df.columns]
    writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("chrom")
    for name in LOOKUP_COLUMNS:
        if name in df.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    return writer


def write_sites(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet in chromosome folders, sorted by position."""
    _site_writer(df).mode(mode).parquet(path)


# A summary beside the data files of a site table; readers of the table skip names that begin with an underscore.
SPANS = "_spans"


def write_spans(spark: SparkSession, path: str) -> None:
    """Store the span summary of the site table at ``path``, from one pass over two of its columns.

    It belongs to the rows as they are now: write it again whenever they change.
    """
    sites = spark.read.parquet(path).select(F.col("chrom").cast("string").alias("chrom"), "pos", "ref")
    longest_spans(sites).coalesce(1).write.mode("overwrite").parquet(f"{path}/{SPANS}")


# The identifier index of a version, beside its data files.
IDENTIFIERS = "_identifiers"


def write_identifiers(annotations: DataFrame, path: str) -> None:
    """Sites sorted by identifier, so that a lookup reads the row groups of its identifiers only. Rows without one are left out."""
    rows = annotations.filter(F.col("rsid").isNotNull()).select("rsid", *SITE_KEY)
    spread = rows.repartitionByRange("rsid", "chrom", "pos").sortWithinPartitions("rsid", "chrom", "pos")
    spread.write.mode("overwrite").option("parquet.bloom.filter.enabled#rsid", "true").parquet(path)


def replace_chromosomes(df: DataFrame, path: str) -> None:
    """Overwrite only the chromosomes present in ``df``."""
    _site_writer(df).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_genomes(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Calls in folders by genome, for questions about whole genomes.

    The position layout serves regions; this one lets ``filters.of_genomes`` read one folder of 256. Rows are
    spread by ranges of (genome, chrom, pos), so a large genome or folder becomes many files.
    """
    placed = df.withColumn("genome_bucket", genome_bucket(F.col("genome")))
    order = ["genome_bucket", "genome", "chrom", "pos"]
    spread = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    spread.write.mode(mode).partitionBy("genome_bucket").option("parquet.bloom.filter.enabled#genome", "true").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """A table bucketed and sorted by site.

    Two tables with the same number of buckets join on the site without shuffling either; worth it for
    calls and annotations that are joined again and again. A site's rows share a bucket, so tables with
    very hot sites are better kept as ``write_sites`` leaves them.
    """
    spread = df.repartition(buckets, *SITE_KEY)  # one file per bucket
    spread.write.mode("overwrite").option("path", path).bucketBy(buckets, *SITE_KEY).sortBy(*SITE_KEY).saveAsTable(table)


def write_tsv(df: DataFrame, path: str, order: list[Column | str]) -> None:
    """Ordered tab-separated export, NULL written as ``.``; part files follow the global order."""
    df.orderBy(*order).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue=".", emptyValue="")


class LayerStore:
    """Each annotation layer as its own dataset of numbered versions below one folder.

    A writer first claims its number by creating a file that must not exist, so two writers never share a version. A version counts only once Spark has
    committed it (``_SUCCESS``), so a failed refresh leaves readers on the version before. Refreshing or clearing one layer never
    rewrites another. A layer with identifiers gets its index in the same version, written before the version counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _check(self, layer: str) -> str:
        if layer != "sites" and layer not in LAYERS:
            raise ValueError(f"unknown annotation layer: {layer!r}")
        return layer

    def _path(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))

    def _folder(self, layer: str):
        folder = self._path(layer)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _claimed(self, layer: str) -> list[int]:
        folder, files = self._folder(self._check(layer))
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(name.removeprefix("v=")) for name in names if name.startswith("v="))

    def versions(self, layer: str) -> list[int]:
        """Committed versions, oldest first."""
        _, files = self._folder(layer)
        return [number for number in self._claimed(layer) if files.exists(self._path(layer, f"v={number}", "_SUCCESS"))]

    def claim(self, layer: str) -> int:
        """A version number of one's own: the claim file is created only if nobody has it, otherwise the next number is tried."""
        taken = self._claimed(layer)
        number, (_, files) = (taken[-1] if taken else 0) + 1, self._folder(layer)
        while not files.createNewFile(self._path(layer, f"v={number}", "_claim")):
            number += 1
        return number

    def write(self, layer: str, df: DataFrame, number: int | None = None, keep: int | None = None) -> int:
        """Write the next version, or a claimed one, and return its number; with ``keep`` only that many committed versions stay."""
        if keep is not None and keep < 1:
            raise ValueError("at least one version has to be kept")
        number = self.claim(layer) if number is None else number
        path, (_, files) = f"{self.root}/{layer}/v={number}", self._folder(layer)
        try:
            if "rsid" in df.columns:
                write_identifiers(df, f"{path}/{IDENTIFIERS}")
            write_sites(df, path, mode="append")
        except Exception:
            files.delete(self._path(layer, f"v={number}"), True)  # its own claim, never committed
            raise
        if keep is not None:
            for old in self.versions(layer)[:-keep]:
                files.delete(self._path(layer, f"v={old}"), True)
        return number

    def _version(self, layer: str, version: int | None) -> str | None:
        done = self.versions(layer)
        if version is not None and version not in done:
            raise ValueError(f"version {version} of {layer!r} has not been committed")
        return f"{self.root}/{layer}/v={version or done[-1]}" if done else None

    def read(self, layer: str, version: int | None = None) -> DataFrame | None:
        """Latest committed version, or the named one; None for a layer that was never written or has been cleared."""
        path = self._version(layer, version)
        if path is None:
            return None
        rows = self.spark.read.parquet(path)
        others = [name for name in rows.columns if name not in SITE_KEY]
        return rows.select(F.col("chrom").cast("string").alias("chrom"), *SITE_KEY[1:], *others)

    def identifiers(self, layer: str, version: int | None = None) -> DataFrame | None:
        """The identifier index of that version; None if the layer has no version or no identifiers."""
        path = self._version(layer, version)
        if path is None or "rsid" not in self.spark.read.parquet(path).columns:
            return None
        return self.spark.read.parquet(f"{path}/{IDENTIFIERS}")

    def clear(self, layer: str) -> None:
        """Drop a layer; the site table itself cannot be cleared."""
        if layer not in LAYERS:
            raise ValueError(f"unknown annotation layer: {layer!r}")
        folder, files = self._folder(layer)
        files.delete(folder, True)
