"""A layer kept up with a folder of source files, chromosome by chromosome."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelespan.operators.layers import changed_files, fingerprints, one_row_per_site
from allelespan.schemas import SITE_KEY
from allelespan.session import local_table, shared_folder
from allelespan.sources.sinks import replace_chromosomes
from allelespan.sources.vcf import read_vcf_lines

# The record of the inputs, beside the data; readers of the data skip names that begin with an underscore.
INPUTS = "_inputs"


class Refresh(NamedTuple):
    """What a refresh did: the record it wrote (None if no input had changed), the chromosomes it rewrote, and the files it read for them."""

    record: int | None
    chromosomes: list[str]
    files: list[str]


class FollowedLayer:
    """One layer at ``path``, fed by the files of ``sources``; ``to_layer(lines, keep=...)`` parses lines, as the layer functions of ``sources.vcf`` do.

    The record holds size, time and rows per chromosome of every input. A refresh compares the files with it, rebuilds the chromosomes that a new, changed
    or gone file has or had rows on from all files that touch them, and leaves the other folders as they are. So the work follows the change, and
    the result is that of a full build. One refresh runs at a time. The record is written last: a refresh that was lost is found out and
    done again by the next one, with the same rows. Fingerprints are taken before anything is read, so a file that changes meanwhile counts as
    changed the next time. A site that several rows give keeps the smallest by its other columns, whichever file they came from.
    """

    def __init__(self, spark: SparkSession, path: str, sources: str | list[str], to_layer: Callable[..., DataFrame]):
        self.spark, self.path, self.sources, self.to_layer = spark, path.rstrip("/"), sources, to_layer

    def _names(self, *folder: str) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *folder)))
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []

    def _drop(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _latest(self) -> int:
        done = [name for name in self._names(INPUTS) if "_SUCCESS" in self._names(INPUTS, name)]
        return max((int(name.removeprefix("n=")) for name in done), default=0)

    def record(self) -> DataFrame | None:
        """(file, path, size, modified, chrom, rows) of the last refresh; a file without rows has one row without chromosome."""
        number = self._latest()
        return self.spark.read.parquet(f"{self.path}/{INPUTS}/n={number}") if number else None

    def changes(self) -> DataFrame:
        """(file, state) of inputs that are new, changed or gone since the last refresh."""
        return self._compared(fingerprints(self.spark, self.sources), self.record())

    def _compared(self, now: DataFrame, record: DataFrame | None) -> DataFrame:
        before = now.limit(0) if record is None else record.select("file", "size", "modified").distinct()
        return changed_files(now, before)

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.to_layer(read_vcf_lines(self.spark, paths), keep=("file",))

    def refresh(self) -> Refresh:
        """Bring the layer up to the files as they are now.

        The driver holds the names of files and chromosomes, which Spark lists there anyway. Changed files are read twice: first for
        the chromosomes they hold.
        """
        now = fingerprints(self.spark, self.sources)
        listed = {row.file: row for row in now.collect()}
        now = local_table(self.spark, list(listed.values()), now.schema)  # as listed once, whatever happens to the files
        record = self.record()
        changed = self._compared(now, record).collect()
        if not changed:
            return Refresh(None, [], [])
        states = local_table(self.spark, changed, "file string, state string")
        held = self._holdings(now.join(states.filter("state <> 'gone'"), "file", "left_semi"), [listed[row.file].path for row in changed if row.state != "gone"])
        affected = held.select("chrom")
        if record is not None:
            affected = affected.unionByName(record.join(states, "file", "left_semi").select("chrom"))
            held = held.unionByName(record.join(states, "file", "left_anti"))
        chromosomes = sorted(row.chrom for row in affected.filter(F.col("chrom").isNotNull()).distinct().collect())
        needed = held.filter(F.col("chrom").isin(chromosomes)).groupBy("file").agg(F.collect_set("chrom").alias("chroms")).collect()
        files = sorted(row.file for row in needed)
        if files:
            rows = self._rows([listed[file].path for file in files]).drop("file")
            replace_chromosomes(one_row_per_site(rows.filter(F.col("chrom").isin(chromosomes))), self.path)
        emptied = set(chromosomes).difference(*[row.chroms for row in needed])
        for folder in self._names():
            if folder.startswith("chrom=") and unquote(folder.removeprefix("chrom=")) in emptied:
                self._drop(folder)
        number = self._latest() + 1
        held.write.mode("overwrite").parquet(f"{self.path}/{INPUTS}/n={number}")
        return Refresh(number, chromosomes, files)

    def _holdings(self, files: DataFrame, paths: list[str]) -> DataFrame:
        """Record rows of some files, written once, so that what is rebuilt and what is recorded go by the same counts."""
        if not paths:
            return files.select("*", F.lit(None).cast("string").alias("chrom"), F.lit(None).cast("bigint").alias("rows"))
        counted = self._rows(paths).groupBy("file", "chrom").agg(F.count("*").alias("rows"))
        folder = shared_folder(self.spark)
        files.join(counted, "file", "left").write.parquet(folder)
        return self.spark.read.parquet(folder)

    def read(self) -> DataFrame | None:
        """The layer's rows; None before anything was written or when no chromosome is left."""
        if not any(name.startswith("chrom=") for name in self._names()):
            return None
        rows = self.spark.read.parquet(self.path)
        others = [name for name in rows.columns if name not in SITE_KEY]
        return rows.select(F.col("chrom").cast("string").alias("chrom"), *SITE_KEY[1:], *others)
