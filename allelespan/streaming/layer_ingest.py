"""A layer fed by VCF files that arrive in a landing folder.

Every row carries where it came from: the file's time and name, and its place in the file. The newest row of a site by
these wins, inside a batch and between batches alike, so the answer does not depend on how files fall into batches.
Each micro-batch is written as its own increment folder, named by the stream's checkpoint and the batch, so a batch that is run
again after a failure overwrites what it wrote before, and a stream whose checkpoint was lost overwrites nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from allelespan.operators.layers import one_row_per_site
from allelespan.operators.sizing import top_per_group
from allelespan.schemas import SITE_KEY
from allelespan.sources.sinks import LayerStore

#: Where a row came from, the most significant first.
ARRIVAL = ("file_time", "file_name", "split_start", "line")


def newest_first() -> list:
    return [F.col(name).desc() for name in ARRIVAL]


def start_layer_stream(
    spark: SparkSession,
    landing: str,
    store: str,
    checkpoint: str,
    to_layer: Callable[..., DataFrame],
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Read what is in the landing folder, in batches of files, and stop when all of it is stored.

    ``to_layer(lines, keep=...)`` parses lines and keeps the named columns, as the layer functions of ``sources.vcf`` do.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(landing)
    placed = lines.select(
        "value",
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file_name"),
        F.col("_metadata.file_block_start").alias("split_start"),
    )

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        # ids grow along a split, which is all that the order of one file's lines needs
        numbered = batch.withColumn("line", F.monotonically_increasing_id())
        rows = to_layer(numbered, keep=ARRIVAL)
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        one_row_per_site(rows, newest_first()).write.mode("overwrite").parquet(f"{store}/increment={stream}-{batch_id:08d}")

    return (
        placed.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class Runs:
    """What a store holds: increments of batches, and runs that compaction merged from them.

    A run counts once a log entry says what it takes the place of. The entry is a file that must not exist yet, written after the run is whole, so a
    compaction that was lost leaves nothing behind that readers see. A batch that runs again overwrites an increment with the rows it had; if that was
    merged already, the run holds them.
    """

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        root = self._path()
        self._files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.store, *names)))

    def _names(self, *folder: str) -> list[str]:
        path = self._path(*folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(path)) if self._files.exists(path) else []

    def log(self) -> list[dict]:
        """Entries (run, level, takes), oldest first."""
        names = [name for name in self._names(LOG) if name.endswith(".json")]
        rows = self.spark.read.text([f"{self.store}/{LOG}/{name}" for name in names], wholetext=True).collect() if names else []  # one per compaction
        whole = [json.loads(row.value) for row in rows if row.value.endswith("}")]  # an entry that was cut off never counts
        return sorted(whole, key=lambda entry: entry["number"])

    def live(self) -> list[tuple[str, int]]:
        """(folder, level) of everything that readers have to read; increments are on level 0."""
        entries = self.log()
        taken = {name for entry in entries for name in entry["takes"]}
        increments = [name for name in self._names() if name.startswith("increment=") and self._files.exists(self._path(name, "_SUCCESS"))]
        found = [(name, 0) for name in increments] + [(entry["run"], entry["level"]) for entry in entries]
        return [(name, level) for name, level in found if name not in taken]

    def rows(self, folders: list[str]) -> DataFrame:
        """Newest row per site over the folders, with where it came from."""
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(*[f"{self.store}/{name}" for name in folders])
        return top_per_group(rows, SITE_KEY, newest_first(), 1)

    def merge(self, folders: list[str], level: int) -> str:
        """Merge folders into one run of a level and log it."""
        run = f"{MERGED}/run={uuid.uuid4().hex}"
        self.rows(folders).write.parquet(f"{self.store}/{run}")
        number = len([name for name in self._names(LOG) if name.endswith(".json")])
        entry = json.dumps({"number": number, "run": run, "level": level, "takes": folders})
        out = self._files.create(self._path(LOG, f"{number:08d}.json"), False)  # another compaction's entry of that number is an error
        out.write(bytearray(entry.encode()))
        out.close()
        return run


# Folders of a store that begin with an underscore are not increments.
MERGED, LOG = "_merged", "_log"


def compact(spark: SparkSession, store: str, fan: int = 8) -> int:
    """Merge each level that holds ``fan`` folders or more into one run of the next level; returns the number of merges.

    A row is rewritten once per level it climbs, so N increments cost about log N rewrites of each row, and readers find fewer than ``fan`` folders on
    every level. One compaction runs at a time; readers and the stream need not stop.
    """
    if fan < 2:
        raise ValueError("a level needs two folders to merge")
    runs, merges, level = Runs(spark, store), 0, 0
    while True:
        live = runs.live()
        if level > max((at for _, at in live), default=0):
            return merges
        here = [name for name, at in live if at == level]
        if len(here) >= fan:
            runs.merge(here, level + 1)
            merges += 1
        level += 1


def publish(spark: SparkSession, store: str, layers: LayerStore, layer: str, fan: int = 8) -> int:
    """Compact the store by levels and write the next version of a layer from what is left to read."""
    compact(spark, store, fan)
    return layers.write(layer, current_layer(spark, store))


def current_layer(spark: SparkSession, store: str) -> DataFrame:
    """Newest row per site over the merged runs and the increments after them."""
    runs = Runs(spark, store)
    return runs.rows([name for name, _ in runs.live()]).drop(*ARRIVAL)
