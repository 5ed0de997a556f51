"""Session settings and the shared folder that written intermediates go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Compressed bytes that adaptive execution may merge into one task after a shuffle. Of rows of calls these unfold to twenty times as much in sorts and hash tables.
TASK_BYTES = "16m"
_TASK_SETTING = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def bound_tasks(spark: SparkSession) -> None:
    """Shuffled tasks stay small, unless the session says otherwise.

    Left to itself, adaptive execution merges the partitions of a shuffle until there are only as many as cores, or until one holds 64 MB.
    """
    if _TASK_SETTING not in spark.conf.getAll:
        spark.conf.set(_TASK_SETTING, TASK_BYTES)


def build_session(app_name: str = "allelespan", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are designed for.

    Nothing here is needed for right results; the settings only steer physical planning.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split a hot join key even where a later step asks for the join's own partitioning
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config(_TASK_SETTING, TASK_BYTES)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.compression.codec", "zstd")
        # chromosome names are text: '1' must not come back as a number from a folder name
        .config("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the session's checkpoint folder, visible to every executor.

    ``spark.checkpoint.dir`` is the cluster's setting. Only a local session may go without it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/allelespan-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, for results that several branches of a plan read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str | StructType) -> DataFrame:
    """A small table held in the plan itself.

    Arrow rows become a local relation, so neither planning nor running it needs Python workers.
    """
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    columns = {field.name: pa.array([row[i] for row in rows], pa.string() if not rows else None) for i, field in enumerate(fields)}
    table = spark.createDataFrame(pa.table(columns))
    return table.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in fields])
