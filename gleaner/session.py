"""Session helpers shared by every job: settings, shared folder, lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only when the session names no shared folder (local tests).
LOCAL_CHECKPOINT_DIR = "/tmp/gleaner-checkpoints"


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gleaner")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base and (own := sc.getCheckpointDir()):  # set with setCheckpointDir, below which Spark makes a folder of its own
        base = own.rstrip("/").rpartition("/")[0]
    if not base and not sc.master.startswith("local"):
        raise ValueError("no folder that driver and executors share: set spark.checkpoint.dir")
    return (base or f"file://{LOCAL_CHECKPOINT_DIR}").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SAVED: dict[tuple, str] = {}


def saved(spark: SparkSession, sf_dir: str, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from a source table, written to the shared folder once for each session and state of the source's files, then read."""
    files = spark.read.parquet(f"{sf_dir}/{source}.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time")).alias("h")).first()
    key = (spark.sparkContext.applicationId, sf_dir, source, name, state.n, state.h)
    if key not in _SAVED:
        path = scratch_path(spark, name)
        make().write.parquet(path)
        _SAVED[key] = path
    return spark.read.parquet(_SAVED[key])


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder, setting one only where the session has none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows, and bytes where the Spark version knows that limit, of one batch handed to a Python task.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python tasks small: whole texts are long, and a batch is held twice."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Tables of long texts, whose rows cost much more than reading them.
TEXTS = frozenset(["documents", "pages"])


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a file that can't be split would keep one core busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; Python tasks over it get small batches, long texts are spread over all cores."""
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df
