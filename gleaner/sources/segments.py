"""A table that takes single keys: sorted segments, tombstones, merging.

Each write adds a segment of rows, each file sorted by key, and the list of keys it speaks for: those of its rows and those
that are only taken away. A key's rows are those of the newest segment that lists it, so a write never
touches older files, and costs what it brings. After a write the newest segments are merged as long as they aren't
smaller than half of the one before, so there are about as many as the logarithm of the writes, and each
row is written anew about as often.

A segment counts once its key list is finished; what a lost writer leaves behind is never read. Segments that
were merged are removed after the merged one counts. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with rows in several segments that are broadcast to a reader at most; beyond, they are joined by sorting.
FEW = 100_000


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def numbers(spark: SparkSession, path: str, finished: bool = True) -> list[int]:
    """The numbers of the segments that count, or of all that have left files."""
    out = set()
    for name in ("keys",) if finished else ("keys", "rows"):
        fs, at = _files(spark, f"{path}/{name}")
        for s in fs.listStatus(at) if fs.exists(at) else []:
            folder = s.getPath().getName()
            if folder.startswith("segment=") and (not finished or fs.exists(_files(spark, f"{path}/{name}/{folder}/_SUCCESS")[1])):
                out.add(int(folder.removeprefix("segment=")))
    return sorted(out)


def _read(spark: SparkSession, path: str, name: str, segments: list[int]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{name}").parquet(*(f"{path}/{name}/segment={n}" for n in segments)).withColumn("segment", F.col("segment").cast("long"))


def _live(spark: SparkSession, path: str, key: str, segments: list[int]) -> DataFrame:
    rows = _read(spark, path, "rows", segments)
    if len(segments) > 1:
        again = _read(spark, path, "keys", segments).groupBy(key).agg(F.max("segment").alias("_newest"), F.count("*").alias("_n")).where("_n > 1").select(key, "_newest")
        again = F.broadcast(again) if again.limit(FEW + 1).count() <= FEW else again.hint("merge")
        rows = rows.join(again, key, "left").where(F.col("_newest").isNull() | (F.col("segment") == F.col("_newest"))).drop("_newest")
    return rows.drop("segment")


def read(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of all keys."""
    segments = numbers(spark, path)
    return _live(spark, path, key, segments) if segments else spark.read.parquet(f"{path}/rows")  # says that there is none


def _add(rows: DataFrame, keys: DataFrame | None, path: str, key: str, number: int) -> None:
    spark, at = rows.sparkSession, f"{path}/rows/segment={number}"
    rows.sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").parquet(at)  # where they are made: key ranges would take a sample first, for which all rows are made once more
    own = spark.read.schema(rows.schema).parquet(at).select(key)
    own = own if keys is None else own.unionByName(keys.select(key))
    own.where(F.col(key).isNotNull()).distinct().write.mode("overwrite").parquet(f"{path}/keys/segment={number}")


def _merge(spark: SparkSession, path: str, key: str, segments: list[int]) -> None:
    """The newest segments as one."""
    _add(_live(spark, path, key, segments), _read(spark, path, "keys", segments).select(key), path, key, max(numbers(spark, path, finished=False)) + 1)
    for n in segments:
        for name in ("keys", "rows"):
            fs, at = _files(spark, f"{path}/{name}/segment={n}")
            fs.delete(at, True)


def add(rows: DataFrame, path: str, key: str, replaced: DataFrame | None = None) -> DataFrame:
    """write() without merging; gives the keys that the new segment speaks for, readable until the next merge."""
    spark = rows.sparkSession
    number = max(numbers(spark, path, finished=False), default=0) + 1
    _add(rows.where(F.col(key).isNotNull()), replaced, path, key, number)
    return _read(spark, path, "keys", [number]).select(key)


def write(rows: DataFrame, path: str, key: str, replaced: DataFrame | None = None) -> None:
    """Rows take the place of what stood for their keys; of replaced keys nothing else stays either. Rows without a key are left out."""
    add(rows, path, key, replaced)
    merge_newest(rows.sparkSession, path, key)


def merge_newest(spark: SparkSession, path: str, key: str) -> None:
    """Merge the newest segments as long as they aren't smaller than half of the one before."""
    segments = numbers(spark, path)
    if len(segments) > 1:
        size = {r.segment: r.n for r in _read(spark, path, "keys", segments).groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row for each segment
        first, total = len(segments) - 1, size.get(segments[-1], 0)
        while first and 2 * total >= size.get(segments[first - 1], 0):
            first -= 1
            total += size.get(segments[first], 0)
        if first < len(segments) - 1:
            _merge(spark, path, key, segments[first:])


def compact(spark: SparkSession, path: str, key: str) -> None:
    """All segments as one."""
    segments = numbers(spark, path)
    if len(segments) > 1:
        _merge(spark, path, key, segments)
