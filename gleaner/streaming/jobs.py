"""Structured Streaming jobs, each with a batch twin where one exists.

Every job runs with availableNow over what has arrived and keeps its progress beside its output. Ingest hands
rows that fail on with their error; jobs by key read a batch in time order and keep a small state for each key as a
table beside the answers, so that a key with any number of rows is one stream through a task.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.session import materialise, spread
from gleaner.sources.specs import load_index, persist_index


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], out: str, mode: str = "append") -> None:
    """Process all that has arrived, batch by batch, then stop. What was done is kept beside out, so a second call over the same source goes on from there."""
    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    q.awaitTermination()


def files_as_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream with the schema that it has.

    The path is given as a pattern that only it fits: a stream takes a plain path for a folder.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def guarded(f: Callable[[pd.Series], pd.Series], returns: str) -> Callable[[Column], Column]:
    """A vectorised function as one that gives struct<value, error>: where a batch fails, its rows are tried one by one, and those that fail have the error."""

    def run(col: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"value": pd.Series(list(f(col)), dtype=object), "error": None})
        except Exception:  # whatever the given function raises belongs to its row
            out: list[tuple] = []
            for i in range(len(col)):
                try:
                    out.append((f(col.iloc[i : i + 1]).iloc[0], None))
                except Exception as e:
                    out.append((None, f"{type(e).__name__}: {e}"[:500]))
            return pd.DataFrame(out, columns=["value", "error"], dtype=object)

    return F.pandas_udf(run, f"value {returns}, error string")


#: Jobs that look for the rows that make a whole batch fail, at most.
SEARCHES = 64


def ingest(documents: DataFrame, chunker: Callable[[DataFrame], DataFrame], out: str, embed: Callable[[DataFrame], DataFrame] | None = None, attempts: int = 3, wait: float = 1.0) -> None:
    """Chunk and embed arriving documents into a table by document; one that arrives again replaces what stood for it.

    embed adds a column embedding to chunks, and may add a column error (see guarded): a document with an
    error in one of its chunks is tried again alone, up to `attempts` times, `wait` seconds after the first try and twice as
    long after each further one; then it stands with status failed and its error. Where a row makes the
    whole job fail, the batch is halved until the rows that do are alone, in at most SEARCHES jobs; what can't be told
    apart then fails together. Each failed try is a row of the folder dead-letters (doc_id, attempt, error). A document
    without text stands as failed, too; rows without an id, which can't be replaced, go to a folder
    of their own. A batch that is run again replaces itself.
    """
    add = embed or (lambda chunks: chunks.withColumn("embedding", F.lit(None).cast("array<double>")))
    result = ("doc_id", "chunk_index", "content", "embedding", "status", "error")

    def failed(rows: DataFrame, error: Column) -> DataFrame:
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("chunk_index", "int"), ("content", "string"), ("embedding", "array<double>"))]
        return rows.select("doc_id", *empty, F.lit("failed").alias("status"), error.alias("error")).distinct()

    def tried(docs: DataFrame, left: list[int]) -> list[DataFrame]:
        """Tables of chunks with an error, null where all is well, of all documents."""
        try:
            chunks = add(chunker(docs))
            error = F.col("error") if "error" in chunks.columns else F.lit(None)
            rows = chunks.withColumns({"chunk_index": F.col("chunk_index").cast("int"), "embedding": F.col("embedding").cast("array<double>"), "error": error.cast("string"), "status": F.lit("completed")})
            left[0] -= 1
            return [materialise(rows.select(*result), "ingest-tried")]
        except (PySparkException, Py4JJavaError) as e:
            half = F.pmod(F.xxhash64("doc_id", F.lit(left[0])), F.lit(2)) == 0
            if left[0] > 0 and docs.select("doc_id").distinct().limit(2).count() > 1:
                return [t for side in (half, ~half) for t in tried(docs.where(side), left)]
            return [materialise(failed(docs, F.lit(str(e).partition("\n")[0][:500])), "ingest-failed")]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.where("doc_id is null").write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
        known = spread(materialise(spread(batch.where("doc_id is not null")), "ingest-batch"))
        todo, done = known.where("text is not null"), failed(known.where("text is null"), F.lit("no text"))
        for attempt in range(1, attempts + 1):
            rows = reduce(DataFrame.unionByName, tried(todo, [SEARCHES]))
            bad = materialise(rows.where("error is not null").groupBy("doc_id").agg(F.min("error").alias("error")), "ingest-bad")
            if bad.isEmpty():  # rows stay where they are
                done = done.unionByName(rows)
                break
            done = done.unionByName(rows.join(bad.select("doc_id").hint("merge"), "doc_id", "left_anti"))
            bad.select("doc_id", F.lit(attempt).alias("attempt"), "error").write.mode("overwrite").parquet(f"{out}/dead-letters/batch={batch_id}/try={attempt}")
            if attempt == attempts:
                done = done.unionByName(failed(bad, F.col("error")))
            else:
                time.sleep(wait * 2 ** (attempt - 1))
                todo = todo.join(bad.select("doc_id").hint("merge"), "doc_id", "left_semi")
        persist_index(done.select(*result), f"{out}/chunks", "doc_id", known.select("doc_id").distinct())

    run(documents, write, out)


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, chunk_index, content, embedding, status, error of all documents that have arrived."""
    return load_index(spark, f"{out}/chunks", key="doc_id")


def _batches(spark: SparkSession, out: str) -> list[int]:
    """The finished batches of a folder, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(p.getName().removeprefix("batch=")) for p in found if p.getName().startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _remove(spark: SparkSession, out: str, batches: list[int]) -> None:
    for n in batches:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch={n}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _of(spark: SparkSession, out: str, batches: list[int]) -> DataFrame:
    return spark.read.option("basePath", out).parquet(*(f"{out}/batch={n}" for n in batches))


#: Batches of changes after which they become one table.
MERGED = 16


def progress(events: DataFrame, out: str, current: DataFrame | None = None) -> None:
    """The latest event of each user, kept up to date: user_id, ts, event_type.

    With current (user_id, config_id), events of another configuration than the user's current one are
    ignored. A batch writes the users that it changes; after MERGED of them they become one table and are removed.
    """
    spark = events.sparkSession
    if current is not None:
        events = events.join(current.select("user_id", "config_id").hint("merge"), ["user_id", "config_id"], "left_semi")
    newest = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", "m.ts", "m.event_type")

    def write(batch: DataFrame, n: int) -> None:
        before = _batches(spark, out)
        if n in before:  # done before the stream could note it
            return
        if len(before) >= MERGED:
            batch = materialise(batch.unionByName(latest(spark, out).join(batch.select("user_id").hint("merge"), "user_id", "left_anti")), "progress")
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        if len(before) >= MERGED:
            _remove(spark, out, before)

    run(newest, write, out, mode="update")


def latest(spark: SparkSession, out: str, key: str = "user_id") -> DataFrame:
    """Of each key what the newest batch says that has it."""
    rows = _of(spark, out, _batches(spark, out))
    names = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*names), "batch").alias("m")).select("m.*")


def newest_table(spark: SparkSession, out: str) -> DataFrame:
    """The newest of the whole tables that a job wrote batch by batch."""
    return _of(spark, out, _batches(spark, out)[-1:]).drop("batch")


def _admit(limit: int, seconds: int, stamps: list[float], log: deque) -> list[bool]:
    """Which of the requests, in order, are accepted: at most `limit` accepted ones within the last `seconds`, one exactly that old included."""
    out = []
    for t in stamps:
        while log and log[0] < t - seconds:
            log.popleft()
        ok = len(log) < limit
        if ok:
            log.append(t)
        out.append(ok)
    return out


Fold = Callable[[list[float] | None], tuple[Callable[[dict], dict], Callable[[], list[float]]]]


def _folded(events: DataFrame, keys: list[str], fold: Fold, answer: str, before: DataFrame | None = None, state: bool = False) -> DataFrame:
    """Rows of each key in time order through a fold that holds little state, however many rows a key has.

    fold takes what was kept of a key (null at first) and gives a function of a row and one that tells what to keep. With
    before (keys, kept, newest) a key goes on from there, and with state the result also has a row for each key: kept, and
    newest, the time of its last row.
    """
    kinds = dict(events.dtypes)
    names = [c.split()[0] for c in answer.split(", ")]
    extra = [*(f"{k} {kinds[k]}" for k in keys), "kept array<double>", "newest double"] if state else []
    rows = events.select(*events.columns, F.lit(None).cast("array<double>").alias("kept"), F.lit(1).alias("_turn"))
    if before is not None:
        rows = rows.unionByName(before.select(*keys, "kept", F.col("newest").alias("t"), F.lit(0).alias("_turn")), allowMissingColumns=True)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step, keep, newest, schema = None, None, None, None, None
        end = lambda: dict(zip(keys, key, strict=True)) | {"kept": keep(), "newest": newest}
        for batch in batches:
            out = []
            kept_schema = {f.name: f.type for f in batch.schema}
            schema = pa.schema([(c, {"long": pa.int64(), "boolean": pa.bool_()}[t]) for c, t in (x.split() for x in answer.split(", "))] + ([(k, kept_schema[k]) for k in keys] + [("kept", pa.list_(pa.float64())), ("newest", pa.float64())] if state else []))
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key or step is None:
                    if state and step is not None:
                        out.append(end())
                    key, newest = own, row["t"]
                    step, keep = fold(row["kept"])
                if row["_turn"]:
                    out.append(step(row))
                newest = row["t"] if newest is None or (row["t"] is not None and row["t"] > newest) else newest
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if state and step is not None:
            yield pa.RecordBatch.from_pylist([end()], schema=schema)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "_turn", "t", "event_id")
    return dealt.mapInArrow(go, ", ".join([answer, *extra])).select(*names, *(["kept", "newest", *keys] if state else []))


def _kept_run(events: DataFrame, out: str, keys: list[str], fold: Fold, answer: str, seconds: float) -> None:
    """A fold over a stream: answers by batch, and the state of all keys that a later row can meet, as a table of the newest batch."""
    spark, states = events.sparkSession, f"{out}/states"
    first = answer.split()[0]

    def write(batch: DataFrame, n: int) -> None:
        old = [b for b in _batches(spark, states) if b < n]
        before = _of(spark, states, old[-1:]).drop("batch") if old else None
        both = materialise(_folded(batch, keys, fold, answer, before, state=True), "folded")
        kept = both.where("kept is not null")
        now = kept.agg(F.max("newest").alias("now"))  # one row
        kept.select(*keys, "kept", "newest").join(F.broadcast(now), how="cross").where(F.col("newest") >= F.col("now") - seconds).drop("now").write.mode("overwrite").parquet(f"{states}/batch={n}")
        both.where(f"{first} is not null or kept is null").select(*(c.split()[0] for c in answer.split(", "))).write.mode("overwrite").parquet(f"{out}/answers/batch={n}")
        _remove(spark, states, old[:-1])

    run(events, write, out)


def answered(spark: SparkSession, out: str) -> DataFrame:
    """The answers of all batches."""
    return _of(spark, f"{out}/answers", _batches(spark, f"{out}/answers")).drop("batch")


def _limited(limit: int, seconds: int) -> Fold:
    def fold(kept: list[float] | None):
        log = deque(kept or [])
        return lambda row: {"event_id": row["event_id"], "accepted": _admit(limit, seconds, [row["t"]], log)[0]}, lambda: list(log)

    return fold


def _requests(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").cast("double").alias("t"))


def rate_limit(events: DataFrame, limit: int = 30, seconds: int = 60) -> DataFrame:
    """accepted for each request by (user, kind): at most `limit` accepted ones within `seconds`."""
    return _folded(_requests(events), ["user_id", "event_type"], _limited(limit, seconds), "event_id long, accepted boolean")


def rate_limit_stream(events: DataFrame, out: str, limit: int = 30, seconds: int = 60) -> None:
    """rate_limit over a stream; the state of a key is the accepted times of the window, at most `limit`, kept for as long as they count."""
    _kept_run(_requests(events), out, ["user_id", "event_type"], _limited(limit, seconds), "event_id long, accepted boolean", seconds)


def _replayed(ttl: float) -> Fold:
    def fold(kept: list[float] | None):
        until = list(kept or [float("-inf")])

        def step(row: dict) -> dict:
            hit = row["t"] < until[0]
            if not hit:
                until[0] = row["t"] + ttl
            return {"event_id": row["event_id"], "hit": hit}

        return step, lambda: list(until)

    return fold


def _queries(log: DataFrame) -> DataFrame:
    return log.select("event_id", "key", F.col("ts").cast("timestamp").cast("double").alias("t"))


def cache_replay(log: DataFrame, ttl: float) -> DataFrame:
    """hit for each query of a log (event_id, key, ts): a miss opens a window of ttl seconds, hits don't extend it."""
    return _folded(_queries(log), ["key"], _replayed(ttl), "event_id long, hit boolean")


def cache_replay_stream(log: DataFrame, out: str, ttl: float) -> None:
    """cache_replay over a stream; the state of a key is the end of its window, kept for ttl after its last query."""
    _kept_run(_queries(log), out, ["key"], _replayed(ttl), "event_id long, hit boolean", ttl)


def expire_tasks(tasks: DataFrame, hours: int = 1, per_user: int = 50, most: int = 1000) -> DataFrame:
    """Tasks of the last hours before the newest: the newest per_user of each user, of these the newest `most`."""
    newest = tasks.agg(F.max("ts").alias("_now"))
    live = tasks.join(F.broadcast(newest), how="cross").where(F.col("ts") >= F.col("_now") - F.expr(f"INTERVAL {hours} HOURS"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))
    return live.withColumn("_n", n).where(F.col("_n") <= per_user).orderBy(F.desc("ts"), "event_id").limit(most).drop("_n", "_now")


def expire_tasks_stream(tasks: DataFrame, out: str, hours: int = 1, per_user: int = 50, most: int = 1000) -> None:
    """expire_tasks kept up to date; each batch writes the tasks that live after it.

    What a batch leaves and what arrives next are all that the next one needs: a task over a cap has
    enough newer ones before it for good, as only newer ones take their place. A task that arrives twice
    within the hours counts once.
    """
    spark = tasks.sparkSession
    once = tasks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["event_id"])

    def write(batch: DataFrame, n: int) -> None:
        old = [b for b in _batches(spark, out) if b < n]  # a batch that is run again must not read its own output
        if old:
            batch = batch.unionByName(_of(spark, out, old[-1:]).drop("batch"))
        materialise(expire_tasks(batch, hours, per_user, most), "tasks").write.mode("overwrite").parquet(f"{out}/batch={n}")
        _remove(spark, out, old[:-1])

    run(once, write, out)
