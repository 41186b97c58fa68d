"""Streams: incremental ingest, retrieval health, job state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from loomspan.operators import store


BUCKETS = 256


def current(spark: SparkSession, state: str, before: int | None = None, node_schema: StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, registry)``: of each bucket of files the latest version, or the latest older than batch ``before``."""
    registry = spark.read.parquet(f"{state}/registry")
    registry = registry if before is None else registry.where(F.col("batch") < before)
    versions = registry.groupBy("bucket").agg(F.max("batch").alias("batch"))  # BUCKETS rows at most
    schema = None if node_schema is None else StructType([*node_schema.fields, StructField("batch", IntegerType()), StructField("bucket", IntegerType())])
    nodes = (spark.read.schema(schema) if schema else spark.read).parquet(f"{state}/nodes")
    latest = lambda df: df.join(F.broadcast(versions), ["batch", "bucket"], "left_semi").drop("batch")
    return latest(nodes), latest(registry)


def ingest(files: DataFrame, state: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Hash-gated ingest: each batch extracts changed files and replaces their nodes.

    Files belong to buckets by their name's hash. A batch writes new versions of the buckets that hold a changed
    file, in folders of its own, and nothing of the others, so its cost follows what has changed. Writing a batch
    again overwrites the same folders from the same older versions, so a replay changes nothing. The registry,
    which says what versions there are, is written last. Read the state with ``current``.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select("repo_name", "file_path", "text", "lang", "ext", "file_hash").dropDuplicates(["repo_name", "file_path"])
        bucket = F.pmod(F.xxhash64("repo_name", "file_path"), F.lit(BUCKETS)).cast("int")
        registered = new.select("repo_name", "file_path", "file_hash")
        if batch_id:
            old_nodes, old = current(spark, state, batch_id, extract(new).schema)
            changed = store.changed_files(new, old).persist()
            touched = [r[0] for r in changed.select(bucket).distinct().collect()]  # BUCKETS numbers at most
            mine = lambda df: df.where(F.col("bucket").isin(touched)).drop("bucket")
            nodes = store.replace_by_file(mine(old_nodes), changed, extract(changed))
            registry = store.upsert_latest(mine(old), changed.select(*registered.columns), store.FILE)
        else:
            changed, nodes, registry = None, extract(new), registered
        for what, df in (("nodes", nodes), ("registry", registry)):
            df.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/{what}/batch={batch_id}")
        if changed is not None:
            changed.unpersist()

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vacuum(spark: SparkSession, state: str, oldest: int) -> int:
    """Deletes versions of buckets that no reader of batch ``oldest`` or a later one needs; how many folders went.

    A snapshot before a batch needs each bucket's latest version before it. So of the versions before ``oldest`` each
    bucket keeps the last, and all from there on stay. What goes is never the latest version, so a vacuum that was
    cut short, or runs beside the stream, harms nobody; run it again to finish.
    """
    versions = spark.read.parquet(f"{state}/registry").select("bucket", "batch").distinct()
    kept = versions.where(F.col("batch") < oldest).groupBy("bucket").agg(F.max("batch").alias("last"))
    gone = versions.join(kept, "bucket").where(F.col("batch") < F.col("last")).select("batch", "bucket").collect()  # BUCKETS a batch at most
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for what in ("nodes", "registry"):
        for batch, bucket in gone:
            path = jvm.org.apache.hadoop.fs.Path(f"{state}/{what}/batch={batch}/bucket={bucket}")
            n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def retrieval_health(log: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Turns, no-source turns and mean latency by window and intent; works on streams and on tables."""
    marked = log.withWatermark("ts", late) if log.isStreaming else log
    agg = marked.groupBy(F.window("ts", window).alias("w"), "intent").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("source_count") == 0).alias("no_source"), F.avg("elapsed_seconds").alias("mean_seconds"))
    return agg.select(F.col("w.start").alias("window_start"), "intent", "turns", "no_source", "mean_seconds")


def job_state(events: DataFrame) -> DataFrame:
    """Latest status by job; in update mode on a stream."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("updated_at", "event_id")).alias("status"), F.max("updated_at").alias("updated_at"))


JOBS = "job_id string, status string, updated_at timestamp, stale boolean"
_RUNNING = ("starting", "running")


def _watch(limit: timedelta) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def one(key: tuple, events: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, event, status = state.get if state.exists else (None, -1, "")
        stale = state.hasTimedOut
        if not stale:
            for part in events:
                for row in part.itertuples():
                    if at is None or (row.updated_at, row.event_id) > (at, event):
                        at, event, status = row.updated_at, int(row.event_id), row.status
            if status in _RUNNING:
                due = int((at + limit).timestamp() * 1000)
                if due > state.getCurrentWatermarkMs():
                    state.setTimeoutTimestamp(due)
                else:
                    stale = True
        if stale:
            status = "failed"
        state.update((pd.Timestamp(at).to_pydatetime(), event, status))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "updated_at": [at], "stale": [stale]})

    return one


def live_job_state(events: DataFrame, limit: timedelta = timedelta(minutes=30), late: str = "10 minutes") -> DataFrame:
    """A stream of ``JOBS``: each job's latest status whenever it changes; a job left starting or running for ``limit`` fails by itself.

    ``events``: a stream of (job_id, status, updated_at, event_id). A timer a job goes off once the watermark, ``late`` behind the latest
    event, has passed its last event by ``limit``. State holds one row a job. An event that comes later than the watermark
    is not seen; one in time after its job failed takes it up again.
    """
    seen = events.select("job_id", "status", "updated_at", F.col("event_id").cast("long").alias("event_id")).withWatermark("updated_at", late)
    return seen.groupBy("job_id").applyInPandasWithState(_watch(limit), JOBS, "at timestamp, event long, status string", "update", GroupStateTimeout.EventTimeTimeout)
