"""Streams run to the end of the given tables; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import documents
from loomspan.plans import corpus_queries, retrieval_queries
from loomspan.plans import fixtures as X
from loomspan.sources import corpus
from loomspan.sources.scratch import scratch
from loomspan.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    path = f"{d}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def _to_table(stream: DataFrame, what: str) -> DataFrame:
    """Run a complete-mode stream to the end; each batch overwrites the table."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, what)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table")

    q = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def stream_retrieval_health(spark: SparkSession, d: str) -> DataFrame:
    events = _stream(spark, d, "events")
    log = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("intent"), (F.col("event_id") % 4).cast("int").alias("source_count"), F.col("value").cast("double").alias("elapsed_seconds"))
    out = _to_table(streams.retrieval_health(log), "health")
    return out.select(F.unix_micros("window_start").alias("window_us"), "intent", "turns", "no_source", F.round("mean_seconds", 6).alias("mean_seconds"))


def stream_job_state(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "signup", "starting").otherwise("running")
    events = _stream(spark, d, "events").select("event_id", F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("updated_at"))
    return _to_table(streams.job_state(events), "jobs").select("job_id", "status", F.unix_micros("updated_at").alias("updated_us"))


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The documents as files, ingested in one run; their chunks as nodes."""
    docs = _stream(spark, d, "documents")
    files = corpus.files_from_texts(docs, F.col("source"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"))
    base = scratch(spark, "ingest")
    q = streams.ingest(files, f"{base}/state", f"{base}/checkpoint", lambda f: documents.plain_chunks(f).select("repo_name", "file_path", "start_line", "end_line", "node_id", "content_hash", "confidence"))
    q.awaitTermination()
    return streams.current(spark, f"{base}/state")[0].drop("bucket")


QUERIES = {f.__name__: f for f in (stream_retrieval_health, stream_job_state, stream_ingest)}
ORACLES["stream_retrieval_health"] = retrieval_queries.ORACLES["retrieval_log_health"]
ORACLES["stream_job_state"] = f"WITH e AS ({X.duck(retrieval_queries._JOBS)}) SELECT job_id, status, epoch_us(updated_at) AS updated_us FROM e QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, event_id DESC) = 1"
ORACLES["stream_ingest"] = corpus_queries.ORACLES["plain_chunks"]
