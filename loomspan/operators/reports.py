"""Counts, run summaries, token usage, discovery."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomspan.functions import defaults as D
from loomspan.functions import text as T


def node_type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).orderBy("node_type")


def collection_counts(vectors: DataFrame) -> DataFrame:
    """Every collection, those without rows too."""
    every = vectors.sparkSession.createDataFrame([(c,) for c in D.COLLECTIONS], "collection string")
    counts = vectors.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(every).join(counts, "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("n"))


def run_summary(nodes: DataFrame) -> DataFrame:
    """Nodes by repository and type with subtotals and the total (nulls)."""
    return nodes.rollup("repo_name", "node_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("files"), F.count_if(F.col("node_type").isin(D.SECURITY_TYPES)).alias("security_tags"))


def token_usage(calls: DataFrame) -> DataFrame:
    """Token totals by source and over all (null source)."""
    used = calls.select("source", *[c.alias(k) for k, c in T.usage_tokens(F.col("body")).items()])
    return used.rollup("source").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("total_tokens").alias("total_tokens"), F.count_if(~F.col("has_usage")).alias("missing_usage"))


def store_discovery(vectors: DataFrame, most: int = 200) -> DataFrame:
    name = T.strip(F.col("repo_name"))
    return vectors.select(name.alias("repo_name")).where(F.col("repo_name") != "").distinct().orderBy("repo_name").limit(most)


def store_names(csv: DataFrame) -> DataFrame:
    """``stores``: comma-separated names, trimmed, empty ones dropped, the first of each kept."""
    parts = F.filter(F.transform(F.split("names", ","), T.strip), lambda x: x != "")
    return csv.withColumn("stores", F.array_distinct(parts))


def elapsed_seconds(started: Column, finished: Column) -> Column:
    """Seconds between two times, to the microsecond."""
    return F.round((F.unix_micros(finished) - F.unix_micros(started)) / F.lit(1e6), 6)


def run_report(files: DataFrame, changed: DataFrame, nodes: DataFrame, *, run_id: str, started: Column, finished: Column, fallback: DataFrame | None = None) -> DataFrame:
    """One row a repository of a run: files scanned and changed, nodes in all and by type, security tags, files that went to the fallback, times.

    Each side is counted by itself and a repository that only one of them has is reported too.
    """
    count = lambda df, name: df.groupBy("repo_name").agg(F.count(F.lit(1)).alias(name))
    by_type = nodes.groupBy("repo_name", "node_type").agg(F.count(F.lit(1)).alias("n"))
    of_nodes = by_type.groupBy("repo_name").agg(F.sum("n").alias("nodes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_type", "n")))).alias("node_type_counts"), F.sum(F.when(F.col("node_type").isin(D.SECURITY_TYPES), F.col("n")).otherwise(0)).alias("security_tags"))
    sides = [count(files, "files_scanned"), count(changed, "files_changed"), of_nodes]
    if fallback is not None:
        sides.append(count(fallback, "fallback_files"))
    out = reduce(lambda a, b: a.join(b, "repo_name", "full_outer"), sides)
    numbers = [c for c in out.columns if c not in ("repo_name", "node_type_counts")]
    times = {"run_id": F.lit(run_id), "started_at": started, "finished_at": finished, "elapsed_seconds": elapsed_seconds(started, finished)}
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in numbers}).withColumns(times)


def written_with_counters(nodes: DataFrame, path: str, *by: str, run_id: str) -> DataFrame:
    """Writes a run's nodes and gives its one row of counters, observed while they were written: no further scan.

    ``(run_id, nodes, files, security_tags, characters, started_at, finished_at)``; files are counted approximately (HyperLogLog), as a pass without a
    shuffle allows.
    """
    spark, seen = nodes.sparkSession, Observation(f"run {run_id}")
    counts = [F.count(F.lit(1)).alias("nodes"), F.approx_count_distinct(F.struct("repo_name", "file_path"), 0.01).alias("files"), F.count_if(F.col("node_type").isin(D.SECURITY_TYPES)).alias("security_tags"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("characters")]
    started = datetime.now(UTC)
    nodes.observe(seen, *counts).write.mode("overwrite").partitionBy(*by).parquet(path)
    row = (run_id, *(seen.get[c] for c in ("nodes", "files", "security_tags", "characters")), started, datetime.now(UTC))
    return spark.createDataFrame([row], "run_id string, nodes bigint, files bigint, security_tags bigint, characters bigint, started_at timestamp, finished_at timestamp")


def batch_telemetry(batches: DataFrame) -> DataFrame:
    """``(run_id, collection, batches, nodes, embed_seconds, upsert_seconds)`` from one row a batch (run_id, collection, nodes, embed_seconds, upsert_seconds), with the run's total (null collection)."""
    kept = batches.rollup("run_id", "collection").agg(F.count(F.lit(1)).alias("batches"), *[F.sum(c).alias(c) for c in ("nodes", "embed_seconds", "upsert_seconds")])
    return kept.where(F.col("run_id").isNotNull())


def retrieval_log(turns: DataFrame, hits: DataFrame) -> DataFrame:
    """One event a finished turn, with its sources in order of citation.

    ``turns``: (query_id, query, intent, stores, model, asked_at, answered_at, cited); ``hits``: (query_id, rank, repo_name,
    file_path, start_line, end_line, node_type, collection, distance). A turn without hits has no sources, no citations and no model.
    """
    source = F.struct(F.col("rank").alias("citation_index"), "repo_name", "file_path", "start_line", "end_line", "node_type", "collection", "distance")
    sources = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    j = turns.join(sources, "query_id", "left")
    n = F.coalesce(F.size("sources"), F.lit(0))
    none = F.col("sources").isNull()
    return j.select(
        "query_id", F.col("asked_at").alias("timestamp_utc"), F.lit("chat_turn").alias("event"), "query", "intent", F.col("stores").alias("repo_stores"), F.when(none, 0).otherwise(n).alias("source_count"), none.alias("no_sources"),
        F.when(none, F.array().cast("array<int>")).otherwise(F.col("cited")).alias("cited_indices"), F.when(none, "").otherwise(F.col("model")).alias("model"), elapsed_seconds(F.col("asked_at"), F.col("answered_at")).alias("elapsed_seconds"), "sources",
    )


def append_json(events: DataFrame, path: str) -> None:
    """Add reports or log events to a folder of JSON lines."""
    events.write.mode("append").json(path)
