"""Change classes and upserts. Tables stay plain parquet: an upsert is a join and a rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE = ["repo_name", "file_path"]


def changed_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose (repo, path, hash) is not registered."""
    return files.join(registry.select(*FILE, "file_hash"), [*FILE, "file_hash"], "left_anti")


def change_classes(files: DataFrame, registry: DataFrame) -> DataFrame:
    """``(file, change)``: new, changed, unchanged or removed."""
    old = registry.select(*FILE, F.col("file_hash").alias("old_hash"))
    kind = F.when(F.col("old_hash").isNull(), "new").when(F.col("file_hash").isNull(), "removed").when(F.col("file_hash") == F.col("old_hash"), "unchanged").otherwise("changed")
    return files.select(*FILE, "file_hash").join(old, FILE, "full_outer").select(*FILE, kind.alias("change"))


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_registry(registry: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    return upsert_latest(registry.select(*FILE, "file_hash", "last_indexed_at"), files.select(*FILE, "file_hash", now.alias("last_indexed_at")), FILE)


NODE_UPDATES = ("content_hash", "confidence", "text", "indexed_at")


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """On a known id only hash, confidence, text and time change; type, language, symbol and lines stay."""
    keys = ["repo_name", "node_id"]
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, keys, "full_outer")
    cols = [c for c in old.columns if c not in keys]
    pick = lambda c: (F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in NODE_UPDATES else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))).alias(c)
    return j.select(*keys, *map(pick, cols))


def replace_by_file(old: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of changed or removed files go; the new ones come. A replay gives the same table."""
    return old.join(changed.select(*FILE).distinct(), FILE, "left_anti").unionByName(new)


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert_latest(old, new, ["collection", "repo_name", "node_id"])


def metadata_page(vectors: DataFrame, where: Column | None, limit: int, offset: int) -> DataFrame:
    """One page of metadata in order of node id."""
    rows = vectors if where is None else vectors.where(where)
    return rows.orderBy("node_id").offset(offset).limit(limit)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Partitioned by collection and repository; hot ones are split by AQE's rebalance."""
    vectors.hint("rebalance", "collection", "repo_name").write.mode("overwrite").partitionBy("collection", "repo_name").parquet(path)


def batches(nodes: DataFrame, size: int = 20) -> DataFrame:
    """``(collection, batches, nodes)``: how many requests of ``size`` texts each collection takes."""
    return nodes.groupBy("collection").agg(F.count(F.lit(1)).alias("nodes")).withColumn("batches", F.ceil(F.col("nodes") / size).cast("long"))


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1).drop("r")
