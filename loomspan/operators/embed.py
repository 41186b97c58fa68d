"""Embeddings: joins to given vectors, hashed vectors, user-supplied batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_embeddings(nodes: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the vector of their (id, content hash), and those that lack one."""
    keys = ["node_id", "content_hash"]
    return nodes.join(vectors, keys), nodes.join(vectors.select(*keys), keys, "left_anti")


def hashed_embeddings(texts: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """``(id, embedding)``: signed feature hashing of words, unit length; all zero without a word.

    Words are counted by bucket in each task before the shuffle, so at most ``dim`` rows a text move.
    Rows with one id and different texts have a vector each; rows alike in both add up
    to one, whose unit length hides how many they were.
    """
    words = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\W+")
    row, key = F.xxhash64(text_col).alias("__row"), [id_col, "__row"]
    hashed = texts.select(F.col(id_col), row, F.explode(words).alias("w")).select(*key, "w", F.xxhash64("w").alias("h"))
    sign = F.when(F.col("w") == "", 0).when(F.pmod(F.shiftright("h", 20), F.lit(2)) == 0, 1).otherwise(-1)
    sums = hashed.select(*key, F.pmod("h", F.lit(dim)).cast("int").alias("b"), sign.alias("s")).groupBy(*key, "b").agg(F.sum("s").alias("n"))
    maps = sums.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("norm")).otherwise(0.0))
    return maps.select(id_col, value.alias("embedding"))


def embed_batches(texts: DataFrame, id_col: str, text_col: str, fn: Callable[[list[str]], list[list[float]]], batch_size: int = 20) -> DataFrame:
    """``(id, embedding)`` by a user's batch function, at most ``batch_size`` texts a call."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                yield pd.DataFrame({id_col: part[id_col], "embedding": fn(part[text_col].fillna("").tolist())})

    kind = dict(texts.dtypes)[id_col]
    return texts.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, embedding array<double>")
