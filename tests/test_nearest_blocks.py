"""Distances in blocks: the same rows as pair by pair, odd vectors included."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import retrieve

Q = "query_id long, g string, q array<float>, budget int"
V = "node_id string, g string, embedding array<float>, extra string"


def plain(q, v):
    near = q.join(v, ["g"]).withColumn("distance", T.squared_l2(F.col("embedding"), F.col("q")))
    return best(near)


def best(near):
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "node_id")
    rows = near.withColumn("r", F.row_number().over(w)).where("r <= budget").select("query_id", "g", "r", "node_id", "extra", "distance")
    return sorted((r.query_id, r.r, r.g, r.node_id, r.extra, repr(r.distance)) for r in rows.collect())


@pytest.mark.parametrize("pairs", [64, 1 << 16])
def test_blocks_give_what_pairs_give(spark, monkeypatch, pairs):
    monkeypatch.setattr(retrieve, "PAIRS", pairs)
    monkeypatch.setattr(retrieve, "SALTS", 3)
    pick = random.Random(1)
    vec = lambda n=5: [pick.choice([0.1, 1e-3, 2.5, -7.0]) for _ in range(n)]  # noqa: E731  few values, so many ties
    v = [(f"n{i}", "ab"[i % 2], vec(), f"x{i}") for i in range(700)] + [(f"same{i}", "a", [0.1] * 5, None) for i in range(300)]
    v += [("null", "a", None, ""), ("gap", "a", [1.0, None, 1.0, 1.0, 1.0], ""), ("short", "a", [1.0], ""), ("none", "c", [], ""), ("nan", "b", [float("nan")] * 5, ""), ("inf", "b", [float("inf")] * 5, ""), ("two", "d", None, ""), ("one", "d", vec(), "")]
    q = [(i, "abcde"[i % 5], vec(), 1 + i % 7) for i in range(60)] + [(100, "a", None, 3), (101, "b", [float("inf")] * 5, 4), (102, "c", [], 2), (103, "b", vec(2), 2), (104, "a", [0.1] * 5, 310), (105, "b", vec(), 400)]
    q, v = spark.createDataFrame(q, Q), spark.createDataFrame(v, V)
    found = retrieve.nearest_in_groups(q, v, ["g"], q_vector="q", v_vector="embedding", v_id="node_id", limit="budget")
    assert best(found) == plain(q, v)


def test_rows_met_are_bounded_by_budgets_and_not_by_vectors(spark):
    v = spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("node_id"), F.lit("a").alias("g"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"), F.lit("").alias("extra"))
    q = spark.range(50).select(F.col("id").alias("query_id"), F.lit("a").alias("g"), F.array(F.lit(0.5).cast("float"), F.lit(0.5).cast("float")).alias("q"), F.lit(2).alias("budget"))
    found = retrieve.nearest_in_groups(q, v, ["g"], q_vector="q", v_vector="embedding", v_id="node_id", limit="budget")
    assert found.count() == 50 * 2 * retrieve.SALTS
