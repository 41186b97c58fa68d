"""The persisted vector index against a brute-force search."""

import duckdb
import numpy as np
import pytest

from loomspan.operators import vector_index
from loomspan.plans import registry
from loomspan.sources.scratch import scratch

ROWS = "node_id string, embedding array<double>, noise int"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '/root/testdata/{sf}/embeddings.parquet' ORDER BY vec_id").df()
    ids, v = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    got = {}
    for r in registry.QUERIES["retrieve_index"](spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.node_id, r.distance)
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    found = 0
    for q, of in got.items():
        assert sorted(of) == list(range(1, 11))
        d = ((v - v[ids == q]) ** 2).sum(1)
        for name, distance in of.values():
            assert abs(distance - d[ids == int(name[1:])][0]) < 1e-9
        found += len({n for n, _ in of.values()} & {f"n{ids[i]}" for i in np.argsort(d, kind="stable")[:10]})
    assert found / (10 * len(got)) >= 0.9


def _brute(rows, queries, k):
    out = {}
    for q, x in queries:
        best = {}
        for i, v in rows:
            d = float(((np.array(v) - np.array(x)) ** 2).sum())
            best[i] = min(d, best.get(i, d))
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def test_everything_probed_is_exact_and_rows_can_be_added(spark, monkeypatch):
    """A hot cell over several shards, repeated rows, an id with two vectors, ties, and vectors that take no part."""
    monkeypatch.setattr(vector_index, "SHARD_ROWS", 40)
    monkeypatch.setattr(vector_index, "LOT", 3)
    r = np.random.default_rng(5)
    rows = [(f"a{i}", r.normal(size=6).round(3).tolist()) for i in range(150)]
    rows += [(f"c{i:03d}", [1.0] * 6) for i in range(120)]
    rows += [rows[0], rows[0], ("a1", [9.0] * 6)]
    bad = [("x1", None), ("x2", [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("x3", [float("nan")] * 6), ("x4", [float("inf")] * 6), ("x5", [1.0]), ("x6", [])]
    late = [(f"b{i}", r.normal(size=6).round(3).tolist()) for i in range(30)] + [rows[3], ("x7", [2.0])]
    path = scratch(spark, "index-test")
    table = lambda data: spark.createDataFrame([(i, v, 0) for i, v in data], ROWS)
    vector_index.build(table(rows + bad), path)
    queries = [(i, r.normal(size=6).tolist()) for i in range(8)] + [(8, [1.0] * 6), (9, [9.0] * 6)]
    asked = spark.createDataFrame([*queries, (10, None), (11, [1.0])], "query_id int, embedding array<double>")

    def search():
        got = {}
        for h in vector_index.search(asked, path, k=5, probe=1.0, refine=200).orderBy("query_id", "rank").collect():
            got.setdefault(h.query_id, []).append((h.distance, h.id))
        return got

    def same(got, want):
        assert got.keys() == want.keys()
        for q in want:
            assert [i for _, i in got[q]] == [i for _, i in want[q]]
            assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]])

    same(search(), _brute(rows, queries, 5))
    vector_index.add(table(late), path)
    same(search(), _brute(rows + late[:-1], queries, 5))
    assert spark.read.parquet(f"{path}/vectors").count() == 150 + 120 + 1 + 30


def test_empty_tables(spark):
    path = scratch(spark, "index-empty")
    vector_index.build(spark.createDataFrame([], ROWS), path)
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, embedding array<double>")
    assert vector_index.search(asked, path).collect() == []
    with pytest.raises(ValueError):
        vector_index.add(spark.createDataFrame([("a", [1.0, 2.0], 0)], ROWS), path)
    full = scratch(spark, "index-one")
    vector_index.build(spark.createDataFrame([("a", [1.0, 2.0], 0)], ROWS), full)
    assert [tuple(r) for r in vector_index.search(asked, full).collect()] == [(1, 1, "a", 0.0)]
    assert vector_index.search(asked.limit(0), full).collect() == []
