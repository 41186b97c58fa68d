"""Graph search where one vector is far longer than the rest."""

import collections

import numpy as np
import pytest

from loomspan.llm import graph_ann, support


@pytest.mark.parametrize("times", [1e4, 1e8, 1e20])
def test_ann_recall_beside_a_long_vector(spark, times):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1500, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] *= times
    nodes = graph_ann.usable(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    index = support.written(graph_ann.build(nodes, 20), "test-index")
    got = collections.defaultdict(set)
    for h in graph_ann.search(index, nodes.where("id % 20 = 0 or id = 7"), 20).collect():
        got[h.query_id].add(h.id)
    assert len(got) == 76
    found = 0
    for q, ids in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        found += len(ids & set(np.argsort(-s)[:20]))
    assert found / (20 * len(got)) >= 0.95


def test_an_id_with_several_vectors_counts_once_at_its_best(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.0]), (2, [3.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0])]
    nodes = graph_ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = [(h.rank, h.id, h.score) for h in graph_ann.search(graph_ann.build(nodes, 5), nodes.where("id = 1"), 5).orderBy("rank").collect()]
    assert got == [(1, 2, 3.0), (2, 3, 2.0)]
