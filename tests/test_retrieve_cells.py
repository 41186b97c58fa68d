"""Cell-probe retrieval against a brute-force search over the same queries."""

import duckdb
import numpy as np
import pytest

from loomspan.plans import registry


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_cells(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{d}/embeddings.parquet' ORDER BY vec_id").df()
    ids, v = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    got = {}
    for r in registry.QUERIES["retrieve_cells"](spark, d).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.node_id
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    found = 0
    for q, of in got.items():
        assert sorted(of) == list(range(1, 11))
        near = np.argsort(((v - v[ids == q]) ** 2).sum(1), kind="stable")[:10]
        found += len(set(of.values()) & {f"n{ids[i]}" for i in near})
    assert found / (10 * len(got)) >= 0.99
