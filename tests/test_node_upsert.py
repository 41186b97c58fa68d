"""Upserts of nodes whose emission number stands for two rows of a file."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry


def _write(path, rows):
    key, line, part = zip(*rows)
    pq.write_table(pa.table({"l_orderkey": pa.array(key, pa.int64()), "l_linenumber": pa.array(line, pa.int32()), "l_partkey": pa.array(part, pa.int64()), "l_quantity": pa.array([3.0] * len(rows), pa.float64())}), path)


@pytest.mark.parametrize("turned", [False, True])
def test_an_emission_number_that_two_rows_share_names_the_first_row(spark, tmp_path, turned):
    # Line 1 of part 1,000,005 and line 2 of part 5 have one number. They lie in two files, of which Spark reads the longer one first.
    keys = range(7, 2000, 10)
    first, second = [(k, 1, 1_000_005 + k) for k in keys], [(k, 2, 5 + k) for k in keys]
    if turned:
        first, second = second, first
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    _write(folder / "part-0.parquet", first)
    _write(folder / "part-1.parquet", second + [(k, 1, k) for k in range(100_000, 140_000)])
    named = {f"f{k}#{line * 1_000_000 + part}": (part, f"line {line} of {k}", (line * 1_000_000 + part) % 3) for k, line, part in first}

    found = {r.node_id: r for r in entry.queries()["node_upsert"](spark, str(tmp_path)).collect()}
    assert len(found) == len(keys) + 40_000
    assert {i: (found[i].symbol, found[i].text) for i in named} == {i: (f"p{part}" + "n" * (m == 1), text + "!" * (m != 0)) for i, (part, text, m) in named.items()}
    found = {r.node_id: r.symbol for r in entry.queries()["replace_by_file"](spark, str(tmp_path)).where("length(node_id) < 14").collect() if r.node_id in named}
    assert found == {i: f"p{part}n" for i, (part, _, m) in named.items() if m != 0}
