"""A task's share of Python lines does not grow with the table, and it is sorted once between two shuffles."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import python_code
from loomspan.plans import code_queries
from loomspan.sources import scratch

SF = "/root/testdata/sf0.001"
KEY = "spark.sql.shuffle.partitions"


@pytest.mark.parametrize("run", [python_code.python_docstrings, python_code.python_symbols])
def test_lines_are_sorted_once_to_lex_them_and_once_for_statements(spark, run):
    plan = run(code_queries._python_extra(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    shuffled = plan.split("Exchange hashpartitioning")
    assert shuffled[1].count("Sort [") == 1 and shuffled[1].count("MapInArrow") == 1  # between the shuffles
    assert shuffled[0].split("SortAggregate")[-1].count("Sort [") == 1


def test_parts_grow_with_the_lines(spark, monkeypatch):
    lines = code_queries._python_extra(spark, SF)
    want = sorted(map(tuple, python_code.python_docstrings(lines).collect()))
    size = scratch.parts(lines)
    monkeypatch.setattr(scratch, "PART_BYTES", 512)
    assert size == 1 and scratch.parts(lines) > 20
    twice = lines.unionByName(lines.withColumn("file_path", F.concat("file_path", F.lit("x"))))
    assert abs(scratch.parts(twice) - 2 * scratch.parts(lines)) <= 1
    for df in (python_code.lexed(lines), python_code.statements(python_code.lexed(lines)), python_code.docstrings_of(python_code.statements(python_code.lexed(lines)))):
        assert df.rdd.getNumPartitions() == scratch.parts(lines)
    assert sorted(map(tuple, python_code.python_docstrings(lines).collect())) == want


def test_unsized_rows_keep_the_number_of_the_session(spark):
    rows = spark.createDataFrame(spark.sparkContext.parallelize([("r", "f", 1, "x")]), "repo_name string, file_path string, line_no int, line string")
    assert scratch.parts(rows) == 1
    assert scratch.parts(rows.crossJoin(spark.range(10**6).toDF("k"))) < 10


def test_lines_are_numbered_in_more_parts_and_the_session_keeps_its_number(spark, monkeypatch):
    monkeypatch.setattr(scratch, "PART_BYTES", 4096)
    before, seen = spark.conf.get(KEY), []
    monkeypatch.setattr(code_queries, "written", lambda df, what, **kw: seen.append(kw["shuffle_parts"]) or scratch.written(df, what, **kw))
    lines = code_queries.lines_of(spark, SF, "python")
    assert seen[0] > int(before) == int(spark.conf.get(KEY))
    assert lines.count() == lines.select("file_path", "line_no").distinct().count()
    with pytest.raises(Exception):  # noqa: B017, PT011  the write fails
        scratch.written(spark.range(1).select(F.raise_error(F.lit("no"))), "fails", shuffle_parts=50)
    assert spark.conf.get(KEY) == before
