"""Lines are numbered once, rules run once over them, and blocks meet lines without a join."""

from loomspan.operators import code, python_code, spans
from loomspan.plans import code_queries

LINES = "repo_name string, file_path string, line_no int, line string"


def test_queries_read_numbered_lines_and_not_the_table_again(spark):
    for made in (code_queries.lines_of(spark, "/root/testdata/sf0.001", "go"), code_queries._python_extra(spark, "/root/testdata/sf0.001")):
        assert made.inputFiles() and not any("orders.parquet" in f for f in made.inputFiles())


def test_rules_run_once_for_nodes_and_scopes(spark):
    lines = spark.createDataFrame([("r", "f", 1, "func F(x int) {"), ("r", "f", 2, " g(x)"), ("r", "f", 3, "}")], LINES)
    made = code.extract(lines, "go")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "import" not in plan and plan.count("regexp_extract_all") == 1  # call tokens only
    assert {(r.node_type, r.symbol, r.start_line, r.end_line) for r in made.collect()} == {("function", "F", 1, 3), ("call_edge", "F->g", 2, 2)}


def test_blocks_meet_lines_without_a_join(spark):
    texts = ["a", "{ b", "} {", "}", "c", "{ { }", "d"]
    lines = spark.createDataFrame([("r", f, i, x) for f in "fg" for i, x in enumerate(texts, 1)], LINES)
    made = spans.brace_blocks(lines)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.columns == [*lines.columns, "block_end"]
    assert sorted((r.file_path, r.line_no, r.block_end) for r in made.collect()) == [(f, i, e) for f in "fg" for i, e in ((1, 3), (2, 3), (3, 4), (4, 7), (5, 7), (6, 7), (7, 7))]


def test_python_lines_are_lexed_once_for_symbols_and_calls(spark):
    lines = spark.createDataFrame([("r", "f", 1, "def F(x):"), ("r", "f", 2, "    g(x)")], LINES)
    made = python_code.python_calls(lines)
    assert "MapInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in made.collect()] == [("r", "f", "F", "g", 2)]
