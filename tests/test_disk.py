"""What a mixed corpus leaves on disk: shuffles of one step at a time, and nodes dealt out once."""

import time

import pytest
from pyspark.sql import functions as F

from loomspan.operators import ingest, python_code
from loomspan.sources import corpus, scratch
from tests.test_ingest import FILES

KEYS = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.shuffle.partitions")


def shuffle_files(spark) -> int:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))


def corpus_of(spark, files):
    rows = spark.createDataFrame(list(files.items()), "path string, text string")
    return corpus.files_from_texts(rows, F.lit("r"), F.col("path"), F.col("text"))


def exchanges(df) -> list[str]:
    return [x.split("Exchange ")[1] for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_shuffles_of_a_written_table_are_removed_and_the_session_keeps_its_settings(spark):
    before, settings = shuffle_files(spark), {k: spark.conf.get(k) for k in KEYS}
    made = scratch.written(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 3).alias("k")).count(), "disk")
    until = time.time() + 20
    while shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert sorted(r["count"] for r in made.collect()) == [333, 333, 334]
    assert {k: spark.conf.get(k) for k in KEYS} == settings


def test_a_shuffle_of_a_written_table_has_no_more_parts_than_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(scratch, "FINE_PARTS", 7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = scratch.written(spark.range(1000).groupBy((F.col("id") * 3).alias("k")).count(), "parts", shuffle_parts=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(made.inputFiles()) == 7 and made.count() == 1000


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_nodes_are_dealt_by_file_once(spark, no_broadcast):
    code = {k: v for k, v in FILES.items() if not k.endswith("ipynb")}
    found = exchanges(ingest.corpus_nodes(corpus_of(spark, code)))
    assert found and not any("node_id" in x for x in found)
    assert len(found) <= 5  # nodes, numbers of lines and texts; files and their errors


def test_ids_of_two_files_that_are_alike_stay_one_node(spark):
    made = ingest.corpus_nodes(corpus_of(spark, {"a.md": "# b.md::T\nx\n", "a.md::b.md": "# T\nx\n", "c:.md": "# U\n"})).collect()
    assert sorted(r.node_id for r in made) == ["doc::a.md::b.md::T::1-2", "doc::c:.md::U::1-1"]


def test_texts_are_lexed_where_they_lie(spark):
    files = corpus_of(spark, {"a.py": "x = '''a\n'''\ndef f(): pass\n", "b.py": "def g(\n", "c.py": "#\n" * 30_000})
    lex = python_code.lexed_texts(files)
    assert not exchanges(lex) and "Sort" not in lex._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, lex.collect())) == sorted(map(tuple, python_code.lexed(corpus.line_table(files)).collect()))


def test_cells_are_dealt_by_themselves_and_not_by_callers_and_blocks(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(ingest, "written", lambda df, what, *by, **kw: seen.setdefault(what, exchanges(df)) and None or scratch.written(df, what, *by, **kw))
    seen, key = {}, "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(key, "false")  # as while a table is written
    try:
        made = ingest.corpus_nodes(corpus_of(spark, {k: v for k, v in FILES.items() if k.endswith("ipynb")}))
        assert made.where("node_type = 'call_edge'").count() == 1
    finally:
        spark.conf.unset(key)
    assert "lines" not in seen and seen["cell-lines"] == []
    assert len(seen["cell-symbols"]) <= 2  # statements and broken cells
    found = seen["nodes-notebook"]
    assert len(found) <= 5  # symbols, names before brackets, comments; cells and their errors
    assert not any(word in x for x in found for word in ("caller", "block", "callee"))


def test_cells_keep_their_place_and_language(spark):
    book = '{"cells":[{"cell_type":"code","source":"x = 1"},{"cell_type":"code","metadata":{"language":"Lang\\\\u0000 7"},"source":"# a\\\\n"},{"cell_type":"code","source":"def f():\\\\n    g()"}]}'.replace("\\\\", "\\")
    rows = ingest.corpus_nodes(corpus_of(spark, {"a\0b/c.ipynb": book})).collect()
    of = {r.node_type: r for r in rows if r.node_type != "notebook_code"}
    assert {r.file_path for r in rows} == {"a\0b/c.ipynb"}
    assert (of["comment_line"].language, of["comment_line"].start_line, of["comment_line"].metadata) == ("lang\0 7", 3, {"cell_index": "1"})
    assert (of["function"].start_line, of["function"].end_line, of["function"].metadata["cell_index"]) == (5, 6, "2") and of["call_edge"].start_line == 6
