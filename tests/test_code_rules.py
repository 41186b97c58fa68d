"""Small source files with the constructs that the generated corpora lack."""

import pytest

from loomspan.operators import code, python_code
from loomspan.sources import corpus
from pyspark.sql import functions as F


def found(spark, language, text):
    files = corpus.files_from_texts(spark.createDataFrame([(text,)], "text string"), F.lit("r"), F.lit(f"f.{language}"), F.col("text"))
    rows = code.extract(corpus.line_table(files), language).collect()
    return [(r.node_type, r.symbol, r.start_line, r.end_line, round(r.confidence, 2), r.kind, dict(r.metadata)) for r in rows]


def short(nodes, *types):
    return sorted((n[:4] for n in nodes if n[0] in types), key=str)


def test_javascript_requires_decorators_and_main(spark):
    nodes = found(spark, "javascript", "const a = require('x'), b = require('y')\n@Component({})\nclass A {\n}\nfunction Main() {\n}\n")
    assert short(nodes, "import_usage") == [("import_usage", "x", 1, 1), ("import_usage", "y", 1, 1)]
    assert short(nodes, "class") == [("class", "A", 2, 4)]
    assert short(nodes, "entrypoint") == [("entrypoint", "Main", 5, 5)]
    assert [n[6] for n in nodes if n[0] == "class"] == [{"decorators": "@Component({})", "framework": "angular"}]


def test_app_objects_are_entrypoints(spark):
    assert short(found(spark, "kotlin", "object Boot : App {\n}\nclass C : App\n"), "entrypoint") == [("entrypoint", "Boot", 1, 1)]
    nodes = found(spark, "scala", "object Boot extends App {\n}\nclass C extends App\n")
    assert short(nodes, "entrypoint") == [("entrypoint", "Boot", 1, 1)]
    assert sorted(n[6]["scala_kind"] for n in nodes if n[0] == "class") == ["class", "object"]


def test_cpp_declarations_and_qualified_main(spark):
    nodes = found(spark, "cpp", "int f(int x);\nint X::main(int a) {\n  f(a);\n}\n")
    assert sorted((n[1], n[4], n[6]["declaration"]) for n in nodes if n[0] == "function") == [("X::main", 0.8, "false"), ("f", 0.65, "true")]
    assert short(nodes, "entrypoint") == [("entrypoint", "X::main", 2, 2)]


def test_main_keeps_its_case_outside_javascript(spark):
    assert short(found(spark, "go", "func Main() {\n}\n"), "entrypoint") == []
    assert short(found(spark, "go", "func main() {\n}\n"), "entrypoint") == [("entrypoint", "main", 1, 1)]


def test_spring_annotations(spark):
    nodes = found(spark, "kotlin", "@RestController\nclass C {\n  @GetMapping(\"/p\")\n  fun g() {\n  }\n}\n")
    assert short(nodes, "class", "function", "route") == [("class", "C", 1, 6), ("function", "g", 3, 5), ("route", "g:/p", 3, 5)]
    assert [n[6] for n in nodes if n[0] == "class"] == [{"annotations": "@RestController", "framework": "spring-boot", "kotlin_kind": "class"}]


def test_block_comments_and_earlier_rule_wins(spark):
    nodes = found(spark, "java", "/* a\n b */\nclass A {\n  // x\n  // y\n}\n")
    assert short(nodes, "comment_block", "comment_line") == [("comment_block", None, 1, 2), ("comment_line", None, 4, 5)]


def test_python_bodies_by_indentation(spark):
    text = "class A:\n    def f(self):\n        if x:\n            g()\n\n    def h(self):\n        k(1)\nz()\ndef m():\n    pass\n"
    files = corpus.files_from_texts(spark.createDataFrame([(text,)], "text string"), F.lit("r"), F.lit("f.py"), F.col("text"))
    got = {r.symbol: (r.node_type, r.start_line, r.end_line) for r in python_code.python_symbols(corpus.line_table(files)).collect()}
    assert got == {"A": ("class", 1, 7), "f": ("function", 2, 4), "h": ("function", 6, 7), "m": ("function", 9, 10)}


@pytest.mark.parametrize("text, nodes", [
    ("CREATE PROCEDURE `p1`\nselect * from \"t1\";\ncreate table [t2] (a int);\n", [("function", "p1"), ("table", "t2")]),
])
def test_sql_routines_and_quoted_names(spark, text, nodes):
    files = corpus.files_from_texts(spark.createDataFrame([(text,)], "text string"), F.lit("r"), F.lit("f.sql"), F.col("text"))
    rows = code.sql_lineage(corpus.line_table(files)).collect()
    assert sorted((r.node_type, r.symbol) for r in rows if r.node_type in ("table", "function")) == nodes
    assert ("call_edge", "p1->t1") in {(r.node_type, r.symbol) for r in rows}


def test_cobol_programs_and_sections(spark):
    text = "       PROGRAM-ID. PAY.\n       MAIN SECTION.\n       P1.\n           CALL 'SUB'\n"
    files = corpus.files_from_texts(spark.createDataFrame([(text,)], "text string"), F.lit("r"), F.lit("f.cob"), F.col("text"))
    rows = {(r.node_type, r.symbol, r.kind) for r in code.cobol(corpus.line_table(files)).collect()}
    assert rows >= {("class", "PAY", "program"), ("function", "MAIN", "section"), ("function", "P1", "paragraph"), ("call_edge", "P1->SUB", "calls")}
