"""Span operators against the sequential rule, on random and on hand-made files."""

import random

from pyspark.sql import functions as F

from loomspan.operators import code, documents, python_code, spans
from loomspan.sources import corpus


def table(spark, files):
    rows = [("r", f"f{i}", n, line) for i, lines in enumerate(files) for n, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "repo_name string, file_path string, line_no int, line string")


def as_files(spark, texts, ext=".md"):
    raw = spark.createDataFrame([("r", f"f{i}{ext}", t) for i, t in enumerate(texts)], "repo_name string, file_path string, text string")
    return corpus.files_from_texts(raw, F.col("repo_name"), F.col("file_path"), F.col("text"))


def block_end(lines, start, span):
    depth, open_ = 0, False
    limit = min(len(lines), start - 1 + span)
    for n in range(start, limit + 1):
        for ch in lines[n - 1]:
            if ch == "{":
                depth, open_ = depth + 1, True
            elif ch == "}" and open_:
                depth -= 1
                if depth == 0:
                    return n
    return limit if open_ else start


def test_brace_blocks_follow_the_sequential_rule(spark):
    rng = random.Random(5)
    files = [["".join(rng.choice("{} a") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    got = {(r.file_path, r.line_no): r.block_end for r in spans.brace_blocks(table(spark, files), 7).collect()}
    for i, lines in enumerate(files):
        for n in range(1, len(lines) + 1):
            assert got[f"f{i}", n] == block_end(lines, n, 7), (lines, n)


def test_statement_ends(spark):
    files = [["a", "b;", "c", "d"], ["x"]]
    got = [(r.file_path, r.line_no, r.statement_end) for r in spans.statement_ends(table(spark, files), 2).orderBy("file_path", "line_no").collect()]
    assert got == [("f0", 1, 2), ("f0", 2, 2), ("f0", 3, 4), ("f0", 4, 4), ("f1", 1, 1)]


def test_annotation_blocks_skip_to_the_nearest_run(spark):
    files = [["@a", "@b", "", "x", "def"], ["@far", "1", "2", "3", "4", "5", "6", "def"], ["def"]]
    rows = spans.annotation_blocks(table(spark, files), "@").where("line = 'def'").orderBy("file_path").collect()
    assert [(r.annotations, r.ann_start) for r in rows] == [(["@a", "@b"], 1), ([], 8), ([], 1)]


def chunk_rule(n, size, overlap):
    step = size - overlap if overlap < size else size
    out, at = [], 1
    while at <= n:
        out.append((at, min(at + size - 1, n)))
        if at + size - 1 >= n:
            break
        at += step
    if 0 < overlap < size and n - overlap + 1 > out[-1][0]:
        out.append((n - overlap + 1, n))
    return out


def test_chunk_ranges_follow_the_rule(spark):
    for size, overlap in ((5, 2), (4, 0), (3, 3), (10, 9)):
        rows = spark.range(1, 60).select("id", spans.chunk_ranges(F.lit(1), F.col("id").cast("int"), size, overlap).alias("c")).collect()
        for r in rows:
            assert [(x.a, x.b) for x in r.c] == chunk_rule(r.id, size, overlap), (r.id, size, overlap)


def test_comments_of_every_kind(spark):
    files = [["// a", " // b", "x", "/* c */ y", "/* d", "// inside", "e */", "// f"], ["/* never closed", "x"], ["x */ // y"]]
    got = sorted((r.file_path, r.kind, r.start_line, r.end_line) for r in spans.marked_comments(table(spark, files), "//").collect())
    assert got == [("f0", "block", 4, 4), ("f0", "block", 5, 7), ("f0", "line_block", 1, 2), ("f0", "line_block", 8, 8), ("f1", "block", 1, 2)]


def test_lines_of_odd_texts(spark):
    files = as_files(spark, ["", "a\n", "a\n\n", "a\r\nb", None, "x y"])
    got = {}
    for r in corpus.line_table(files).orderBy("file_path", "line_no").collect():
        got.setdefault(r.file_path, []).append(r.line)
    assert got == {"f1.md": ["a"], "f2.md": ["a", ""], "f3.md": ["a", "b"], "f5.md": ["x", "y"]}


def test_heading_paths_and_fences(spark):
    files = as_files(spark, ["# A\n## B\n### C\n## D ##\n# E\n```py\nx\n~~~\n```\n~~~\nrest"])
    lines = corpus.line_table(files)
    assert [r.section_path for r in documents.headings(lines).orderBy("line_no").collect()] == ["A", "A > B", "A > B > C", "A > D", "E"]
    got = [(r.start_line, r.end_line, r.code_language, r.fence_closed) for r in documents.fences(lines).orderBy("start_line").collect()]
    assert got == [(6, 9, "py", True), (10, 11, "text", False)]


def test_callees_are_capped_and_recursion_is_skipped(spark):
    body = ["func F(x int) {", *[f"  c{i}(x); F(x)" for i in range(30)], "}"]
    edges = code.extract(table(spark, [body]), "go").where("node_type = 'call_edge'").collect()
    assert len(edges) == 24 and not any(e.symbol.endswith("->F") for e in edges)


def test_python_bodies_by_indentation(spark):
    lines = ["class A:", "    def f(self):", "        g(1)", "", "        h.i(2)", "    x = 1", "def k():", "    f()"]
    got = {(r.symbol, r.start_line, r.end_line) for r in python_code.python_symbols(table(spark, [lines])).collect()}
    assert got == {("A", 1, 6), ("f", 2, 5), ("k", 7, 8)}
    calls = {(r.caller, r.callee) for r in python_code.python_calls(table(spark, [lines])).collect()}
    assert calls == {("A.f", "g"), ("A.f", "h.i"), ("k", "f")}


def test_json_segments(spark):
    from loomspan.functions.text import json_segment

    texts = ['{"a": 1}', 'say {"a": "}", "b": {"c": "\\"{"}} end', "none", "open { only", ""]
    got = [r.j for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", json_segment(F.col("t")).alias("j")).orderBy("i").collect()]
    assert got == [texts[0], '{"a": "}", "b": {"c": "\\"{"}}', None, None, None]


def test_go_import_blocks_and_js_object_routes(spark):
    go = ["import (", '  "a"', '  b "c/d"', ")", '"not"', 'import x "y"']
    got = {(r.symbol, r.kind) for r in code.extract(table(spark, [go]), "go").where("node_type = 'import_usage'").collect()}
    assert got == {("a", "import_block"), ("c/d", "import_block"), ("y", "import_single")}
    js = ["const routes = [", "  { path: '/a' },", "]"], ["x = { path: '/b' }"]
    assert {r.symbol for r in code.extract(table(spark, list(js)), "javascript").where("node_type = 'route'").collect()} == {"/a"}
