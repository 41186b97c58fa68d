"""A mixed corpus of small files to one node table: exactly these nodes."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import ingest
from loomspan.sources import corpus

FILES = {
    "a.py": "import os\n\ndef f():\n    '''doc'''\n    g(1)\n",
    "bad.py": "def f(:\n    g((1)\n# note\n",
    "b.go": "package b\nfunc main() {\n  run()\n}\n",
    "c.md": "intro\n\n# Top\ntext\n```py\nx\n```\n## Sub\n~~~\ny\n",
    "plain.md": "no heading\n",
    "d.txt": "hello\r\nworld\r\n",
    "e.yml": "a: 1\n",
    "f.xyz": "what\nis this\n" + "x" * 9000,
    "g.ipynb": '{"cells":[{"cell_type":"markdown","source":["# T\\n","t"]},{"cell_type":"code","execution_count":3,"source":"# c\\ndef h(x):\\n    f(x)\\n    return 1"},{"cell_type":"code","source":"%magic\\ndef no(): pass"},{"cell_type":"raw","source":""},{"cell_type":"code","metadata":{"language":"R"},"source":"# r\\ng <- 1"}],"metadata":{}}',
    "h.ipynb": "no json",
    "i.ipynb": "[1]",
    "j.ipynb": "{}",
    "q.sql": "create view v as\nselect * from t;\n",
    "p.cob": "       PROGRAM-ID. PAY.\n",
}


@pytest.fixture(scope="module")
def rows(spark):
    files = corpus.files_from_texts(spark.createDataFrame(list(FILES.items()), "path string, text string"), F.lit("r"), F.col("path"), F.col("text"))
    return ingest.corpus_nodes(files).collect()


def test_every_file_has_exactly_its_nodes(rows):
    got = sorted(((r.file_path, r.node_type, r.symbol, r.start_line, r.end_line, round(r.confidence, 2), r.kind, r.language) for r in rows), key=str)
    assert got == sorted([
        ("a.py", "file", None, 1, 5, 1.0, "", "python"), ("a.py", "function", "f", 3, 5, 1.0, "", "python"), ("a.py", "import_usage", "os", 1, 1, 0.8, "import", "python"),
        ("a.py", "call_edge", "f->g", 5, 5, 0.84, "calls", "python"), ("a.py", "comment_doc", None, 4, 4, 0.78, "docstring", "python"),
        ("bad.py", "file", None, 1, 3, 0.2, "", "python"), ("bad.py", "comment_line", None, 3, 3, 0.78, "line_block", "python"),
        ("b.go", "file", None, 1, 4, 1.0, "", "go"), ("b.go", "function", "main", 2, 4, 0.88, "", "go"), ("b.go", "entrypoint", "main", 2, 2, 0.9, "go_main", "go"), ("b.go", "call_edge", "main->run", 3, 3, 0.72, "calls", "go"),
        ("c.md", "doc", "Preamble", 1, 2, 0.92, "", "markdown"), ("c.md", "doc", "Top", 3, 7, 0.92, "", "markdown"), ("c.md", "doc_code", "py", 5, 7, 0.9, "", "markdown"),
        ("c.md", "doc", "Sub", 8, 10, 0.92, "", "markdown"), ("c.md", "doc_code", "text", 9, 10, 0.86, "", "markdown"), ("plain.md", "doc", "Document", 1, 1, 0.92, "", "markdown"),
        ("d.txt", "doc", None, 1, 2, 0.9, "", "text"), ("e.yml", "config", None, 1, 1, 0.85, "", "config"), ("f.xyz", "file", None, 1, 3, 0.4, "", "unknown"),
        ("g.ipynb", "file", None, 1, 15, 0.92, "", "notebook"), ("g.ipynb", "doc", "cell_0", 1, 2, 0.9, "", "markdown"), ("g.ipynb", "notebook_code", "cell_1", 4, 7, 0.88, "", "python"),
        ("g.ipynb", "comment_line", None, 4, 4, 0.78, "line_block", "python"), ("g.ipynb", "function", "h", 5, 7, 0.95, "", "python"), ("g.ipynb", "call_edge", "h->f", 6, 6, 0.8, "calls", "python"),
        ("g.ipynb", "notebook_code", "cell_2", 9, 10, 0.78, "", "python"), ("g.ipynb", "notebook_code", "cell_4", 14, 15, 0.88, "", "r"), ("g.ipynb", "comment_line", None, 14, 14, 0.78, "line_block", "r"),
        ("h.ipynb", "file", None, 1, 1, 0.2, "", "notebook"), ("i.ipynb", "file", None, 1, 1, 0.2, "", "notebook"), ("j.ipynb", "file", None, 1, 1, 0.7, "", "notebook"),
        ("q.sql", "file", None, 1, 2, 1.0, "", "sql"), ("q.sql", "view", "v", 1, 2, 0.9, "create_view", "sql"), ("q.sql", "query", "SELECT@2", 2, 2, 0.82, "SELECT", "sql"), ("q.sql", "call_edge", "query@2->t", 2, 2, 0.74, "references", "sql"),
        ("p.cob", "file", None, 1, 1, 1.0, "", "cobol"), ("p.cob", "class", "PAY", 1, 1, 0.84, "program", "cobol"),
    ], key=str)
    assert len({(r.repo_name, r.node_id) for r in rows}) == len(rows)


def test_texts_ids_and_metadata(rows):
    of = {(r.file_path, r.node_type, r.symbol): r for r in rows}
    assert of["c.md", "doc_code", "text"].metadata["section_path"] == "Top > Sub" and of["c.md", "doc_code", "text"].metadata["fence_closed"] == "false"
    assert of["d.txt", "doc", None].text == "hello\nworld" and of["d.txt", "doc", None].node_id == "doc::d.txt::1-2" and of["d.txt", "doc", None].metadata == {}
    assert of["g.ipynb", "notebook_code", "cell_1"].text == "# c\ndef h(x):\n    f(x)\n    return 1" and of["g.ipynb", "notebook_code", "cell_1"].metadata == {"cell_type": "code", "cell_index": "1", "execution_count": "3", "code_language": "python"}
    assert of["g.ipynb", "notebook_code", "cell_2"].metadata["parse_error"] == "syntax" and of["g.ipynb", "function", "h"].metadata == {"cell_index": "1", "source": "ipynb"}
    assert of["g.ipynb", "file", None].metadata == {"notebook_cells": "5", "notebook_language": "python"}
    assert [of[f"{x}.ipynb", "file", None].metadata.get("parse_error") for x in "hij"] == ["invalid_ipynb", "invalid_ipynb_root", None]
    assert of["bad.py", "file", None].metadata["parse_error"] == "syntax" and of["a.py", "comment_doc", None].metadata == {"owner": "function:f"} and of["a.py", "import_usage", "os"].metadata == {"alias": ""}
    assert len(of["f.xyz", "file", None].text) == 8000 and of["f.xyz", "file", None].metadata == {"note": "no deterministic parser"}


def test_an_empty_corpus_has_no_node(spark):
    files = corpus.files_from_texts(spark.createDataFrame([], "path string, text string"), F.lit("r"), F.col("path"), F.col("text"))
    assert ingest.corpus_nodes(files).count() == 0
