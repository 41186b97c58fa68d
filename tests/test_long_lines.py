"""Lines of 400,000 characters in every language: no stack overflow, time in proportion, and headers on short lines as ever."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from loomspan.operators import code, documents, ingest, spans
from loomspan.sources import corpus

N = 400_000


def long_lines():
    rep = lambda unit: (unit * (N // len(unit) + 1))[:N]
    return [
        rep("word "), rep("public "), rep("final "), rep("static new "), rep("template <a> "), rep(" "), rep("\t "), rep("("), rep("{}"), rep('"'), rep("'a' "), rep("a.b.c "), rep("<T, "), rep("x"), rep("é"),
        "int f(" + rep("a, ") + ") {", "import " + rep(" ") + "!", "# " + rep("#") + "b", "# a" + rep(" ") + "b", "from " + rep(".") + " x", rep("sealed case ") + "class A {", "x = 1" + rep(" ") + "y", "/* " + rep("*") + " */",
    ]


def table(spark, lines, path="f.x"):
    return corpus.line_table(corpus.files_from_texts(spark.createDataFrame([("\n".join(lines),)], "text string"), F.lit("r"), F.lit(path), F.col("text")))


@pytest.fixture(scope="module")
def lines(spark):
    return table(spark, long_lines()).cache()


@pytest.mark.parametrize("language", [*sorted(set(code.LANGUAGES) - {"typescript"}), "sql", "cobol", "python"])
def test_every_language_ends(spark, lines, language):
    began = time.monotonic()
    ingest.EXTRACTORS[language](lines).write.format("noop").mode("overwrite").save()
    assert time.monotonic() - began < 60


def test_documents_and_notebooks_end(spark, lines):
    began = time.monotonic()
    documents.headings(lines).unionByName(documents.headings(lines)).write.format("noop").mode("overwrite").save()
    documents.fences(lines).write.format("noop").mode("overwrite").save()
    text = json.dumps({"cells": [{"cell_type": "code", "source": "\\\"a" * 1_000_000}, {"cell_type": "markdown", "source": ["x" * N, "\\" * N]}], "metadata": {}})
    nb = spark.createDataFrame([(text,)], "text string").select(F.lit("r").alias("repo_name"), F.lit("n.ipynb").alias("file_path"), "text")
    assert [len(r.source) for r in code.notebook_cells(nb).orderBy("cell_index").collect()] == [3_000_000, 2 * N]
    assert time.monotonic() - began < 60


# What headers look like, as plain patterns that give back what they took.
_MODS = "public|private|protected|internal|static|virtual|override|async|sealed|new|partial"
PLAIN = {
    "java": r"^\s*(?:public|protected|private)?\s*(?:static\s+)?(?:final\s+)?(?:synchronized\s+)?(?:<[^>]+>\s*)?[\w\[\]<>?,\s]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:throws\s+[^{]+)?\{",
    "csharp": rf"^\s*(?:(?:{_MODS})\s+)+[\w<>,\[\]\.\?]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:where\s+[^{{]+)?\{{",
    "cpp": r"^\s*(?:template\s*<[^>]+>\s*)?(?:(?:inline|constexpr|static|virtual|friend|extern)\s+)*(?:[\w:<>~*&]+\s+)+([A-Za-z_~]\w*(?:::[A-Za-z_~]\w*)?)\s*\([^;{}]*\)\s*(?:const)?\s*(?:noexcept)?\s*(?:override)?\s*(?:final)?\s*(\{|;)",
    "kotlin": r"^\s*(?:(?:public|private|protected|internal|open|abstract|final|suspend|inline|tailrec|operator|infix|external|override)\s+)*fun\s+([A-Za-z_]\w*)\s*\(",
    "scala": r"^\s*(?:override\s+|private\s+|protected\s+|implicit\s+|final\s+)*def\s+([A-Za-z_]\w*)\b",
}
PARTS = ["public", "static", "new", "template <class T>", "<T>", "int", "List<String>", "X::f", "f", "g ", "final", "override", "fun", "def", "~A", "a.b", "(int x)", "(", "()", ") {", " {", ";", " const", " noexcept {", " throws E {", " where T : U {", "\t", "é", "*", "synchronized", "a[]", "@"]


def test_headers_are_those_of_the_plain_patterns(spark):
    """Random short lines, against the patterns in a matcher without a stack limit."""
    import random

    pick = random.Random(11)
    headers = ["public", "static", "new", "override", "List<int>", "int", "f", "g ", "(int x)", "()", "( a, b )", " {", " where T : U {", " throws E {", "<T>", "partial"]
    texts = list({pick.choice(["", " "]) + " ".join(pick.choices(headers, k=pick.randrange(2, 7))) + pick.choice(["", "(x) {", " {"]) for _ in range(20000)} | {pick.choice(["", " ", "  "]) + pick.choice([" ", " ", ""]).join(pick.choices(PARTS, k=pick.randrange(1, 8))) for _ in range(30000)})
    df = spark.createDataFrame([(t,) for t in texts], "line string").coalesce(4)
    for language, plain in PLAIN.items():
        pattern, group = code.LANGUAGES[language].functions[0]
        got = {r[0]: r[1] for r in df.select("line", F.regexp_extract("line", "(?U)" + pattern, group)).collect()}
        wrong = [(t, got[t], m and m[1]) for t in texts if (got[t] or None) != ((m := re.match(plain, t)) and m[1])]
        assert not wrong, (language, wrong[:5])
        assert sum(map(bool, got.values())) > 20, language


def brute_comments(lines, marker):
    """Line by line, as a reader would."""
    out, i, n = [], 0, len(lines)
    while i < n:
        text = lines[i]
        if text.strip().startswith(marker):
            j = i
            while j + 1 < n and lines[j + 1].strip().startswith(marker):
                j += 1
            out.append(("line_block", i + 1, j + 1))
            i = j + 1
        elif "/*" in text:
            j = i
            if "*/" not in text[text.index("/*") + 2 :]:
                j = i + 1
                while j < n and "*/" not in lines[j]:
                    j += 1
                j = min(j, n - 1)
            out.append(("block", i + 1, j + 1))
            i = j + 1
        else:
            i += 1
    return sorted(out)


def test_comments_of_random_files(spark):
    import random

    pick = random.Random(4)
    files = [[pick.choice(["// a", "x", "/* b */", "/* c", "d */", "*/ /*", "e */ f /* g", "// h /*", "/*/", "", "  // i */"]) for _ in range(pick.randrange(1, 14))] for _ in range(300)]
    df = spark.createDataFrame([("r", str(i), k + 1, x) for i, f in enumerate(files) for k, x in enumerate(f)], "repo_name string, file_path string, line_no int, line string")
    got = {}
    for r in spans.marked_comments(df, "//").collect():
        got.setdefault(int(r.file_path), []).append((r.kind, r.start_line, r.end_line))
    for i, f in enumerate(files):
        assert sorted(got.get(i, [])) == brute_comments(f, "//"), f


def test_many_comments_in_one_file(spark):
    rows = spark.range(100_000).select(F.lit("r").alias("repo_name"), F.lit("f").alias("file_path"), (F.col("id") + 1).cast("int").alias("line_no"), F.when(F.col("id") % 3 == 0, "/* a").when(F.col("id") % 3 == 1, "b */").otherwise("// c").alias("line"))
    began = time.monotonic()
    assert spans.marked_comments(rows, "//").groupBy("kind").count().orderBy("kind").collect() == [("block", 33_333 + 1), ("line_block", 33_333)]
    assert time.monotonic() - began < 30
