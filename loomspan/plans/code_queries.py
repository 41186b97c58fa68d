"""Queries over source files built from orders: one file a customer, one function an order.

The SQL side does not parse: it derives each expected node from how the files are built.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import code, graph, ingest, python_code, spans
from loomspan.plans import corpus_queries
from loomspan.plans import fixtures as X
from loomspan.sources import corpus
from loomspan.sources.scratch import parts, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FILE = ["repo_name", "file_path"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def lines_of(spark: SparkSession, d: str, language: str) -> DataFrame:
    """Lines of a language's files, written once: numbering them takes a sort, and operators read them several times."""
    return _numbered(X.spark_sql(spark, d, X.code_lines(language)))


def _numbered(lines: DataFrame) -> DataFrame:
    return written(lines.select(*FILE, "line_no", "line"), "lines", shuffle_parts=parts(lines))


def _base(language: str, only: str = "") -> str:
    """Common SQL over the files that ``only`` leaves: L (all lines), S (functions with header, end and the start after annotations), T (call tokens)."""
    moves = language in ("java", "kotlin", "csharp")
    tokens = ["SELECT repo_name, file_path, line_no, 0 AS pos, 'g' || o_custkey AS callee FROM l WHERE part = 4", "SELECT repo_name, file_path, line_no, 1, 'h' || k % 50 FROM l WHERE part = 4"]
    if language != "r":
        tokens.append("SELECT repo_name, file_path, line_no, 0, 'F' || k FROM l WHERE part = 2")
    extra = {"java": "'GetMapping'", "kotlin": "'PostMapping'", "csharp": "'HttpGet'", "go": "'r.GET'"}.get(language)
    if extra:
        tokens.append(f"SELECT repo_name, file_path, line_no, 0, {extra} FROM l WHERE part = 1")
    if language == "r":
        tokens.append("SELECT repo_name, file_path, line_no, 0, 'library' FROM l WHERE part = 0")
    start = "coalesce(max(ann['n']) FILTER (part = 2), max(line_no) FILTER (part = 2))" if moves else "max(line_no) FILTER (part = 2)"
    nearest = "max(CASE WHEN part = 1 THEN {'n': line_no, 'line': line} END) OVER (PARTITION BY o_custkey ORDER BY line_no ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"
    return f"""WITH l AS MATERIALIZED (SELECT * FROM ({X.duck(X.code_lines(language))}) {only}),
s AS MATERIALIZED (SELECT repo_name, file_path, o_custkey, k, max(line_no) FILTER (part = 2) AS header, {start} AS start_line, max(line_no) FILTER (part = 5) AS end_line, max(ann['line']) FILTER (part = 2) AS ann
  FROM (SELECT *, {nearest} AS ann FROM l) GROUP BY ALL),
t AS ({' UNION ALL '.join(tokens)}),
x AS (SELECT s.repo_name, s.file_path, s.k, 'F' || s.k AS caller, t.callee, min(t.line_no * 10 + t.pos) AS place FROM s JOIN t ON t.file_path = s.file_path AND t.line_no > s.start_line AND t.line_no <= s.end_line AND t.callee <> 'F' || s.k GROUP BY ALL),
edges AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY file_path, k ORDER BY place) <= 24)
"""


def _nodes_sql(language: str, only: str = "") -> str:
    conf = code.LANGUAGES[language]
    kinds = {language_kind[1] for language_kind in conf.imports}
    kind = "import_from" if "import_from" in kinds else sorted(kinds)[0]
    module = {"go": "'m' || k % 10", "cpp": "'m' || k % 10", "javascript": "'m' || k % 10", "r": "'m' || k % 10", "csharp": "'M' || k % 10"}.get(language, "'m.M' || k % 10")
    parts = [
        f"SELECT repo_name, file_path, 'function' AS node_type, 'F' || k AS symbol, start_line, end_line, {conf.function_confidence} AS confidence, '' AS kind FROM s",
        f"SELECT repo_name, file_path, 'import_usage', {module}, line_no, line_no, {dict((k, c) for _, k, c in conf.imports)[kind]}, '{kind}' FROM l WHERE part = 0",
        "SELECT repo_name, file_path, 'comment_line', NULL, line_no, line_no, 0.78, 'line_block' FROM l WHERE part = 3",
        "SELECT repo_name, file_path, 'call_edge', caller || '->' || callee, place // 10, place // 10, 0.72, 'calls' FROM edges",
    ]
    if language == "go":
        parts.append("SELECT repo_name, file_path, 'route', 'GET:/p' || k, line_no, line_no, 0.8, '' FROM l WHERE part = 1")
    if language == "javascript":
        parts.append("SELECT repo_name, file_path, 'route', '/p' || k, line_no, line_no, 0.8, '' FROM l WHERE part = 1")
    if language in ("java", "kotlin", "csharp"):
        parts.append("SELECT s.repo_name, s.file_path, 'route', 'F' || s.k || ':/p' || a.k, s.start_line, s.end_line, 0.88, '' FROM s JOIN l a ON a.file_path = s.file_path AND a.line_no = s.start_line AND a.part = 1")
    return _base(language, only) + "SELECT DISTINCT repo_name, file_path, node_type, symbol, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, CAST(confidence AS DOUBLE) AS confidence, kind FROM (" + " UNION ALL ".join(parts) + ")"


def _register(language: str, name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return code.extract(lines_of(spark, d, language), language).drop("language", "metadata")

    QUERIES[name] = run
    ORACLES[name] = _nodes_sql(language)


for _language, _name in (("javascript", "js_nodes"), ("java", "java_nodes"), ("kotlin", "kotlin_nodes"), ("go", "go_nodes"), ("csharp", "csharp_nodes"), ("cpp", "cpp_nodes"), ("scala", "scala_nodes"), ("r", "r_nodes")):
    _register(_language, _name)


#: In a mixed corpus each customer writes one language, or plain text of which nothing is known.
MIXED = ("go", "java", "javascript", "r", "python", "sql", "cobol", "unknown")


def _own_nodes_sql(language: str, only: str) -> str:
    """Nodes of the languages whose scopes are no brace blocks."""
    row = lambda node_type, symbol, confidence, kind, where, stop="line_no": f"SELECT repo_name, file_path, '{node_type}' AS node_type, {symbol} AS symbol, line_no AS start_line, {stop} AS end_line, {confidence} AS confidence, '{kind}' AS kind FROM e WHERE {where}"
    rows = [row("comment_line", "NULL", 0.78, "line_block", "part = 3")]
    if language == "python":
        rows += ["SELECT repo_name, file_path, 'function', 'F' || k, header, end_line, 1.0, '' FROM s", row("import_usage", "'m' || k % 10", 0.8, "import", "part = 0")]
        rows += [row("call_edge", f"'F' || k || '->{x}", 0.84, "calls", "part = 4") for x in ("g' || o_custkey", "h' || k % 50")]
    if language == "sql":
        rows += [row("view", "'v' || k", 0.9, "create_view", "part = 2", "stop"), row("query", "'UPDATE@' || line_no", 0.82, "UPDATE", "part = 0", "stop"), row("query", "'SELECT@' || line_no", 0.82, "SELECT", "part = 4", "stop")]
        rows += [row("call_edge", f"'query@' || line_no || '->{x}", 0.74, "references", f"part = {p}") for x, p in (("s' || k % 10", 0), ("g' || o_custkey", 4), ("h' || k % 50", 4))]
    if language == "cobol":
        rows += [row("function", "'P' || k", 0.72, "paragraph", "part = 2", "line_no + 1"), row("call_edge", "'P' || k || '->G' || o_custkey", 0.76, "calls", "part = 4")]
    ends = "e AS (SELECT *, min(CASE WHEN contains(line, ';') THEN line_no END) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 399 FOLLOWING) AS stop FROM l)"
    return _base(language, only).rstrip() + ", " + ends + " SELECT DISTINCT repo_name, file_path, node_type, symbol, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, CAST(confidence AS DOUBLE) AS confidence, kind FROM (" + " UNION ALL ".join(rows) + ")"


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    # A customer's lines are numbered and joined where they lie: files are grouped with their customer.
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    parts = [X.spark_sql(spark, d, X.code_lines("go" if lang == "unknown" else lang)).where(F.col("o_custkey") % len(MIXED) == i).groupBy("o_custkey", *FILE).agg(joined.alias("text")).withColumn("file_path", F.regexp_replace("file_path", "go$", "zz") if lang == "unknown" else F.col("file_path")) for i, lang in enumerate(MIXED)]
    lines = reduce(DataFrame.unionByName, parts)
    made = corpus.files_from_texts(lines, F.col("repo_name"), F.col("file_path"), F.col("text"))
    # Each document is a plain text or a configuration.
    docs = X.spark_sql(spark, d, X.FILES.format(ext=".txt")).withColumn("file_path", F.when(F.length("text") % 2 == 0, F.regexp_replace("file_path", "txt$", "yml")).otherwise(F.col("file_path")))
    return made.unionByName(corpus.files_from_texts(docs, F.col("repo_name"), F.col("file_path"), F.col("text")))


@query
def corpus_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Files of several languages, texts and configurations to one node table, with text, id and hash."""
    made = ingest.corpus_nodes(_mixed(spark, d))
    return made.select("repo_name", "file_path", "node_id", "node_type", F.coalesce("symbol", F.lit("")).alias("symbol"), "start_line", "end_line", "language", "confidence", "kind", "content_hash")


def _mixed_sql() -> str:
    known = [(i, lang) for i, lang in enumerate(MIXED) if lang != "unknown"]
    only = lambda i: f"WHERE o_custkey % {len(MIXED)} = {i}"
    of = [f"SELECT *, '{lang}' AS language FROM ({_own_nodes_sql(lang, only(i)) if lang in ('python', 'sql', 'cobol') else _nodes_sql(lang, only(i))}) n{i}" for i, lang in known]
    path = lambda lang: "regexp_replace(file_path, 'go$', 'zz')" if lang == "unknown" else "file_path"
    lines = " UNION ALL ".join(f"SELECT '{lang}' AS language, repo_name, {path(lang)} AS file_path, line_no, line FROM ({X.duck(X.code_lines('go' if lang == 'unknown' else lang))}) {only(i)}" for i, lang in enumerate(MIXED))
    chunks = " UNION ALL ".join(f"SELECT repo_name, file_path, node_id, '{kind}', '', start_line, end_line, '{language}', confidence, '', content_hash FROM ({corpus_queries._chunks_sql(ext, size, 20, kind, confidence)}) x JOIN even USING (repo_name, doc) WHERE is_even = {even}".replace("SELECT repo_name, file_path, CAST(a", "SELECT repo_name, regexp_extract(file_path, '[0-9]+') AS doc, file_path, CAST(a") for ext, size, kind, language, confidence, even in ((".txt", 120, "doc", "text", 0.9, "false"), (".yml", 160, "config", "config", 0.85, "true")))
    return f"""WITH even AS MATERIALIZED (SELECT source AS repo_name, CAST(doc_id AS VARCHAR) AS doc, length(coalesce(text, '')) % 2 = 0 AS is_even FROM documents), l AS MATERIALIZED ({lines}), f AS (SELECT language, repo_name, file_path, max(line_no) AS n FROM l GROUP BY ALL),
n AS MATERIALIZED ({' UNION ALL '.join(of)} UNION ALL SELECT repo_name, file_path, 'file', NULL, 1, n, CASE language WHEN 'unknown' THEN 0.4 ELSE 1.0 END, '', language FROM f),
t AS (SELECT n.repo_name, n.file_path, n.node_type, n.symbol, n.start_line, n.end_line, n.language, n.confidence, n.kind, string_agg(l.line, chr(10) ORDER BY l.line_no) AS body
  FROM n JOIN l ON l.repo_name = n.repo_name AND l.file_path = n.file_path AND l.line_no BETWEEN n.start_line AND n.end_line GROUP BY ALL)
SELECT repo_name, file_path, CASE WHEN node_type = 'file' THEN 'file::' || file_path ELSE node_type || '::' || file_path || '::' || coalesce(symbol, 'NA') || '::' || start_line || '-' || end_line END AS node_id, node_type,
  coalesce(symbol, '') AS symbol, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, language, CAST(confidence AS DOUBLE) AS confidence, kind, sha256(CASE WHEN node_type = 'file' THEN left(body, 8000) ELSE body END) AS content_hash FROM t
UNION ALL {chunks}"""


ORACLES["corpus_nodes"] = _mixed_sql()


@query
def markdown_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Sections and fenced code of markdown files as nodes."""
    made = ingest.corpus_nodes(corpus_queries._markdown(spark, d))
    return made.select("file_path", "node_type", "start_line", "end_line", "language", "confidence", F.col("metadata")["section_path"].alias("section_path"), F.coalesce(F.col("metadata")["code_language"], F.lit("")).alias("code_language"))


ORACLES["markdown_nodes"] = f"""WITH c AS ({corpus_queries.ORACLES['markdown_section_chunks']}), f AS ({corpus_queries.ORACLES['markdown_fences']}), h AS ({corpus_queries.ORACLES['markdown_headings']}),
p AS (SELECT f.repo_name, f.file_path, f.start_line, arg_max(h.section_path, h.line_no) AS section_path FROM f JOIN h ON h.repo_name = f.repo_name AND h.file_path = f.file_path AND h.line_no <= f.start_line GROUP BY ALL)
SELECT file_path, 'doc' AS node_type, start_line, end_line, 'markdown' AS language, CAST(0.92 AS DOUBLE) AS confidence,
  CASE WHEN section_path <> '' THEN section_path WHEN max(section_path) OVER (PARTITION BY repo_name, file_path) = '' THEN 'Document' ELSE 'Preamble' END AS section_path, '' AS code_language FROM c
UNION ALL SELECT f.file_path, 'doc_code', f.start_line, f.end_line, 'markdown', CASE WHEN f.fence_closed THEN 0.9 ELSE 0.86 END, coalesce(p.section_path, 'Preamble'), f.code_language FROM f LEFT JOIN p USING (repo_name, file_path, start_line)"""


@query
def notebook_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Notebooks of Python cells, one an order, as nodes: cells, and the functions, calls and comments in them."""
    cells = X.spark_sql(spark, d, X.code_lines("python")).groupBy("repo_name", "o_custkey", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("source"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "source"))), lambda c: F.struct(F.lit("code").alias("cell_type"), c["source"].alias("source")))
    books = cells.groupBy("o_custkey", "repo_name").agg(F.to_json(F.struct(listed.alias("cells"))).alias("text"))
    files = corpus.files_from_texts(books, F.col("repo_name"), F.concat(F.lit("n/c"), "o_custkey", F.lit(".ipynb")), F.col("text"))
    return ingest.corpus_nodes(files).select("file_path", "node_type", F.coalesce("symbol", F.lit("")).alias("symbol"), "start_line", "end_line", "language", "confidence")


ORACLES["notebook_nodes"] = _base("python").rstrip() + """, c AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY k) - 1 AS i FROM l),
e AS (SELECT *, line_no + i AS flat FROM c),
b AS (SELECT o_custkey, k, i, min(flat) AS a, max(flat) AS z, max(flat) FILTER (part = 2) AS header FROM e GROUP BY ALL),
n AS (
  SELECT o_custkey, 'file' AS node_type, '' AS symbol, 1 AS a, max(z) AS z, 'notebook' AS language, 0.92 AS confidence FROM b GROUP BY o_custkey
  UNION ALL SELECT o_custkey, 'notebook_code', 'cell_' || i, a, z, 'python', 0.88 FROM b
  UNION ALL SELECT o_custkey, 'function', 'F' || k, header, z, 'python', 0.95 FROM b
  UNION ALL SELECT o_custkey, 'comment_line', '', flat, flat, 'python', 0.78 FROM e WHERE part = 3
  UNION ALL SELECT o_custkey, 'call_edge', 'F' || k || '->g' || o_custkey, flat, flat, 'python', 0.8 FROM e WHERE part = 4
  UNION ALL SELECT o_custkey, 'call_edge', 'F' || k || '->h' || k % 50, flat, flat, 'python', 0.8 FROM e WHERE part = 4)
SELECT 'n/c' || o_custkey || '.ipynb' AS file_path, node_type, symbol, CAST(a AS INT) AS start_line, CAST(z AS INT) AS end_line, language, CAST(confidence AS DOUBLE) AS confidence FROM n"""


@query
def brace_blocks(spark: SparkSession, d: str) -> DataFrame:
    return spans.brace_blocks(lines_of(spark, d, "go")).select("file_path", "line_no", "block_end")


ORACLES["brace_blocks"] = _base("go") + """SELECT file_path, line_no, CAST(CASE WHEN nxt IS NULL OR nxt > least(n, line_no + 299) THEN line_no ELSE least(nxt_end, least(n, line_no + 299)) END AS INT) AS block_end FROM (
  SELECT l.file_path, l.line_no, max(l.line_no) OVER (PARTITION BY l.file_path) AS n, min(s.header) OVER w AS nxt, min(s.end_line) OVER w AS nxt_end FROM l LEFT JOIN s ON s.file_path = l.file_path AND s.header = l.line_no
  WINDOW w AS (PARTITION BY l.file_path ORDER BY l.line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query
def statement_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.statement_ends(lines_of(spark, d, "sql")).select("file_path", "line_no", "statement_end")


ORACLES["statement_spans"] = _base("sql") + "SELECT file_path, line_no, CAST(coalesce(min(CASE WHEN contains(line, ';') THEN line_no END) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 399 FOLLOWING), least(max(line_no) OVER (PARTITION BY file_path), line_no + 399)) AS INT) AS statement_end FROM l"


@query
def annotation_blocks(spark: SparkSession, d: str) -> DataFrame:
    a = spans.annotation_blocks(lines_of(spark, d, "java"), "@")
    return a.where(F.col("line").contains("int F")).select("file_path", "line_no", "ann_start", F.array_join("annotations", "|").alias("annotations"))


ORACLES["annotation_blocks"] = _base("java") + "SELECT file_path, header AS line_no, start_line AS ann_start, coalesce(ann, '') AS annotations FROM s"


@query
def call_edges_scoped(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d, "go")
    scopes = code.extract(lines, "go").where(F.col("node_type") == "function")
    return graph.scoped_calls(scopes, graph.call_tokens(lines)).select("file_path", "caller", "callee", "line_no")


ORACLES["call_edges_scoped"] = _base("go") + "SELECT file_path, caller, callee, CAST(place // 10 AS INT) AS line_no FROM edges"


def _comment_query(name: str, language: str, run: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, d: run(lines_of(spark, d, language)).select("file_path", "start_line", "end_line")
    ORACLES[name] = _base(language) + "SELECT file_path, line_no AS start_line, line_no AS end_line FROM l WHERE part = 3"


_comment_query("hash_comments", "r", spans.hash_comments)
_comment_query("slash_comments", "go", lambda lines: spans.marked_comments(lines, "//"))
_comment_query("sql_comments", "sql", lambda lines: spans.marked_comments(lines, "--"))
_comment_query("cobol_comments", "cobol", spans.cobol_comments)


@query
def sql_lineage(spark: SparkSession, d: str) -> DataFrame:
    return code.sql_lineage(lines_of(spark, d, "sql")).select("file_path", "node_type", "symbol", "start_line", "end_line", "kind")


ORACLES["sql_lineage"] = _base("sql") + """, e AS (SELECT file_path, line_no, min(CASE WHEN contains(line, ';') THEN line_no END) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop, part, k, o_custkey FROM l)
SELECT file_path, 'view' AS node_type, 'v' || k AS symbol, line_no AS start_line, stop AS end_line, 'create_view' AS kind FROM e WHERE part = 2
UNION ALL SELECT file_path, 'query', 'UPDATE@' || line_no, line_no, stop, 'UPDATE' FROM e WHERE part = 0
UNION ALL SELECT file_path, 'query', 'SELECT@' || line_no, line_no, stop, 'SELECT' FROM e WHERE part = 4
UNION ALL SELECT file_path, 'call_edge', 'query@' || line_no || '->s' || k % 10, line_no, line_no, 'references' FROM e WHERE part = 0
UNION ALL SELECT file_path, 'call_edge', 'query@' || line_no || '->g' || o_custkey, line_no, line_no, 'references' FROM e WHERE part = 4
UNION ALL SELECT file_path, 'call_edge', 'query@' || line_no || '->h' || k % 50, line_no, line_no, 'references' FROM e WHERE part = 4
UNION ALL SELECT file_path, 'comment_line', NULL, line_no, line_no, 'line_block' FROM e WHERE part = 3"""


@query
def cobol_nodes(spark: SparkSession, d: str) -> DataFrame:
    return code.cobol(lines_of(spark, d, "cobol")).select("file_path", "node_type", "symbol", "start_line", "end_line", "kind")


ORACLES["cobol_nodes"] = _base("cobol") + """SELECT file_path, 'function' AS node_type, 'P' || k AS symbol, line_no AS start_line, line_no + 1 AS end_line, 'paragraph' AS kind FROM l WHERE part = 2
UNION ALL SELECT file_path, 'call_edge', 'P' || k || '->G' || o_custkey, line_no, line_no, 'calls' FROM l WHERE part = 4
UNION ALL SELECT file_path, 'comment_line', NULL, line_no, line_no, 'line_block' FROM l WHERE part = 3"""


@query
def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    return python_code.python_symbols(lines_of(spark, d, "python")).select("file_path", "node_type", "symbol", "start_line", "end_line")


ORACLES["python_symbols"] = _base("python") + "SELECT file_path, 'function' AS node_type, 'F' || k AS symbol, header AS start_line, end_line FROM s"


@query
def python_calls(spark: SparkSession, d: str) -> DataFrame:
    return python_code.python_calls(lines_of(spark, d, "python")).select("file_path", "caller", "callee", "line_no")


ORACLES["python_calls"] = _base("python") + "SELECT file_path, 'F' || k AS caller, 'g' || o_custkey AS callee, line_no FROM l WHERE part = 4 UNION ALL SELECT file_path, 'F' || k, 'h' || k % 50, line_no FROM l WHERE part = 4"


@query
def python_imports(spark: SparkSession, d: str) -> DataFrame:
    return python_code.python_imports(lines_of(spark, d, "python")).select("file_path", "line_no", "symbol", "alias", "kind")


ORACLES["python_imports"] = _base("python") + "SELECT file_path, line_no, 'm' || k % 10 AS symbol, '' AS alias, 'import' AS kind FROM l WHERE part = 0"

_PY_EXTRA = "CASE WHEN part = 2 AND k % 5 = 0 THEN 'def main(x):' WHEN part = 5 AND k % 8 = 0 THEN 'if __name__ == \"__main__\":' WHEN part = 4 AND k % 3 = 0 THEN '    \"\"\"about ' || k || '\"\"\"' ELSE line END"


def _python_extra(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(X.spark_sql(spark, d, X.code_lines("python")).withColumn("line", F.expr(_PY_EXTRA)))


@query
def python_entrypoints(spark: SparkSession, d: str) -> DataFrame:
    return python_code.python_entrypoints(_python_extra(spark, d)).select("file_path", "line_no", "symbol", "kind")


ORACLES["python_entrypoints"] = _base("python") + "SELECT file_path, max(line_no) AS line_no, 'main' AS symbol, 'main_function' AS kind FROM l WHERE part = 2 AND k % 5 = 0 GROUP BY 1 UNION ALL SELECT file_path, line_no, '__main__', 'python_main_guard' FROM l WHERE part = 5 AND k % 8 = 0"


@query
def python_docstrings(spark: SparkSession, d: str) -> DataFrame:
    return python_code.python_docstrings(_python_extra(spark, d))


ORACLES["python_docstrings"] = _base("python") + "SELECT repo_name, file_path, 'function:' || CASE WHEN k % 5 = 0 THEN 'main' ELSE 'F' || k END AS owner, line_no AS start_line, line_no AS end_line FROM l WHERE part = 4 AND k % 3 = 0"

_NOTEBOOK = """SELECT 'nb' AS repo_name, 'n/' || conv_id || '.ipynb' AS file_path, to_json(named_struct(
  'cells', transform(array_sort(collect_list(struct(turn, role, text))), x -> named_struct('cell_type', CASE x.role WHEN 'user' THEN 'code' WHEN 'assistant' THEN 'markdown' ELSE 'raw' END, 'source', coalesce(x.text, ''))),
  'metadata', named_struct('language_info', named_struct('name', 'Python')))) AS text FROM {conversations} GROUP BY conv_id"""


@query
def notebook_cells(spark: SparkSession, d: str) -> DataFrame:
    return code.notebook_cells(X.spark_sql(spark, d, _NOTEBOOK)).select("file_path", "cell_index", "cell_type", "language", "start_line", "n_lines", "source", "parse_error")


ORACLES["notebook_cells"] = """WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, coalesce(text, '') AS source, string_split(coalesce(text, ''), chr(10)) AS p FROM conversations),
n AS (SELECT *, CAST(greatest(1, CASE WHEN p[-1] = '' THEN len(p) - 1 ELSE len(p) END) AS INT) AS n_lines FROM c)
SELECT 'n/' || conv_id || '.ipynb' AS file_path, CAST(i AS INT) AS cell_index, CASE role WHEN 'user' THEN 'code' WHEN 'assistant' THEN 'markdown' ELSE 'raw' END AS cell_type, 'python' AS language,
  CAST(1 + coalesce(sum(n_lines + 1) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_line, n_lines, source, CAST(NULL AS VARCHAR) AS parse_error FROM n"""

