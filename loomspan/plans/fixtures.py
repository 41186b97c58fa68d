"""Corpora derived from the given tables, in SQL that Spark and DuckDB both read.

``{name}`` stands for a table. Spark gets the tables as DataFrames, DuckDB by name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

COLLECTION_OF_LABEL = "CASE label % 7 WHEN 0 THEN 'code_symbols' WHEN 1 THEN 'code_routes' WHEN 2 THEN 'code_usage' WHEN 3 THEN 'configs' WHEN 4 THEN 'docs' WHEN 5 THEN 'security_tags' ELSE 'flows' END"

VECTORS = f"SELECT 'n' || vec_id AS node_id, {COLLECTION_OF_LABEL} AS collection, 'repo_' || (vec_id % 3) AS repo_name, embedding, 'f' || (vec_id % 17) || '.py' AS file_path, CAST(vec_id % 50 + 1 AS INT) AS start_line, CAST(vec_id % 50 + 9 AS INT) AS end_line, 'function' AS node_type, 'python' AS language, 's' || vec_id AS symbol, 'body of ' || vec_id AS document FROM {{embeddings}}"

#: Every hundredth vector is a query.
QUERIES = (
    "SELECT vec_id AS query_id, CASE (vec_id % 600) WHEN 0 THEN 'Where is the audit trace and evidence?' WHEN 100 THEN 'jwt auth policy' WHEN 200 THEN 'Which YAML config sets the provider' "
    "WHEN 300 THEN 'call chain flow' WHEN 400 THEN 'audit config' ELSE 'hello there' END AS text, embedding, "
    "CASE vec_id % 3 WHEN 0 THEN array('repo_0') WHEN 1 THEN array('repo_1', 'repo_0') ELSE array('repo_2', 'repo_0', 'repo_1') END AS stores FROM {embeddings} WHERE vec_id % 100 = 0"
)

NODES = (
    "SELECT 'repo' AS repo_name, 'f' || l_orderkey AS file_path, CASE l_partkey % 5 WHEN 0 THEN 'route' WHEN 1 THEN 'auth_guard' WHEN 2 THEN 'sensitive_op' WHEN 3 THEN 'audit_log' ELSE 'function' END AS node_type, "
    "'sql' AS language, 'p' || l_partkey AS symbol, CAST(l_linenumber * 10 AS INT) AS start_line, CAST(l_linenumber * 10 + CAST(floor(l_quantity) AS INT) % 8 AS INT) AS end_line, 'line ' || l_linenumber || ' of ' || l_orderkey AS text, "
    "CAST(0.5 + (l_partkey % 5) * 0.1 AS DOUBLE) AS confidence, CAST(l_linenumber * 1000000 + l_partkey AS BIGINT) AS emit_seq FROM {lineitem}"
)

FILES = "SELECT source AS repo_name, 'd/' || doc_id || '{ext}' AS file_path, coalesce(text, '') AS text FROM {{documents}}"

REGISTRY = "SELECT source AS repo_name, 'd/' || doc_id || '.txt' AS file_path, {sha}(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END{bits}) AS file_hash, 'old' AS last_indexed_at FROM {{documents}} WHERE doc_id % 3 <> 0 UNION ALL SELECT source, 'gone/' || doc_id || '.txt', 'h', 'old' FROM {{documents}} WHERE doc_id % 7 = 0"

#: Line j of a text becomes a heading or a fence by its number and document.
MARKDOWN_LINE = (
    "CASE WHEN (doc_id + j) % 7 = 0 THEN substr('####', 1, CAST(1 + (doc_id + j) % 4 AS INT)) || ' T' || j || ' of ' || doc_id "
    "WHEN (doc_id + j) % 11 IN (3, 5) THEN CASE WHEN doc_id % 9 = 0 THEN '~~~' ELSE '```py' END ELSE line END"
)

#: Source files: one a customer, one function an order. Placeholders: i(mport), a(nnotation), h(eader), c(omment), b(ody), e(nd).
CODE = {
    "go": dict(ext="go", i="'import \"m' || {k} % 10 || '\"'", a="'r.GET(\"/p' || {k} || '\", f)'", h="'func F' || {k} || '(x int) {{'", c="'// note ' || {k}", e="'}}'"),
    "java": dict(ext="java", i="'import m.M' || {k} % 10 || ';'", a="'@GetMapping(\"/p' || {k} || '\")'", h="'public int F' || {k} || '(int x) {{'", c="'// note ' || {k}", e="'}}'"),
    "kotlin": dict(ext="kt", i="'import m.M' || {k} % 10", a="'@PostMapping(\"/p' || {k} || '\")'", h="'fun F' || {k} || '(x: Int) {{'", c="'// note ' || {k}", e="'}}'"),
    "csharp": dict(ext="cs", i="'using M' || {k} % 10 || ';'", a="'[HttpGet(\"/p' || {k} || '\")]'", h="'public int F' || {k} || '(int x) {{'", c="'// note ' || {k}", e="'}}'"),
    "cpp": dict(ext="cpp", i="'#include \"m' || {k} % 10 || '\"'", a="'int v' || {k} || ' = 0;'", h="'int F' || {k} || '(int x) {{'", c="'// note ' || {k}", e="'}}'"),
    "scala": dict(ext="scala", i="'import m.M' || {k} % 10", a="'val v' || {k} || ' = 0'", h="'def F' || {k} || '(x: Int) = {{'", c="'// note ' || {k}", e="'}}'"),
    "r": dict(ext="r", i="'library(m' || {k} % 10 || ')'", a="'v' || {k} || ' <- 0'", h="'F' || {k} || ' <- function(x) {{'", c="'# note ' || {k}", e="'}}'"),
    "javascript": dict(ext="js", i="'import x from \"m' || {k} % 10 || '\"'", a="'<Route path=\"/p' || {k} || '\"/>'", h="'function F' || {k} || '(x) {{'", c="'// note ' || {k}", e="'}}'"),
    "python": dict(ext="py", i="'import m' || {k} % 10", a="'@tag'", h="'def F' || {k} || '(x):'", c="'    # note ' || {k}", e="'    return x'"),
    "sql": dict(ext="sql", i="'update s' || {k} % 10", a="'set a = 1;'", h="'create view v' || {k} || ' as'", c="'-- note ' || {k}", e="'  where a = 1;'"),
    "cobol": dict(ext="cob", i="'       DISPLAY m' || {k} % 10", a="'       MOVE A TO B'", h="'       P' || {k} || '.'", c="'      * note ' || {k}", e="'       EXIT PROGRAM'"),
}
BODY = {"sql": "'  select * from g' || o_custkey || ' join h' || {k} % 50 || ' on 1 = 1'", "cobol": "'       CALL \"G' || o_custkey || '\"'"}


def code_lines(language: str) -> str:
    """SQL for ``(repo_name, file_path, k, part, line_no, line)`` of the language's files."""
    c = {p: v.replace("{k}", "o_orderkey") for p, v in CODE[language].items()}
    body = BODY.get(language, "'  g' || o_custkey || '(x); h' || {k} % 50 || '(x)'").replace("{k}", "o_orderkey")
    if language == "python":
        body = "'    g' || o_custkey || '(x); h' || o_orderkey % 50 || '(x)'"
    parts = [(0, c["i"], ""), (1, c["a"], " WHERE o_orderkey % 4 = 0"), (2, c["h"], ""), (3, c["c"], " WHERE o_orderkey % 6 = 0"), (4, body, ""), (5, c["e"], "")]
    union = " UNION ALL ".join(f"SELECT o_custkey, o_orderkey, {p} AS part, {expr} AS line FROM {{orders}}{where}" for p, expr, where in parts)
    return f"SELECT 'repo_' || (o_custkey % 3) AS repo_name, 'src/c' || o_custkey || '.{c['ext']}' AS file_path, o_custkey, o_orderkey AS k, part, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, part) AS INT) AS line_no, line FROM ({union}) u"


def spark_sql(spark: SparkSession, sf_dir: str, sql: str, *, placed: bool = False) -> DataFrame:
    """Run fixture SQL over the tables it names; doubled braces are literal ones. ``placed`` adds ``place``, which orders the rows as the one table has them."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sorted(set(re.findall(r"\{(\w+)\}", sql)) & set(TABLES))}
    if placed:
        frames = {t: df.select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias("place")) for t, df in frames.items()}
        sql = sql.replace("SELECT", "SELECT place,", 1)
    return spark.sql(sql, **frames)


def duck(sql: str) -> str:
    """The same SQL with table names and DuckDB's list syntax."""
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("array(", "list_value(").replace("{{", "{").replace("}}", "}")
