"""Queries over files, lines, documents, nodes and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import defaults as D
from loomspan.functions import text as T
from loomspan.operators import documents, embed, graph, nodes, reports, spans, store  # noqa: F401
from loomspan.plans import fixtures as X
from loomspan.sources import corpus
from loomspan.sources.scratch import scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _files(spark: SparkSession, d: str, ext: str = ".txt") -> DataFrame:
    raw = X.spark_sql(spark, d, X.FILES.format(ext=ext))
    return corpus.files_from_texts(raw, F.col("repo_name"), F.col("file_path"), F.col("text"))


def _files_sql(ext: str = ".txt") -> str:
    return f"files AS (SELECT *, string_split(text, chr(10)) AS parts FROM ({X.duck(X.FILES.format(ext=ext))})), lf AS (SELECT repo_name, file_path, text, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS lines, len(CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END) AS n_lines FROM files)"


@query
def line_table(spark: SparkSession, d: str) -> DataFrame:
    return corpus.line_table(_files(spark, d))


ORACLES["line_table"] = f"WITH {_files_sql()} SELECT repo_name, file_path, CAST(i AS INT) AS line_no, line FROM lf, unnest(lines) WITH ORDINALITY AS u(line, i)"


@query
def corpus_listing(spark: SparkSession, d: str) -> DataFrame:
    return corpus.listing(_files(spark, d), 400)


ORACLES["corpus_listing"] = f"WITH {_files_sql()} SELECT repo_name, file_path FROM lf QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY file_path) <= 400"


@query
def header_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.header(_files(spark, d), 80)


ORACLES["header_excerpts"] = f"WITH {_files_sql()} SELECT repo_name, file_path, array_to_string(lines[1:80], chr(10)) AS header FROM lf"


def _chunks_sql(ext: str, size: int, overlap: int, kind: str, confidence: float) -> str:
    step = size - overlap
    return f"""WITH {_files_sql(ext)}, k AS (SELECT *, CAST(greatest(0, ceil((n_lines - {size}) / {step}.0)) AS INT) AS m FROM lf WHERE n_lines > 0),
c AS (SELECT *, 1 + u.i * {step} AS a, least(u.i * {step} + {size}, n_lines) AS b FROM k, unnest(range(0, m + 1)) AS u(i)
  UNION ALL SELECT *, 0, n_lines - {overlap} + 1, n_lines FROM k WHERE n_lines - {overlap} + 1 > 1 + m * {step})
SELECT repo_name, file_path, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line, '{kind}::' || file_path || '::' || a || '-' || b AS node_id, sha256(array_to_string(lines[a:b], chr(10))) AS content_hash, {confidence} AS confidence
FROM c WHERE trim(array_to_string(lines[a:b], chr(10)), chr(10) || ' ') <> ''"""


_CHUNK = ["repo_name", "file_path", "start_line", "end_line", "node_id", "content_hash", "confidence"]


@query
def plain_chunks(spark: SparkSession, d: str) -> DataFrame:
    return documents.plain_chunks(_files(spark, d)).select(*_CHUNK)


ORACLES["plain_chunks"] = _chunks_sql(".txt", 120, 20, "doc", 0.9)


@query
def config_chunks(spark: SparkSession, d: str) -> DataFrame:
    return documents.config_chunks(_files(spark, d, ".yml")).select(*_CHUNK)


ORACLES["config_chunks"] = _chunks_sql(".yml", 160, 20, "config", 0.85)


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    raw = X.spark_sql(spark, d, "SELECT doc_id, source, posexplode(split(coalesce(text, ''), '\n')) AS (p, line) FROM {documents}").withColumn("j", F.col("p") + 1)
    marked = raw.withColumn("md", F.expr(X.MARKDOWN_LINE))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "md"))), lambda x: x["md"]), "\n")
    built = marked.groupBy("doc_id", "source").agg(text.alias("text"))
    return corpus.files_from_texts(built, F.col("source"), F.concat(F.lit("m/"), "doc_id", F.lit(".md")), F.col("text"))


_MD = f"""WITH l0 AS (SELECT source AS repo_name, 'm/' || doc_id || '.md' AS file_path, doc_id, CAST(u.j AS INT) AS j, u.line FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(line, j)),
l AS (SELECT repo_name, file_path, j AS line_no, {X.MARKDOWN_LINE} AS line FROM l0),
n AS (SELECT repo_name, file_path, max(line_no) FILTER (line <> '' OR line_no < mx) AS n_lines FROM (SELECT *, max(line_no) OVER (PARTITION BY repo_name, file_path) AS mx FROM l) GROUP BY ALL),
h AS (SELECT repo_name, file_path, line_no, length(regexp_extract(line, '^(#+)', 1)) AS level, regexp_extract(line, '^#+ (.*)$', 1) AS title FROM l WHERE regexp_matches(line, '^#{{1,6}} .')),
anc AS (SELECT a.repo_name, a.file_path, a.line_no, a.level, a.title, string_agg(b.title, ' > ' ORDER BY b.line_no) AS section_path FROM h a JOIN h b ON a.repo_name = b.repo_name AND a.file_path = b.file_path AND b.line_no <= a.line_no AND (b.level < a.level OR b.line_no = a.line_no)
  AND NOT EXISTS (SELECT 1 FROM h c WHERE c.repo_name = a.repo_name AND c.file_path = a.file_path AND c.line_no > b.line_no AND c.line_no <= a.line_no AND c.level <= b.level) GROUP BY ALL)
"""


@query
def markdown_headings(spark: SparkSession, d: str) -> DataFrame:
    return documents.headings(corpus.line_table(_markdown(spark, d)))


ORACLES["markdown_headings"] = _MD + "SELECT * FROM anc"


@query
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    files = _markdown(spark, d)
    return documents.sections(corpus.line_table(files)).select("repo_name", "file_path", "start_line", "end_line", "level", "title", "section_path")


ORACLES["markdown_sections"] = _MD + """SELECT a.repo_name, a.file_path, a.line_no AS start_line, coalesce(lead(a.line_no) OVER (PARTITION BY a.repo_name, a.file_path ORDER BY a.line_no) - 1, n.n_lines) AS end_line, level, title, section_path FROM anc a JOIN n USING (repo_name, file_path)
UNION ALL SELECT repo_name, file_path, 1, e, 0, '', '' FROM (SELECT n.repo_name, n.file_path, coalesce((SELECT min(line_no) FROM h WHERE h.repo_name = n.repo_name AND h.file_path = n.file_path) - 1, n.n_lines) AS e FROM n) x
WHERE e >= 1 AND EXISTS (SELECT 1 FROM l WHERE l.repo_name = x.repo_name AND l.file_path = x.file_path AND line_no <= e AND trim(line) <> '')"""


@query
def markdown_section_chunks(spark: SparkSession, d: str) -> DataFrame:
    files = _markdown(spark, d)
    return documents.section_chunks(files, corpus.line_table(files)).select("repo_name", "file_path", "start_line", "end_line", "section_path", F.sha2("text", 256).alias("content_hash"))


# Sections cut to chunks of 100 lines, 20 in common.
ORACLES["markdown_section_chunks"] = ORACLES["markdown_sections"].replace("SELECT a.repo_name, a.file_path, a.line_no AS start_line", ", sec AS (SELECT a.repo_name, a.file_path, a.line_no AS start_line", 1) + """),
k AS (SELECT *, end_line - start_line + 1 AS n, CAST(greatest(0, ceil((end_line - start_line + 1 - 100) / 80.0)) AS INT) AS m FROM sec WHERE end_line >= start_line),
c AS (SELECT *, start_line + u.i * 80 AS a, least(start_line + u.i * 80 + 99, end_line) AS b FROM k, unnest(range(0, m + 1)) AS u(i)
  UNION ALL SELECT *, 0, end_line - 19, end_line FROM k WHERE end_line - 19 > start_line + m * 80),
x AS (SELECT c.repo_name, c.file_path, c.a, c.b, c.section_path, string_agg(l.line, chr(10) ORDER BY l.line_no) AS body FROM c JOIN l ON l.repo_name = c.repo_name AND l.file_path = c.file_path AND l.line_no BETWEEN c.a AND c.b GROUP BY ALL)
SELECT repo_name, file_path, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line, section_path, sha256(body) AS content_hash FROM x WHERE trim(body, chr(10) || ' ') <> ''"""


@query
def markdown_titles(spark: SparkSession, d: str) -> DataFrame:
    files = _markdown(spark, d)
    return documents.doc_titles(files, corpus.line_table(files))


ORACLES["markdown_titles"] = _MD + "SELECT n.repo_name, n.file_path, coalesce((SELECT arg_min(title, line_no) FROM h WHERE level = 1 AND h.repo_name = n.repo_name AND h.file_path = n.file_path), regexp_extract(n.file_path, 'm/(.*)[.]md', 1)) AS doc_title FROM (SELECT DISTINCT repo_name, file_path FROM l) n"


@query
def markdown_fences(spark: SparkSession, d: str) -> DataFrame:
    return documents.fences(corpus.line_table(_markdown(spark, d)))


# One marker a file in this corpus, so fences pair up in order.
ORACLES["markdown_fences"] = _MD + """, f AS (SELECT repo_name, file_path, line_no, CASE WHEN line = '~~~' THEN 'text' ELSE 'py' END AS code_language, row_number() OVER (PARTITION BY repo_name, file_path ORDER BY line_no) AS r, lead(line_no) OVER (PARTITION BY repo_name, file_path ORDER BY line_no) AS nxt FROM l WHERE line IN ('```py', '~~~'))
SELECT f.repo_name, f.file_path, line_no AS start_line, coalesce(nxt, n_lines) AS end_line, code_language, nxt IS NOT NULL AS fence_closed FROM f JOIN n USING (repo_name, file_path) WHERE r % 2 = 1"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    n = X.spark_sql(spark, d, X.NODES)
    return n.withColumn("node_id", nodes.node_id(F.col("node_type"), F.col("file_path"), F.col("symbol"), F.col("start_line"), F.col("end_line")))


_N = f"WITH nodes AS (SELECT *, node_type || '::' || file_path || '::' || symbol || '::' || start_line || '-' || end_line AS node_id FROM ({X.duck(X.NODES)}))"
_ROUTE = "(VALUES " + ", ".join(f"('{t}', '{c}')" for c, ts in D.ROUTING.items() for t in ts) + ") m(node_type, collection)"


@query
def nodes_dedup(spark: SparkSession, d: str) -> DataFrame:
    return nodes.first_wins(_nodes(spark, d).withColumn("node_id", F.concat("file_path", F.lit(":"), "node_type"))).select("node_id", "symbol", "start_line", "emit_seq")


ORACLES["nodes_dedup"] = _N + "SELECT file_path || ':' || node_type AS node_id, arg_min(symbol, emit_seq) AS symbol, arg_min(start_line, emit_seq) AS start_line, min(emit_seq) AS emit_seq FROM nodes GROUP BY 1"


@query
def collection_routing(spark: SparkSession, d: str) -> DataFrame:
    return nodes.routed(_nodes(spark, d)).select("node_id", "emit_seq", "collection")


ORACLES["collection_routing"] = _N + f"SELECT node_id, emit_seq, collection FROM nodes JOIN {_ROUTE} USING (node_type)"


@query
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return n.select("node_id", "emit_seq", nodes.embed_text({"why_relevant": F.when(F.col("emit_seq") % 3 == 0, F.lit("audited"))}).alias("embed_text"))


ORACLES["embed_text"] = _N + """SELECT node_id, emit_seq, concat_ws(chr(10), 'TYPE: ' || node_type, 'LANG: ' || language, 'FILE: ' || file_path, 'LINES: ' || start_line || '-' || end_line, 'SYMBOL: ' || symbol, CASE WHEN emit_seq % 3 = 0 THEN 'WHY: audited' END, 'CODE:' || chr(10) || left(text, 8000)) AS embed_text FROM nodes"""


@query
def vector_records(spark: SparkSession, d: str) -> DataFrame:
    r = _nodes(spark, d).select("node_id", "emit_seq", nodes.vector_record().alias("r"))
    return r.select("node_id", "emit_seq", "r.document", "r.metadata.symbol", "r.metadata.start_line", "r.metadata.end_line", F.round("r.metadata.confidence", 6).alias("confidence"))


ORACLES["vector_records"] = _N + "SELECT node_id, emit_seq, left(text, 3000) AS document, coalesce(symbol, '') AS symbol, start_line, end_line, round(confidence, 6) AS confidence FROM nodes"


@query
def flow_chains(spark: SparkSession, d: str) -> DataFrame:
    return graph.flow_chains(_nodes(spark, d)).select("file_path", "symbol", "start_line", "end_line", "text")


ORACLES["flow_chains"] = _N + """, r AS (SELECT * FROM nodes WHERE node_type = 'route'), s AS (SELECT * FROM nodes WHERE node_type = 'sensitive_op'),
g AS (SELECT s.file_path, s.emit_seq, x.symbol, x.start_line, x.end_line FROM s JOIN nodes x ON x.node_type = 'auth_guard' AND x.file_path = s.file_path AND x.end_line <= s.start_line QUALIFY row_number() OVER (PARTITION BY s.file_path, s.emit_seq ORDER BY x.end_line DESC, x.emit_seq) = 1),
a AS (SELECT s.file_path, s.emit_seq, x.symbol, x.start_line, x.end_line FROM s JOIN nodes x ON x.node_type = 'audit_log' AND x.file_path = s.file_path AND x.start_line >= s.end_line QUALIFY row_number() OVER (PARTITION BY s.file_path, s.emit_seq ORDER BY x.start_line, x.emit_seq) = 1)
SELECT s.file_path, r.symbol || '->' || s.symbol AS symbol, least(r.start_line, g.start_line, s.start_line, a.start_line) AS start_line, greatest(r.end_line, g.end_line, s.end_line, a.end_line) AS end_line,
  'Entrypoint: ' || r.symbol || chr(10) || 'Security check: ' || g.symbol || chr(10) || 'Sensitive op: ' || s.symbol || chr(10) || 'Audit log: ' || a.symbol AS text
FROM s JOIN g ON g.file_path = s.file_path AND g.emit_seq = s.emit_seq JOIN a ON a.file_path = s.file_path AND a.emit_seq = s.emit_seq JOIN r ON r.file_path = s.file_path AND s.start_line >= r.start_line"""


@query
def node_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.node_type_counts(_nodes(spark, d))


ORACLES["node_type_counts"] = _N + "SELECT node_type, count(*) AS n FROM nodes GROUP BY 1"


@query
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.run_summary(_nodes(spark, d))


ORACLES["run_summary"] = _N + "SELECT repo_name, node_type, count(*) AS n, count(DISTINCT file_path) AS files, count(*) FILTER (node_type IN ('auth_guard', 'policy_check', 'audit_log', 'sensitive_op')) AS security_tags FROM nodes GROUP BY ROLLUP (repo_name, node_type)"


@query
def embed_batches_plan(spark: SparkSession, d: str) -> DataFrame:
    return store.batches(nodes.routed(_nodes(spark, d)), 20)


ORACLES["embed_batches_plan"] = _N + f"SELECT collection, count(*) AS nodes, CAST(ceil(count(*) / 20.0) AS BIGINT) AS batches FROM nodes JOIN {_ROUTE} USING (node_type) GROUP BY 1"


@query
def file_confidence(spark: SparkSession, d: str) -> DataFrame:
    per = _nodes(spark, d).groupBy("file_path").agg(F.count_if(F.col("node_type").isin("function", "route")).alias("n"))
    return per.select("file_path", "n", nodes.file_confidence(F.col("n")).cast("double").alias("confidence"))


ORACLES["file_confidence"] = _N + "SELECT file_path, n, CAST(CASE WHEN n >= 6 THEN 0.92 WHEN n >= 2 THEN 0.82 WHEN n = 1 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM (SELECT file_path, count(*) FILTER (node_type IN ('function', 'route')) AS n FROM nodes GROUP BY 1)"


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return X.spark_sql(spark, d, X.REGISTRY.format(sha="sha2", bits=", 256"))


_R = f"WITH files AS (SELECT *, sha256(text) AS file_hash FROM ({X.duck(X.FILES.format(ext='.txt'))})), reg AS ({X.duck(X.REGISTRY.format(sha='sha256', bits=''))})"


@query
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    return store.changed_files(_files(spark, d), _registry(spark, d)).select("repo_name", "file_path", "file_hash")


ORACLES["changed_files"] = _R + "SELECT repo_name, file_path, file_hash FROM files f WHERE NOT EXISTS (SELECT 1 FROM reg r WHERE r.repo_name = f.repo_name AND r.file_path = f.file_path AND r.file_hash = f.file_hash)"


@query
def file_change_classes(spark: SparkSession, d: str) -> DataFrame:
    return store.change_classes(_files(spark, d), _registry(spark, d))


ORACLES["file_change_classes"] = _R + "SELECT repo_name, file_path, CASE WHEN r.file_hash IS NULL THEN 'new' WHEN f.file_hash IS NULL THEN 'removed' WHEN f.file_hash = r.file_hash THEN 'unchanged' ELSE 'changed' END AS change FROM files f FULL JOIN reg r USING (repo_name, file_path)"


@query
def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert_registry(_registry(spark, d), _files(spark, d), F.lit("new"))


ORACLES["registry_upsert"] = _R + "SELECT repo_name, file_path, coalesce(f.file_hash, r.file_hash) AS file_hash, CASE WHEN f.file_hash IS NULL THEN 'old' ELSE 'new' END AS last_indexed_at FROM files f FULL JOIN reg r USING (repo_name, file_path)"

_STORED = ["repo_name", "node_id", "file_path", "node_type", "symbol", "start_line", "text", "content_hash", "confidence", "indexed_at"]


def _stored(spark: SparkSession, d: str, new: bool) -> DataFrame:
    """Stored or new nodes. Line and part may give one ``emit_seq`` twice in a file: both sides hold the row that the table has first."""
    n = X.spark_sql(spark, d, X.NODES, placed=True).where(F.col("emit_seq") % 3 != (0 if new else 1))
    n = n.withColumn("node_id", F.concat("file_path", F.lit("#"), F.col("emit_seq").cast("string")))
    rest = [c for c in n.columns if c in _STORED and c not in ("repo_name", "node_id")]
    n = n.groupBy("repo_name", "node_id").agg(F.min_by(F.struct(*rest), "place").alias("n")).select("repo_name", "node_id", "n.*")
    text = F.concat("text", F.lit("!")) if new else F.col("text")
    n = n.withColumns({"text": text, "symbol": F.concat("symbol", F.lit("n")) if new else F.col("symbol"), "indexed_at": F.lit("t2" if new else "t1")})
    return n.withColumn("content_hash", F.sha2("text", 256)).select(*_STORED)


_S = _N + """, base AS (SELECT DISTINCT ON (file_path, emit_seq) *, file_path || '#' || emit_seq AS nid FROM nodes), o AS (SELECT * FROM base WHERE emit_seq % 3 <> 1), w AS (SELECT * FROM base WHERE emit_seq % 3 <> 0)"""


@query
def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert_nodes(_stored(spark, d, False), _stored(spark, d, True)).select("node_id", "symbol", "text", "content_hash", "indexed_at")


ORACLES["node_upsert"] = _S + "SELECT nid AS node_id, CASE WHEN o.nid IS NULL THEN w.symbol || 'n' ELSE o.symbol END AS symbol, CASE WHEN w.symbol IS NULL THEN o.text ELSE w.text || '!' END AS text, sha256(CASE WHEN w.symbol IS NULL THEN o.text ELSE w.text || '!' END) AS content_hash, CASE WHEN w.symbol IS NULL THEN 't1' ELSE 't2' END AS indexed_at FROM o FULL JOIN w USING (nid)".replace("o.nid IS NULL", "o.symbol IS NULL")


@query
def replace_by_file(spark: SparkSession, d: str) -> DataFrame:
    changed = _nodes(spark, d).where(F.substring("file_path", -1, 1) == "7").select("repo_name", "file_path")
    new = _stored(spark, d, True).where(F.substring("file_path", -1, 1) == "7")
    return store.replace_by_file(_stored(spark, d, False), changed, new).select("node_id", "symbol", "indexed_at")


ORACLES["replace_by_file"] = _S + "SELECT nid AS node_id, symbol, 't1' AS indexed_at FROM o WHERE right(file_path, 1) <> '7' UNION ALL SELECT nid, symbol || 'n', 't2' FROM w WHERE right(file_path, 1) = '7'"


@query
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    v = X.spark_sql(spark, d, X.VECTORS).select("node_id", "collection", "repo_name", "document", "start_line")
    new = v.where(F.col("start_line") % 2 == 0).withColumn("document", F.concat("document", F.lit("!")))
    return store.upsert_vectors(v.where(F.col("start_line") % 3 != 0), new)


ORACLES["vector_upsert"] = f"WITH v AS ({X.duck(X.VECTORS)}) SELECT node_id, collection, repo_name, CASE WHEN start_line % 2 = 0 THEN document || '!' ELSE document END AS document, start_line FROM v WHERE start_line % 2 = 0 OR start_line % 3 <> 0"

_PROPOSALS = """SELECT source AS repo_name, 'd/' || d.doc_id || '.txt' AS file_path,
 '{{"final":{{"nodes":[{{"node_type":"' || CASE WHEN l.toxic = 1 THEN 'sensitive_op' WHEN l.quality = 1 THEN 'auth_guard' ELSE 'note' END || '","symbol":"s' || d.doc_id || '","start_line":' || (d.doc_id % 5 - 1) || ',"end_line":' || (d.doc_id % 7) || ',"confidence":0.75,"severity":" high "}},{{"node_type":"audit_log","start_line":"x","end_line":3}}]}}}}' AS agent_json
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"""


def _proposed(spark: SparkSession, d: str, allowed: list[str] | None) -> DataFrame:
    return nodes.proposed_nodes(X.spark_sql(spark, d, _PROPOSALS), _files(spark, d), source="reviewer", allowed=allowed).select("file_path", "node_id", "node_type", "start_line", "end_line", "content_hash", "confidence", "severity", "evidence")


_P = f"""WITH {_files_sql()}, p AS (SELECT d.source AS repo_name, 'd/' || d.doc_id || '.txt' AS file_path, 's' || d.doc_id AS symbol, CASE WHEN l.toxic = 1 THEN 'sensitive_op' WHEN l.quality = 1 THEN 'auth_guard' ELSE 'note' END AS node_type, greatest(1, d.doc_id % 5 - 1) AS s, d.doc_id % 7 AS e0 FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
q AS (SELECT p.*, least(e0, n_lines) AS e, lines FROM p JOIN lf USING (repo_name, file_path))
SELECT file_path, node_type || '::' || file_path || '::' || symbol || '::' || s || '-' || e AS node_id, node_type, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line, sha256(array_to_string(lines[s:e], chr(10))) AS content_hash, CAST(0.75 AS DOUBLE) AS confidence, 'high' AS severity, '' AS evidence FROM q WHERE e >= s"""


@query
def proposed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _proposed(spark, d, None)


ORACLES["proposed_nodes"] = _P


@query
def proposed_security_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _proposed(spark, d, D.SECURITY_TYPES)


ORACLES["proposed_security_nodes"] = _P + " AND node_type <> 'note'"

_STEPS = """SELECT doc_id AS plan_id, CAST(0 AS INT) AS step, source AS repo_name, 'd/' || doc_id || '.txt' AS file_path,
 CASE doc_id % 5 WHEN 0 THEN 'read_lines' WHEN 1 THEN 'search_in_file' WHEN 2 THEN 'delete_file' WHEN 3 THEN 'read_lines' ELSE 'read_lines' END AS tool, doc_id % 5 AS k, doc_id FROM {documents}"""


@query
def plan_outputs(spark: SparkSession, d: str) -> DataFrame:
    s = X.spark_sql(spark, d, _STEPS)
    args = F.when(F.col("k") == 0, F.create_map(F.lit("start_line"), F.lit("2"), F.lit("end_line"), F.lit("4"))).when(F.col("k") == 1, F.create_map(F.lit("pattern"), F.lit("the [a-d]"))).when(F.col("k") == 2, F.create_map(F.lit("path"), F.lit("x"))).when(F.col("k") == 3, F.create_map(F.lit("start_line"), F.lit("one")))
    return nodes.plan_outputs(s.withColumn("args", args), _files(spark, d)).select("plan_id", "tool", "output", "error")


ORACLES["plan_outputs"] = f"""WITH {_files_sql()}, s AS ({X.duck(_STEPS)}), hit AS (SELECT repo_name, file_path, string_agg(i || ': ' || left(trim(line), 300), chr(10) ORDER BY i) AS found FROM (SELECT repo_name, file_path, line, i FROM lf, unnest(lines) WITH ORDINALITY AS u(line, i) WHERE regexp_matches(line, 'the [a-d]') QUALIFY row_number() OVER (PARTITION BY repo_name, file_path ORDER BY i) <= 50) GROUP BY ALL)
SELECT plan_id, tool, CASE k WHEN 0 THEN array_to_string(lines[2:4], chr(10)) WHEN 1 THEN coalesce(found, '') END AS output, CASE k WHEN 2 THEN 'unknown_tool' WHEN 3 THEN 'missing_or_invalid_args' WHEN 4 THEN 'invalid_args_type' END AS error
FROM s JOIN lf USING (repo_name, file_path) LEFT JOIN hit USING (repo_name, file_path)"""


@query
def review_candidates(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).withColumn("confidence", F.when(F.length("text") % 2 == 0, 0.5).otherwise(0.9))
    return nodes.review_candidates(files, files.where(F.length("text") % 11 == 0)).select("repo_name", "file_path", "reason")


_WORDS = " OR ".join(f"contains(lower(text), '{w}')" for w in D.IMPORTANT_WORDS)
_DIRS = " OR ".join(f"contains(lower(file_path), '{w}')" for w in D.IMPORTANT_DIRS)
ORACLES["review_candidates"] = f"WITH {_files_sql()} SELECT repo_name, file_path, reason FROM (SELECT *, CASE WHEN length(text) % 11 = 0 THEN 'parse_error' WHEN length(text) % 2 = 0 AND ({_WORDS} OR {_DIRS}) THEN 'low_confidence' END AS reason FROM lf) WHERE reason IS NOT NULL"

_ROOTS = "SELECT 'c' || c_nationkey AS repo_name, CASE (c_custkey % 3 + c_nationkey) % 9 WHEN 0 THEN 'pom.xml' WHEN 1 THEN 'go.mod' WHEN 2 THEN 'app' || (c_custkey % 4) || '.csproj' WHEN 3 THEN 'setup.py' WHEN 4 THEN 'package.json' WHEN 5 THEN '.sln' WHEN 6 THEN 'x.sln' WHEN 7 THEN 'README.md' ELSE 'Pipfile' END AS name FROM {customer}"


@query
def stack_detect(spark: SparkSession, d: str) -> DataFrame:
    found = nodes.stacks(X.spark_sql(spark, d, _ROOTS))
    text = F.array_join(F.transform(F.map_entries("stacks"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return found.select("repo_name", text.alias("stacks"), F.round("confidence", 6).alias("confidence"))


ORACLES["stack_detect"] = f"""WITH r AS ({X.duck(_ROOTS)}), s AS (SELECT DISTINCT repo_name, name, CASE WHEN name = 'pom.xml' THEN 'java' WHEN name = 'go.mod' THEN 'go' WHEN name LIKE '%.csproj' OR name = '.sln' THEN 'dotnet' WHEN name IN ('setup.py', 'Pipfile') THEN 'python' WHEN name = 'package.json' THEN 'node' END AS stack FROM r),
g AS (SELECT repo_name, stack, string_agg(name, ',' ORDER BY name) AS ev, count(*) AS n FROM s WHERE stack IS NOT NULL GROUP BY ALL)
SELECT repo_name, string_agg(stack || '=' || ev, ';' ORDER BY stack) AS stacks, CAST(round(least(0.95, 0.4 + 0.15 * sum(n)), 6) AS DOUBLE) AS confidence FROM g GROUP BY 1"""

_MANIFEST = "SELECT source AS repo_name, CASE doc_id % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'pom.xml' ELSE 'other.txt' END AS name, doc_id, coalesce(text, '') AS text FROM {documents}"


@query
def manifest_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of each repository: its longest text of that name."""
    raw = X.spark_sql(spark, d, _MANIFEST).groupBy("repo_name", "name").agg(F.max_by("text", F.struct(F.length("text"), "doc_id")).alias("text"))
    files = corpus.files_from_texts(raw, F.col("repo_name"), F.col("name"), F.col("text"))
    return corpus.manifests(files).select("repo_name", F.explode("snippets").alias("file_path", "snippet"))


ORACLES["manifest_snippets"] = f"WITH m AS ({X.duck(_MANIFEST)}) SELECT repo_name, name AS file_path, left(arg_max(text, length(text) * 10000000 + doc_id), 3000) AS snippet FROM m WHERE name <> 'other.txt' GROUP BY ALL"


_TIMES = ("2024-01-01 00:00:00", "2024-01-01 00:01:30.25")


@query
def run_report(spark: SparkSession, d: str) -> DataFrame:
    files, registry = _files(spark, d), _registry(spark, d)
    started, finished = (F.lit(t).cast("timestamp") for t in _TIMES)
    found = reports.run_report(files, store.changed_files(files, registry), documents.plain_chunks(files), run_id="run", started=started, finished=finished)
    types = F.array_join(F.transform(F.map_entries("node_type_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.select("run_id", "repo_name", "files_scanned", "files_changed", "nodes", F.coalesce(types, F.lit("")).alias("types"), "security_tags", "elapsed_seconds")


ORACLES["run_report"] = f"""WITH fs AS (SELECT *, sha256(text) AS file_hash FROM ({X.duck(X.FILES.format(ext='.txt'))})), reg AS ({X.duck(X.REGISTRY.format(sha='sha256', bits=''))}), ch AS ({_chunks_sql('.txt', 120, 20, 'doc', 0.9)}),
a AS (SELECT repo_name, count(*) AS files_scanned, count(*) FILTER (NOT EXISTS (SELECT 1 FROM reg r WHERE r.repo_name = fs.repo_name AND r.file_path = fs.file_path AND r.file_hash = fs.file_hash)) AS files_changed FROM fs GROUP BY 1),
n AS (SELECT repo_name, count(*) AS nodes FROM ch GROUP BY 1)
SELECT 'run' AS run_id, a.repo_name, files_scanned, files_changed, coalesce(nodes, 0) AS nodes, CASE WHEN nodes IS NULL THEN '' ELSE 'doc=' || nodes END AS types, CAST(0 AS BIGINT) AS security_tags, CAST(90.25 AS DOUBLE) AS elapsed_seconds FROM a LEFT JOIN n ON a.repo_name = n.repo_name"""


@query
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """What a run wrote, counted while it was written."""
    made = documents.plain_chunks(_files(spark, d))
    return reports.written_with_counters(made, scratch(spark, "run"), "node_type", run_id="run").select("run_id", "nodes", "security_tags", "characters")


ORACLES["run_counters"] = f"""WITH c AS ({_chunks_sql('.txt', 120, 20, 'doc', 0.9).replace("sha256(array_to_string(lines[a:b], chr(10))) AS content_hash", "length(array_to_string(lines[a:b], chr(10))) AS chars")})
SELECT 'run' AS run_id, count(*) AS nodes, CAST(0 AS BIGINT) AS security_tags, CAST(sum(chars) AS BIGINT) AS characters FROM c"""


_BATCHES = "SELECT 'run' || (o_custkey % 5) AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'docs' ELSE 'code_symbols' END AS collection, CAST(o_orderkey % 20 + 1 AS BIGINT) AS nodes, CAST(o_orderkey % 8 AS DOUBLE) / 4 AS embed_seconds, CAST(o_custkey % 4 AS DOUBLE) / 4 AS upsert_seconds FROM {orders}"


@query
def batch_telemetry(spark: SparkSession, d: str) -> DataFrame:
    """Batches, nodes and seconds by run and collection, and by run."""
    return reports.batch_telemetry(X.spark_sql(spark, d, _BATCHES)).select("run_id", F.coalesce("collection", F.lit("all")).alias("collection"), "batches", "nodes", "embed_seconds", "upsert_seconds")


ORACLES["batch_telemetry"] = f"SELECT run_id, coalesce(collection, 'all') AS collection, count(*) AS batches, CAST(sum(nodes) AS BIGINT) AS nodes, sum(embed_seconds) AS embed_seconds, sum(upsert_seconds) AS upsert_seconds FROM ({X.duck(_BATCHES)}) GROUP BY ROLLUP (run_id, collection) HAVING run_id IS NOT NULL"


_ANSWERS = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{{\"a\":' || doc_id || '}}' WHEN 1 THEN 'so {{\"b\":{{\"c\":\"}}\"}}}} and {{\"d\":1}}' WHEN 2 THEN 'none here' ELSE 'open {{\"e\":' || doc_id END AS answer FROM {documents}"


@query
def json_segments(spark: SparkSession, d: str) -> DataFrame:
    """The JSON object in each answer of a model, if there is one."""
    return X.spark_sql(spark, d, _ANSWERS).select("doc_id", T.json_segment(F.col("answer")).alias("segment"))


ORACLES["json_segments"] = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"a":' || doc_id || '}' WHEN 1 THEN '{"b":{"c":"}"}}' END AS segment FROM documents"""


@query
def security_eligible(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).unionByName(_files(spark, d, ".PY")).unionByName(_files(spark, d, ".sql"))
    return nodes.security_eligible(files, [".py", ".java", ".sql"]).select("repo_name", "file_path", "ext", "lang")


ORACLES["security_eligible"] = "SELECT source AS repo_name, 'd/' || doc_id || '.PY' AS file_path, '.py' AS ext, 'python' AS lang FROM documents UNION ALL SELECT source, 'd/' || doc_id || '.sql', '.sql', 'sql' FROM documents"


@query
def unseen_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposals less those that are nodes already: every third was accepted before."""
    made = nodes.proposed_nodes(X.spark_sql(spark, d, _PROPOSALS), _files(spark, d), source="reviewer")
    known = made.where(F.pmod(F.length("file_path") + F.col("end_line"), F.lit(3)) == 0)
    return nodes.unseen(made, known).select("file_path", "node_id", "node_type", "start_line", "end_line")


ORACLES["unseen_proposals"] = f"SELECT DISTINCT file_path, node_id, node_type, start_line, end_line FROM ({_P}) WHERE (length(file_path) + end_line) % 3 <> 0"


@query
def metadata_page(spark: SparkSession, d: str) -> DataFrame:
    v = X.spark_sql(spark, d, X.VECTORS)
    return store.metadata_page(v.select("node_id", "collection", "repo_name", "file_path", "start_line"), F.col("repo_name") == "repo_1", 50, 20)


ORACLES["metadata_page"] = f"SELECT node_id, collection, repo_name, file_path, start_line FROM ({X.duck(X.VECTORS)}) WHERE repo_name = 'repo_1' ORDER BY node_id LIMIT 50 OFFSET 20"


@query
def embedded_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose text has a vector, and those that lack one: vectors of every second place, one text changed since."""
    v = X.spark_sql(spark, d, X.VECTORS).withColumn("content_hash", F.sha2("document", 256))
    given = v.where(F.col("start_line") % 2 == 0).select("node_id", F.when(F.col("start_line") % 10 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"), "embedding")
    have, lack = embed.with_embeddings(v.select("node_id", "content_hash", "start_line"), given)
    return have.select("node_id", F.size("embedding").alias("dim")).unionByName(lack.select("node_id", F.lit(0).alias("dim")))


ORACLES["embedded_nodes"] = f"SELECT node_id, CAST(CASE WHEN start_line % 2 = 0 AND start_line % 10 <> 0 THEN len(embedding) ELSE 0 END AS INT) AS dim FROM ({X.duck(X.VECTORS)})"


@query
def capped_json(spark: SparkSession, d: str) -> DataFrame:
    rows = X.spark_sql(spark, d, "SELECT doc_id, source FROM {documents}")
    return rows.select("doc_id", T.capped_json(F.struct("doc_id", "source"), 24).alias("json"))


_J = """'{"doc_id":' || doc_id || ',"source":"' || source || '"}'"""
ORACLES["capped_json"] = f"SELECT doc_id, CASE WHEN length({_J}) > 24 THEN left({_J}, 24) || '...' ELSE {_J} END AS json FROM documents"
