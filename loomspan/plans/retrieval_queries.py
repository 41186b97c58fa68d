"""Queries over vectors, questions, conversations and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import defaults as D
from loomspan.functions import text as T
from loomspan.operators import embed, reports, retrieve, vector_index
from loomspan.plans import fixtures as X
from loomspan.sources.scratch import scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return X.spark_sql(spark, d, X.VECTORS)


def _intents(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.detect_intent(X.spark_sql(spark, d, X.QUERIES))


def _budgets(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.store_budgets(retrieve.weighted_limits(_intents(spark, d)))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.retrieve(_budgets(spark, d), _vectors(spark, d))


_KEYWORDS = ", ".join(f"({i}, '{intent}', '{k}')" for i, (intent, ks) in enumerate(D.INTENT_KEYWORDS.items()) for k in ks)
_WEIGHTS = ", ".join(f"('{intent}', {i}, '{c}', {w})" for intent, ws in D.INTENT_WEIGHTS.items() for i, (c, w) in enumerate(zip(D.COLLECTIONS, ws)))
_CTE = f"""
WITH vectors AS ({X.duck(X.VECTORS)}), queries AS ({X.duck(X.QUERIES)}),
kw(ord, intent, keyword) AS (VALUES {_KEYWORDS}), wt(intent, c_ord, collection, weight) AS (VALUES {_WEIGHTS}),
scored AS (SELECT query_id, ord, kw.intent, count(*) AS score FROM queries JOIN kw ON contains(lower(text), keyword) GROUP BY ALL),
best AS (SELECT query_id, arg_min(intent, ord) AS intent, any_value(score) AS score FROM scored s WHERE score = (SELECT max(score) FROM scored t WHERE t.query_id = s.query_id) GROUP BY query_id),
intents AS (SELECT q.*, coalesce(b.intent, 'general') AS intent, coalesce(b.score, 0) AS score FROM queries q LEFT JOIN best b USING (query_id)),
limits AS (SELECT i.*, c_ord, collection, weight, CAST(round_even(3 * weight, 0) AS INT) AS limit_k FROM intents i JOIN wt USING (intent)),
budgets AS (SELECT l.*, s_ord - 1 AS s_ord, repo_name, CAST(limit_k // len(stores) + CASE WHEN s_ord - 1 < limit_k % len(stores) THEN 1 ELSE 0 END AS INT) AS budget
  FROM limits l, unnest(stores) WITH ORDINALITY AS u(repo_name, s_ord)),
near AS (SELECT b.query_id, b.intent, b.c_ord, b.s_ord, b.budget, v.* EXCLUDE (embedding), list_sum(list_transform(list_zip(b.embedding, v.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)) AS distance
  FROM budgets b JOIN vectors v ON b.collection = v.collection AND b.repo_name = v.repo_name WHERE b.budget > 0),
kept AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id, collection, repo_name ORDER BY distance, node_id) <= budget),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, c_ord, s_ord, node_id) AS rank FROM kept QUALIFY rank <= 10)
"""


@query
def retrieve_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("query_id", "rank", "intent", "collection", "repo_name", "node_id", F.round("distance", 6).alias("distance"))


ORACLES["retrieve_topk"] = _CTE + "SELECT query_id, rank, intent, collection, repo_name, node_id, round(distance, 6) AS distance FROM hits"


@query
def retrieval_log(spark: SparkSession, d: str) -> DataFrame:
    """A log event a question: its sources as cited. Questions without one store are there too."""
    asked = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("query_id"))
    turns = _intents(spark, d).select("query_id", F.col("text").alias("query"), "intent", "stores", F.lit("m").alias("model"), asked.alias("asked_at"), (asked + F.expr("INTERVAL '0.25' SECOND")).alias("answered_at"), F.array(F.lit(1)).alias("cited"))
    events = reports.retrieval_log(turns, _hits(spark, d))
    files = F.array_join(F.transform("sources", lambda x: F.concat(x["citation_index"].cast("string"), F.lit(":"), x["collection"], F.lit(":"), x["file_path"], F.lit(":"), x["start_line"].cast("string"))), ",")
    return events.select("query_id", "event", "query", "intent", "source_count", "no_sources", F.array_join(F.transform("cited_indices", lambda x: x.cast("string")), ",").alias("cited"), "model", "elapsed_seconds", F.coalesce(files, F.lit("")).alias("sources"))


ORACLES["retrieval_log"] = _CTE + """, s AS (SELECT query_id, count(*) AS n, string_agg(rank || ':' || collection || ':' || file_path || ':' || start_line, ',' ORDER BY rank) AS sources FROM hits GROUP BY 1)
SELECT i.query_id, 'chat_turn' AS event, i.text AS query, i.intent, CAST(coalesce(n, 0) AS INT) AS source_count, n IS NULL AS no_sources, CASE WHEN n IS NULL THEN '' ELSE '1' END AS cited, CASE WHEN n IS NULL THEN '' ELSE 'm' END AS model,
  CAST(0.25 AS DOUBLE) AS elapsed_seconds, coalesce(sources, '') AS sources FROM intents i LEFT JOIN s ON s.query_id = i.query_id"""


@query
def query_intent(spark: SparkSession, d: str) -> DataFrame:
    return _intents(spark, d).select("query_id", "intent", "score")


ORACLES["query_intent"] = _CTE + "SELECT query_id, intent, score FROM intents"


@query
def weighted_limits(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.weighted_limits(_intents(spark, d)).select("query_id", "intent", "collection", "limit_k")


ORACLES["weighted_limits"] = _CTE + "SELECT query_id, intent, collection, limit_k FROM limits WHERE limit_k > 0"


@query
def store_budgets(spark: SparkSession, d: str) -> DataFrame:
    return _budgets(spark, d).select("query_id", "collection", "repo_name", "budget")


ORACLES["store_budgets"] = _CTE + "SELECT query_id, collection, repo_name, budget FROM budgets WHERE budget > 0"


@query
def retrieve_debug(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.retrieve_debug(_budgets(spark, d), _vectors(spark, d))


ORACLES["retrieve_debug"] = _CTE + """, counts AS (SELECT collection, repo_name, count(*) AS n FROM vectors GROUP BY ALL)
SELECT query_id, collection, repo_name, budget AS requested, coalesce(n, 0) AS available, least(coalesce(n, 0), budget) AS returned FROM budgets LEFT JOIN counts USING (collection, repo_name) WHERE budget > 0"""


@query
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.build_context(_hits(spark, d))


_CONTEXT = """, ctx AS (SELECT query_id, left(string_agg('[' || rank || '] repo=' || repo_name || ' file=' || file_path || ' lines=' || start_line || '-' || end_line || ' type=' || node_type || ' lang=' || language || ' symbol=' || symbol || ' collection=' || collection || chr(10) || document, chr(10) || chr(10) ORDER BY rank), 12000) AS context FROM hits GROUP BY query_id)
"""
ORACLES["context_blocks"] = _CTE + _CONTEXT + "SELECT query_id, context FROM ctx"


@query
def history_window(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.history_window(X.spark_sql(spark, d, "SELECT conv_id, turn, role, text FROM {conversations}"), 3)


ORACLES["history_window"] = "SELECT * FROM (SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) WHERE role IN ('user', 'assistant', 'system')"

_SYSTEM = "Answer from the retrieved context; say so if it is not enough."
_RULES = "Cite sources as [n]."


@query
def prompt_messages(spark: SparkSession, d: str) -> DataFrame:
    """Prompts flattened to (query_id, n, role, content)."""
    hits = _hits(spark, d)
    asked = _intents(spark, d).select("query_id", "intent", "stores", F.expr("query_id div 100").alias("conv_id"))
    history = retrieve.history_window(X.spark_sql(spark, d, "SELECT conv_id, turn, role, text FROM {conversations}"), 3)
    prompts = retrieve.build_prompts(asked.join(retrieve.build_context(hits), "query_id", "left"), history, _SYSTEM, _RULES)
    return prompts.select("query_id", F.posexplode("messages").alias("n", "m")).select("query_id", "n", "m.role", "m.content")


ORACLES["prompt_messages"] = _CTE + _CONTEXT + f""", hist AS (SELECT * FROM ({ORACLES["history_window"]})),
rows AS (
  SELECT query_id, 0 AS g, 0 AS o, 'system' AS role, '{_SYSTEM}' AS content FROM intents UNION ALL
  SELECT query_id, 1, 0, 'system', '{_RULES}' FROM intents UNION ALL
  SELECT query_id, 2, 0, 'system', 'Detected retrieval intent: ' || intent FROM intents UNION ALL
  SELECT query_id, 3, 0, 'system', 'Active repo stores: ' || array_to_string(stores, ', ') FROM intents UNION ALL
  SELECT query_id, 4, 0, 'system', 'Retrieved context:' || chr(10) || context FROM ctx UNION ALL
  SELECT i.query_id, 5, turn, role, coalesce(h.text, '') FROM intents i JOIN hist h ON h.conv_id = i.query_id // 100
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY g, o) - 1 AS INT) AS n, role, content FROM rows"""

_ANSWERS = "SELECT conv_id, turn, 'answer ' || CASE turn % 4 WHEN 0 THEN '[1] and [2]' WHEN 1 THEN 'see [9]' WHEN 2 THEN 'none  ' ELSE '[2][2]' END AS response, CAST(conv_id % 5 AS INT) AS source_count, CASE WHEN conv_id % 2 = 0 THEN 'audit' ELSE 'general' END AS intent FROM {conversations}"


@query
def citations_enforced(spark: SparkSession, d: str) -> DataFrame:
    answers = X.spark_sql(spark, d, _ANSWERS).withColumn("stores", F.array(F.lit("a"), F.lit("b")))
    out = retrieve.finish_turns(answers)
    return out.select("conv_id", "turn", "final", "no_sources", F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited"))


ORACLES["citations_enforced"] = f"""
WITH a AS ({X.duck(_ANSWERS)}), c AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(response, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INT)), lambda n: n >= 1 AND n <= source_count))) AS ok FROM a),
f AS (SELECT *, CASE WHEN source_count <= 0 THEN 'No indexed code or context was found for the selected repo store(s): a, b. Run the embedding job for that repo and ask again. Detected intent: ' || intent || '.'
  WHEN len(ok) > 0 THEN response ELSE rtrim(response) || chr(10) || chr(10) || 'Citations: ' || array_to_string(list_transform(range(1, least(source_count, 3) + 1), lambda i: '[' || i || ']'), ' ') END AS final FROM c)
SELECT conv_id, turn, final, source_count <= 0 AS no_sources, CASE WHEN source_count <= 0 THEN '' WHEN len(ok) > 0 THEN array_to_string(ok, ',') ELSE array_to_string(range(1, least(source_count, 3) + 1), ',') END AS cited FROM f"""


@query
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.collection_counts(_vectors(spark, d))


ORACLES["collection_counts"] = _CTE + f"SELECT c.collection, count(v.node_id) AS n FROM (VALUES {', '.join(f'({c!r})' for c in D.COLLECTIONS)}) c(collection) LEFT JOIN vectors v ON v.collection = c.collection GROUP BY c.collection"


@query
def store_discovery(spark: SparkSession, d: str) -> DataFrame:
    return reports.store_discovery(_vectors(spark, d))


ORACLES["store_discovery"] = _CTE + "SELECT DISTINCT trim(repo_name) AS repo_name FROM vectors ORDER BY 1 LIMIT 200"

_NAMES = "SELECT doc_id, ' ' || source || ', ' || lang || ',,' || source || ' ,x' AS names FROM {documents}"


@query
def store_name_list(spark: SparkSession, d: str) -> DataFrame:
    return reports.store_names(X.spark_sql(spark, d, _NAMES)).select("doc_id", F.array_join("stores", "|").alias("stores"))


ORACLES["store_name_list"] = "SELECT doc_id, array_to_string(CASE WHEN source = lang THEN [source, 'x'] ELSE [source, lang, 'x'] END, '|') AS stores FROM documents"

_CALLS = """SELECT event_id AS call_id, CASE WHEN event_id % 2 = 0 THEN 'chat' ELSE 'embedding' END AS source, CASE event_id % 4
 WHEN 0 THEN '{{"usage":{{"prompt_tokens":' || user_id || ',"completion_tokens":' || (event_id % 50) || '}}}}' WHEN 1 THEN '{{"usage":{{"input_tokens":' || user_id || ',"total_tokens":' || (user_id + 5) || '}}}}'
 WHEN 2 THEN '{{"prompt_eval_count":' || user_id || ',"eval_count":-3}}' ELSE '{{}}' END AS body FROM {events}"""


@query
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    return reports.token_usage(X.spark_sql(spark, d, _CALLS))


ORACLES["token_usage"] = """
WITH c AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'chat' ELSE 'embedding' END AS source, event_id % 4 AS k, user_id AS u, event_id AS e FROM events),
t AS (SELECT source, CASE WHEN k < 3 THEN u ELSE 0 END AS p, CASE WHEN k = 0 THEN e % 50 ELSE 0 END AS a, CASE k WHEN 0 THEN u + e % 50 WHEN 1 THEN u + 5 WHEN 2 THEN u ELSE 0 END AS s, k = 3 AS none FROM c)
SELECT source, count(*) AS calls, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(a) AS BIGINT) AS completion_tokens, CAST(sum(s) AS BIGINT) AS total_tokens, count(*) FILTER (none) AS missing_usage FROM t GROUP BY ROLLUP (source)"""

_JOBS = "SELECT event_id, 'job' || user_id AS job_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'starting' ELSE 'running' END AS status, CAST(ts AS TIMESTAMP) AS updated_at FROM {events}"


@query
def job_listing(spark: SparkSession, d: str) -> DataFrame:
    events = X.spark_sql(spark, d, _JOBS)
    now = events.agg(F.max("updated_at")).first()[0]
    out = retrieve.job_listing(events, 50, F.lit(now) - F.expr("INTERVAL 1 HOUR"))
    return out.select("job_id", "status", F.unix_micros("updated_at").alias("updated_us"), "error")


ORACLES["job_listing"] = f"""
WITH e AS ({X.duck(_JOBS)}), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, event_id DESC) = 1),
m AS (SELECT *, status = 'running' AND updated_at < (SELECT max(updated_at) FROM e) - INTERVAL 1 HOUR AS dead FROM l)
SELECT job_id, CASE WHEN dead THEN 'failed' ELSE status END AS status, epoch_us(updated_at) AS updated_us, CASE WHEN dead THEN 'worker exited unexpectedly' END AS error FROM m ORDER BY updated_at DESC, job_id LIMIT 50"""


@query
def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return embed.hashed_embeddings(X.spark_sql(spark, d, "SELECT doc_id, text FROM {documents}"), "doc_id", "text", 64)


@query
def retrieve_cells(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d).select("node_id", "embedding")
    queries = X.spark_sql(spark, d, "SELECT vec_id AS query_id, embedding FROM {embeddings} WHERE vec_id % 100 = 0")
    celled, centres = retrieve.cells(vectors, 16)
    return retrieve.retrieve_cells(queries, celled, centres, k=10, probe=6)


@query
def retrieve_index(spark: SparkSession, d: str) -> DataFrame:
    """The questions of ``retrieve_cells`` put to a persisted index."""
    path = scratch(spark, "vector-index")
    vector_index.build(_vectors(spark, d).select("node_id", "embedding"), path)
    queries = X.spark_sql(spark, d, "SELECT vec_id AS query_id, embedding FROM {embeddings} WHERE vec_id % 100 = 0")
    return vector_index.search(queries, path).withColumnRenamed("id", "node_id")


@query
def retrieval_log_health(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the health stream."""
    from loomspan.streaming import streams

    log = X.spark_sql(spark, d, "SELECT CAST(ts AS TIMESTAMP) AS ts, event_type AS intent, CAST(event_id % 4 AS INT) AS source_count, CAST(value AS DOUBLE) AS elapsed_seconds FROM {events}")
    out = streams.retrieval_health(log)
    return out.select(F.unix_micros("window_start").alias("window_us"), "intent", "turns", "no_source", F.round("mean_seconds", 6).alias("mean_seconds"))


ORACLES["retrieval_log_health"] = "SELECT (epoch_us(ts) // 600000000) * 600000000 AS window_us, event_type AS intent, count(*) AS turns, count(*) FILTER (event_id % 4 = 0) AS no_source, round(avg(CAST(value AS DOUBLE)), 6) AS mean_seconds FROM events GROUP BY ALL"
