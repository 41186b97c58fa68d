"""Batch retrieval: intent, budgets, nearest vectors, context, prompts, citations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from loomspan.functions import defaults as D
from loomspan.functions import text as T
from loomspan.sources.scratch import scratch


def keyword_rows(df: DataFrame, keywords: dict[str, list[str]] | None = None) -> Column:
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(intent).alias("intent"), F.lit(k).alias("keyword")) for i, (intent, ks) in enumerate((keywords or D.INTENT_KEYWORDS).items()) for k in ks]
    return F.array(*rows)


def detect_intent(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, text, ...) plus ``intent`` and ``score``: most keywords contained, ties to the first intent.

    The keyword table is a constant, so the theta join is an array filter inside the row: no shuffle.
    """
    low = F.lower("text")
    order = list(D.INTENT_KEYWORDS)
    scores = [sum((F.contains(low, F.lit(k)).cast("int") for k in D.INTENT_KEYWORDS[i]), F.lit(0)) for i in order]
    best = F.greatest(*scores)
    intent = F.when(best == 0, F.lit("general"))
    for name, score in zip(order, scores):
        intent = intent.when(score == best, F.lit(name))
    return queries.withColumns({"intent": intent, "score": best})


SALTS = 32


def weighted_limits(intents: DataFrame, base: int = D.BASE_TOP_K) -> DataFrame:
    """A row for each (query, collection) with a positive limit; unknown intents use the general profile."""
    def profile(weights: list[float]) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("c_ord"), F.lit(c).alias("collection"), F.lit(w).alias("weight")) for i, (c, w) in enumerate(zip(D.COLLECTIONS, weights))])

    rows = profile(D.INTENT_WEIGHTS["general"])
    for name, weights in D.INTENT_WEIGHTS.items():
        rows = F.when(F.col("intent") == name, profile(weights)).otherwise(rows)
    out = intents.withColumn("w", F.explode(rows)).select("*", "w.*").drop("w")
    return out.withColumn("limit_k", T.weighted_limit(F.col("weight"), base)).where(F.col("limit_k") > 0)


def store_budgets(limits: DataFrame) -> DataFrame:
    """A row for each (query, collection, store) with a positive share of the collection's limit."""
    out = limits.select("*", F.posexplode("stores").alias("s_ord", "repo_name"))
    return out.withColumn("budget", T.split_budget(F.col("limit_k"), F.size("stores"), F.col("s_ord"))).where(F.col("budget") > 0)


def max_budget(base: int = D.BASE_TOP_K) -> int:
    return int(max(w for ws in D.INTENT_WEIGHTS.values() for w in ws) * base)


PAIRS = 1 << 16  # distances computed at once: they stay in a core's cache


def _by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: (places, matrix in double precision) of the vectors without nulls."""
    lists = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values, null = flat.to_numpy(zero_copy_only=False).astype(np.float64), flat.is_null().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    out = {}
    for n in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == n)
        places = starts[at][:, None] + np.arange(n)
        whole = ~null[places].any(axis=1)
        out[n] = at[whole], values[places[whole]]
    return out


def _first_k(row: np.ndarray, col: np.ndarray, distance: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the ``k[row]`` least distances, ties by column; not-a-number comes last."""
    order = np.lexsort((col, distance, row))
    row, col, distance = row[order], col[order], distance[order]
    first = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - first < k[row]
    return row[keep], col[keep], distance[keep]


def _nearest(q: np.ndarray, v: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of q, row of v, squared distance)``: the ``k`` nearest of each row of q, summed component by component as ``T.squared_l2`` does."""
    qt, vt = np.ascontiguousarray(q.T), np.ascontiguousarray(v.T)
    wide = max(1, min(len(v), 1024))
    high = max(1, PAIRS // wide)
    out = []
    with np.errstate(invalid="ignore", over="ignore"):
        for a in range(0, len(q), high):
            found, k_of = [], k[a : a + high]
            most = int(k_of.max())
            for b in range(0, len(v), wide):
                d = np.zeros((len(k_of), min(wide, len(v) - b)))
                part = np.empty_like(d)
                for x, y in zip(qt[:, a : a + high], vt[:, b : b + wide]):
                    np.subtract.outer(x, y, out=part)
                    np.multiply(part, part, out=part)
                    d += part
                if most < d.shape[1]:
                    kth = np.partition(d, most - 1, axis=1)[:, most - 1 : most]
                    row, col = np.nonzero((d <= kth) | np.isnan(kth))
                else:
                    row, col = (x.ravel() for x in np.indices(d.shape))
                row, col, distance = _first_k(row, col, d[row, col], k_of)
                found.append((row, col + b, distance))
            row, col, distance = _first_k(*map(np.concatenate, zip(*found)), k_of)
            out.append((row + a, col, distance))
    return tuple(map(np.concatenate, zip(*out)))


def _meet(q_vector: str, v_vector: str, v_id: str, limit: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        vectors = vectors.take(pc.sort_indices(vectors, [(v_id, "ascending")], null_placement="at_start"))
        k = queries[limit].to_numpy().astype(np.int64)
        none, parts = np.zeros(0, np.int64), []
        q_of, v_of = _by_length(queries[q_vector]), _by_length(vectors[v_vector])
        seen = np.zeros(queries.num_rows, bool)
        every = np.arange(vectors.num_rows)
        for n, (at, q) in [*q_of.items(), (-1, (none, None))]:
            if n < 0:
                at = np.flatnonzero(~seen)  # queries that have no distance from anything
            seen[at] = True
            places, v = v_of.get(n, (none, None))
            if len(at) and len(places):
                row, col, distance = _nearest(q, v, k[at])
                parts.append((at[row], places[col], distance, np.zeros(len(row), bool)))
            apart = np.setdiff1d(every, places, assume_unique=True)[: int(k.max(initial=0))]  # those without a distance come last
            if len(at) and len(apart):
                row, col = (x.ravel() for x in np.indices((len(at), len(apart))))
                keep = col < k[at][row]
                parts.append((at[row[keep]], apart[col[keep]], np.zeros(keep.sum()), np.ones(keep.sum(), bool)))
        row, col, distance, null = map(np.concatenate, zip(*parts)) if parts else (none, none, np.zeros(0), np.zeros(0, bool))
        left, right = queries.drop_columns([q_vector]).take(pa.array(row)), vectors.drop_columns([v_vector]).take(pa.array(col))
        columns = {c: left[c] for c in left.column_names} | {c: right[c] for c in right.column_names}
        return pa.table(columns | {"distance": pa.array(distance, mask=null)})

    return run


def nearest_in_groups(queries: DataFrame, vectors: DataFrame, keys: list[str], *, q_vector: str, v_vector: str, v_id: str, limit: str) -> DataFrame:
    """``queries`` with their ``limit`` nearest ``vectors`` (and more) of the same ``keys``: both without their vectors, plus ``distance``.

    Groups may be few and one may hold a third of the vectors, so each is dealt to SALTS parts, which queries meet one by
    one; every part gives its own ``limit`` nearest, so the nearest of all parts are among them. Distances of a part are
    computed exactly, PAIRS at a time. A pair without a distance (nulls, other lengths) comes after all others.
    """
    q = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    v = vectors.withColumn("salt", F.pmod(F.xxhash64(v_id), F.lit(SALTS)).cast("int"))
    fields = [f for f in q.schema if f.name != q_vector] + [f for f in v.schema if f.name not in (v_vector, *keys, "salt")]
    by = [*keys, "salt"]
    near = q.groupBy(*by).cogroup(v.groupBy(*by)).applyInArrow(_meet(q_vector, v_vector, v_id, limit), StructType(fields).add("distance", DoubleType()))
    return near.drop("salt")


def retrieve(budgets: DataFrame, vectors: DataFrame, cap: int = D.MAX_CONTEXT_CHUNKS) -> DataFrame:
    """``(query_id, rank, node_id, repo_name, collection, distance, ...)``: nearest within each budget, then the nearest ``cap``.

    ``budgets`` carries ``embedding`` of the query. The literal bound next to the row's own budget lets Spark's window
    group limit keep only candidates before the shuffle.
    """
    near = nearest_in_groups(budgets.withColumnRenamed("embedding", "q_embedding"), vectors, ["collection", "repo_name"], q_vector="q_embedding", v_vector="embedding", v_id="node_id", limit="budget")
    distance = F.asc_nulls_last("distance")
    inside = Window.partitionBy("query_id", "collection", "repo_name").orderBy(distance, "node_id")
    near = near.withColumn("r", F.row_number().over(inside)).where((F.col("r") <= max_budget()) & (F.col("r") <= F.col("budget")))
    overall = Window.partitionBy("query_id").orderBy(distance, "c_ord", "s_ord", "node_id")
    return near.withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= cap).drop("r")


def retrieve_debug(budgets: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(query_id, collection, repo_name, requested, available, returned)`` for each budget."""
    counts = vectors.groupBy("collection", "repo_name").agg(F.count(F.lit(1)).alias("available"))
    out = budgets.join(counts, ["collection", "repo_name"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return out.select("query_id", "collection", "repo_name", F.col("budget").alias("requested"), "available", F.least("available", "budget").alias("returned"))


def annotate(hits: DataFrame) -> DataFrame:
    return hits.withColumn("citation", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def build_context(hits: DataFrame, max_chars: int = D.MAX_CONTEXT_CHARS) -> DataFrame:
    """``(query_id, context)``: cited blocks in order, cut to ``max_chars``."""
    known = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d))
    block = F.concat(
        F.lit("["), F.col("citation").cast("string"), F.lit("] repo="), known("repo_name", "unknown"), F.lit(" file="), known("file_path", "unknown"),
        F.lit(" lines="), known("start_line", "?"), F.lit("-"), known("end_line", "?"), F.lit(" type="), known("node_type", "unknown"),
        F.lit(" lang="), known("language", "unknown"), F.lit(" symbol="), known("symbol", ""), F.lit(" collection="), known("collection", "unknown"), F.lit("\n"), T.strip(known("document", "")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("citation", block.alias("b"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n")
    return annotate(hits).groupBy("query_id").agg(joined.alias("all")).select("query_id", F.left("all", F.lit(max_chars)).alias("context"))


def history_window(turns: DataFrame, n: int = D.HISTORY) -> DataFrame:
    """The last ``n`` turns of each conversation, then only the known roles."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    out = turns.withColumn("r", F.row_number().over(last)).where(F.col("r") <= n)
    return out.where(F.col("role").isin("user", "assistant", "system")).drop("r")


def build_prompts(prompts: DataFrame, history: DataFrame, system_prompt: str, citation_rules: str) -> DataFrame:
    """``(query_id, messages)``: four system messages, the context if any, then the history in order."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    fixed = F.array(message("system", F.lit(system_prompt)), message("system", F.lit(citation_rules)), message("system", F.concat(F.lit("Detected retrieval intent: "), "intent")), message("system", F.concat(F.lit("Active repo stores: "), F.array_join("stores", ", "))))
    context = F.when(T.strip(F.coalesce("context", F.lit(""))) != "", F.array(message("system", F.concat(F.lit("Retrieved context:\n"), "context")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    past = history.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("h"))
    past = past.withColumn("h", F.transform("h", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    out = prompts.join(past, "conv_id", "left")
    return out.select("query_id", F.concat(fixed, context, F.coalesce("h", F.array().cast("array<struct<role:string,content:string>>"))).alias("messages"))


def finish_turns(answers: DataFrame) -> DataFrame:
    """``answers`` (response, source_count, intent, stores) plus the final text, its citations and the no-source flag."""
    none = F.col("source_count") <= 0
    final = F.when(none, T.no_source_answer(F.col("intent"), F.col("stores"))).otherwise(T.ensure_citations(F.col("response"), F.col("source_count")))
    return answers.withColumns({"final": final, "no_sources": none}).withColumn("cited", T.citations(F.col("final"), F.col("source_count")))


def job_listing(events: DataFrame, limit: int, stale_before: Column) -> DataFrame:
    """Latest state of each job, newest first; one left running since before ``stale_before`` counts as failed."""
    last = events.groupBy("job_id").agg(F.max_by(F.struct("status", "updated_at"), F.struct("updated_at", "event_id")).alias("s")).select("job_id", "s.*")
    dead = (F.col("status") == "running") & (F.col("updated_at") < stale_before)
    error = F.when(dead, F.lit("worker exited unexpectedly"))
    return last.withColumns({"error": error, "status": F.when(dead, F.lit("failed")).otherwise(F.col("status"))}).orderBy(F.desc("updated_at"), "job_id").limit(max(1, limit))


def cells(vectors: DataFrame, k: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """K-means cells: (vectors plus ``cell``, centroids (cell, centroid)); k rows of centroids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    with_v = vectors.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, maxIter=10, featuresCol="features", predictionCol="cell").fit(with_v)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centroid array<double>")
    return model.transform(with_v).drop("features"), centres


def retrieve_cells(queries: DataFrame, celled: DataFrame, centres: DataFrame, k: int, probe: int) -> DataFrame:
    """``(query_id, rank, node_id, distance)``: the exact ``k`` nearest, found from the ``probe`` nearest cells outwards.

    The first cells bound the k-th distance. Of the others, only cells that can hold a vector within that
    bound (by the distance of their centroid less their radius) are searched, so no neighbour is lost.
    """
    wide = celled.join(F.broadcast(centres), "cell").groupBy("cell").agg(F.sqrt(F.max(T.squared_l2(F.col("embedding"), F.col("centroid")))).alias("radius"))
    n_cells = F.broadcast(centres.join(wide, "cell"))  # k rows; empty cells hold nothing to find
    to_cell = queries.crossJoin(n_cells).withColumn("d", T.squared_l2(F.col("embedding"), F.col("centroid")))
    by_cell = to_cell.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "cell"))).select("query_id", "cell", F.col("embedding").alias("q"), "d", "radius", "r")

    def nearest(cells_of: DataFrame) -> DataFrame:
        asked = cells_of.select("query_id", "cell", "q", F.lit(k).alias("limit"))
        return best(nearest_in_groups(asked, celled.select("cell", "node_id", "embedding"), ["cell"], q_vector="q", v_vector="embedding", v_id="node_id", limit="limit"))

    def best(hits: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "node_id"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "node_id", "distance")

    path = scratch(queries.sparkSession, "cell-hits")
    nearest(by_cell.where(F.col("r") <= probe)).write.parquet(path)
    first = queries.sparkSession.read.parquet(path)
    bound = first.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
    gap = F.greatest(F.sqrt("d") - F.col("radius"), F.lit(0.0)) * (1 - 1e-9)  # rounding never closes a cell
    may_hold = F.col("bound").isNull() | (gap * gap <= F.col("bound"))
    rest = by_cell.where(F.col("r") > probe).join(bound, "query_id", "left").where(may_hold)
    return best(first.unionByName(nearest(rest)))
