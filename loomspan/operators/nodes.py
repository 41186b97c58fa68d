"""The node table: identity, clamping, dedup, routing, review candidates, proposals, plan steps, stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import defaults as D
from loomspan.functions import text as T
from loomspan.sources.corpus import snippet, with_lines

FILE = ["repo_name", "file_path"]
PROPOSAL = "struct<final:struct<nodes:array<struct<node_type:string,symbol:string,start_line:string,end_line:string,confidence:string,why_relevant:string,control_area:string,severity:string,evidence:string>>>>"


def node_id(kind: Column, path: Column, symbol: Column, start: Column, stop: Column) -> Column:
    return F.concat(kind, F.lit("::"), path, F.lit("::"), F.coalesce(F.nullif(symbol, F.lit("")), F.lit("NA")), F.lit("::"), start.cast("string"), F.lit("-"), stop.cast("string"))


def clamped(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes with their lines inside their file, and their id; ``sizes``: (file, n_lines)."""
    j = nodes.join(sizes.select(*FILE, "n_lines"), FILE)
    start = F.greatest(F.col("start_line"), F.lit(1))
    stop = F.least(F.greatest(F.col("end_line"), start), F.greatest("n_lines", F.lit(1)))
    j = j.withColumns({"start_line": start, "end_line": stop}).drop("n_lines")
    return j.withColumn("node_id", node_id(F.col("node_type"), F.col("file_path"), F.col("symbol"), F.col("start_line"), F.col("end_line")))


def with_text(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes with text and hash; that of a file node is cut. The one step at which texts meet nodes."""
    j = nodes.join(with_lines(files).select(*FILE, "lines"), FILE)
    whole = snippet(F.col("lines"), F.col("start_line"), F.col("end_line"))
    j = j.withColumn("text", F.when(F.col("node_type") == "file", F.left(whole, F.lit(D.NODE_CHARS))).otherwise(whole)).drop("lines")
    return j.withColumn("content_hash", T.sha256(F.col("text")))


def first_wins(nodes: DataFrame) -> DataFrame:
    """One row a (repo, node id): the first in emission order."""
    order = Window.partitionBy("repo_name", "node_id").orderBy("emit_seq")
    return nodes.withColumn("r", F.row_number().over(order)).where(F.col("r") == 1).drop("r")


def file_confidence(n: Column) -> Column:
    return F.when(n >= 6, 0.92).when(n >= 2, 0.82).when(n == 1, 0.7).otherwise(0.5)


def collection(node_type: Column) -> Column:
    pairs = [F.lit(x) for c, types in D.ROUTING.items() for t in types for x in (t, c)]
    return F.element_at(F.create_map(*pairs), node_type)


def routed(nodes: DataFrame) -> DataFrame:
    """Nodes that belong to a collection, with it."""
    return nodes.withColumn("collection", collection(F.col("node_type"))).where(F.col("collection").isNotNull())


def embed_text(meta: dict[str, Column] | None = None) -> Column:
    """Text to embed: a header of the fields present, then the body."""
    m = meta or {}

    def field(label: str, value: Column | None) -> Column:
        return F.lit(None).cast("string") if value is None else F.concat(F.lit(label), F.nullif(value.cast("string"), F.lit("")))

    base = [field("TYPE: ", F.col("node_type")), field("LANG: ", F.col("language")), field("FILE: ", F.col("file_path")), F.concat(F.lit("LINES: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")), field("SYMBOL: ", F.col("symbol"))]
    body = F.left("text", F.lit(D.NODE_CHARS))
    doc = F.concat_ws("\n", *base, *[field(label, m.get(k)) for k, label in (("doc_title", "DOC_TITLE: "), ("section_path", "SECTION_PATH: "), ("section_title", "SECTION_TITLE: "), ("doc_format", "DOC_FORMAT: "), ("code_language", "CODE_LANG: "))], F.concat(F.lit("DOC_CONTENT:\n"), body))
    edge = F.concat_ws("\n", *base, *[field(label, m.get(k)) for k, label in (("caller", "CALLER: "), ("callee", "CALLEE: "), ("relation", "RELATION: "))], F.concat(F.lit("CODE_CONTEXT:\n"), body))
    code = F.concat_ws("\n", *base, field("WHY: ", m.get("why_relevant")), F.concat(F.lit("CODE:\n"), body))
    return F.when(F.col("node_type").isin("doc", "doc_code"), doc).when(F.col("node_type") == "call_edge", edge).otherwise(code)


def vector_record() -> Column:
    meta = F.struct("repo_name", "file_path", "start_line", "end_line", "node_type", "language", F.coalesce("symbol", F.lit("")).alias("symbol"), F.col("confidence").cast("double").alias("confidence"))
    return F.struct(F.left("text", F.lit(D.DOC_CHARS)).alias("document"), meta.alias("metadata"))


def review_candidates(files: DataFrame, errors: DataFrame, *, enabled: bool = True, below: float = 0.70, exts: list[str] | None = None) -> DataFrame:
    """Files to review, with the reason: a parse error, or low confidence in an important place."""
    low = F.lower("file_path")
    important = F.greatest(*[F.contains(low, F.lit(h)) for h in D.IMPORTANT_DIRS], *[F.contains(F.lower("text"), F.lit(w)) for w in D.IMPORTANT_WORDS])
    marked = files.join(errors.select(*FILE).distinct().withColumn("err", F.lit(True)), FILE, "left")
    weak = F.lit(enabled) & (F.col("confidence") < below) & (F.col("ext").isin(exts) if exts else F.lit(True)) & important
    return marked.withColumn("reason", F.when(F.col("err"), "parse_error").when(weak, "low_confidence")).where(F.col("reason").isNotNull()).select(*FILE, "confidence", "reason")


def security_eligible(files: DataFrame, exts: list[str], *, enabled: bool = True) -> DataFrame:
    """Files that a security pass looks at: those with one of the extensions, none if the pass is off."""
    return files.where(F.lit(enabled) & F.col("ext").isin(*exts)).select(*FILE, "ext", "lang")


def unseen(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Proposed nodes whose id is not known in their repository; of several with one id the first by lines and type."""
    keys = ["repo_name", "node_id"]
    new = proposed.join(known.select(*keys), keys, "left_anti")
    rest = [c for c in new.columns if c not in keys]
    order = F.struct("start_line", "end_line", "node_type", "content_hash")
    return new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("n")).select(*keys, "n.*")


def proposed_nodes(proposals: DataFrame, files: DataFrame, *, source: str, allowed: list[str] | None = None) -> DataFrame:
    """Nodes of JSON proposals (file, agent_json): castable lines clamped to the file, others dropped."""
    items = proposals.select(*FILE, F.explode(F.from_json("agent_json", PROPOSAL)["final"]["nodes"]).alias("n")).select(*FILE, "n.*")
    items = items.withColumns({"s": F.col("start_line").try_cast("int"), "e": F.col("end_line").try_cast("int")}).where(F.col("s").isNotNull() & F.col("e").isNotNull())
    j = items.join(with_lines(files).select(*FILE, "lines", "n_lines"), FILE)
    j = j.withColumns({"s": F.greatest("s", F.lit(1)), "e": F.least("e", "n_lines"), "node_type": F.coalesce("node_type", F.lit("unknown"))}).where(F.col("e") >= F.col("s"))
    if allowed:
        j = j.where(F.col("node_type").isin(allowed))
    text = snippet(F.col("lines"), F.col("s"), F.col("e"))
    clean = lambda c: F.coalesce(T.strip(F.col(c)), F.lit("")).alias(c)
    return j.select(*FILE, node_id(F.col("node_type"), F.col("file_path"), F.col("symbol"), F.col("s"), F.col("e")).alias("node_id"), "node_type", "symbol", F.col("s").alias("start_line"), F.col("e").alias("end_line"), T.sha256(text).alias("content_hash"), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.6)).alias("confidence"), clean("why_relevant"), clean("control_area"), clean("severity"), clean("evidence"), F.lit(source).alias("source"))


def plan_outputs(steps: DataFrame, files: DataFrame, max_hits: int = 50) -> DataFrame:
    """``(plan_id, step, tool, output, error)`` for steps read_lines and search_in_file; bad steps give their error.

    ``steps``: (plan_id, step, repo_name, file_path, tool, args map<string,string>).
    """
    a, b, pattern = F.col("args")["start_line"].try_cast("int"), F.col("args")["end_line"].try_cast("int"), F.col("args")["pattern"]
    error = F.when(F.col("args").isNull(), "invalid_args_type").when(~F.col("tool").isin("read_lines", "search_in_file"), "unknown_tool").when((F.col("tool") == "read_lines") & (a.isNull() | b.isNull()), "missing_or_invalid_args").when((F.col("tool") == "search_in_file") & pattern.isNull(), "missing_or_invalid_args")
    j = steps.withColumns({"a": a, "b": b, "pattern": pattern, "error": error}).join(with_lines(files).select(*FILE, "lines", "n_lines"), FILE, "left")
    read = snippet(F.col("lines"), F.greatest("a", F.lit(1)), F.least("b", "n_lines"))
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    hits = F.slice(F.filter(numbered, lambda x: F.regexp(x["line"], F.col("pattern"))), 1, max_hits)
    found = F.array_join(F.transform(hits, lambda x: F.concat(x["n"].cast("string"), F.lit(": "), F.left(T.strip(x["line"]), F.lit(300)))), "\n")
    output = F.when(F.col("error").isNotNull(), F.lit(None)).when(F.col("tool") == "read_lines", read).otherwise(found)
    return j.select("plan_id", "step", "tool", F.coalesce(output, F.when(F.col("error").isNull(), F.lit(""))).alias("output"), "error")


def stacks(root_files: DataFrame) -> DataFrame:
    """``(repo_name, stacks map, confidence)`` from the names of root files."""
    pairs = F.array(*[F.struct(F.lit(s).alias("stack"), F.lit(x).alias("signal")) for s, xs in D.STACK_SIGNALS.items() for x in xs])
    suffixes = F.array(*[F.struct(F.lit(s).alias("stack"), F.lit(x).alias("signal")) for s, xs in D.STACK_SUFFIXES.items() for x in xs])
    hit = F.concat(F.filter(pairs, lambda p: p["signal"] == F.col("name")), F.filter(suffixes, lambda p: F.endswith(F.col("name"), p["signal"])))
    found = root_files.select("repo_name", "name", F.explode(hit).alias("h")).select("repo_name", F.col("h.stack").alias("stack"), "name").distinct()
    by_stack = found.groupBy("repo_name", "stack").agg(F.array_sort(F.collect_list("name")).alias("evidence"))
    out = by_stack.groupBy("repo_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stack", "evidence")))).alias("stacks"), F.sum(F.size("evidence")).alias("n"))
    return out.select("repo_name", "stacks", F.least(F.lit(0.95), 0.4 + 0.15 * F.col("n")).alias("confidence"))
