"""Call edges and flow chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import defaults as D
from loomspan.functions import text as T

FILE = ["repo_name", "file_path"]
# Fixed value: a name before an opening bracket.
CALL = r"(?<![A-Za-z0-9_])([A-Za-z_]\w*(?:\.[A-Za-z_]\w*){0,2})\s*\("


def call_tokens(lines: DataFrame) -> DataFrame:
    """``(file, line_no, pos, callee)``: names before '(' that are not keywords."""
    found = lines.select(*FILE, "line_no", F.posexplode(F.regexp_extract_all("line", F.lit("(?U)" + CALL), F.lit(1))).alias("pos", "callee"))
    return found.where(~F.lower(T.leaf(F.col("callee"))).isin(D.CALL_SKIP))


BLOCK_LINES = 64


def within(ranges: DataFrame, rows: DataFrame, start: Column, stop: Column) -> DataFrame:
    """``ranges`` joined with the rows of their file whose line_no lies in [start, stop].

    Both sides are dealt to blocks of lines, so a range meets the rows of its own blocks only: work
    follows the lengths of ranges, not ranges times rows of a file.
    """
    block = lambda x: F.floor(x / BLOCK_LINES)
    dealt = ranges.withColumns({"lo": start, "hi": stop}).where(F.col("hi") >= F.col("lo")).withColumn("block", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi")))))
    met = dealt.join(rows.withColumn("block", block(F.col("line_no"))), [*FILE, "block"])
    return met.where(F.col("line_no").between(F.col("lo"), F.col("hi"))).drop("block", "lo", "hi")


def scoped_calls(scopes: DataFrame, tokens: DataFrame, most: int = D.MAX_CALLEES) -> DataFrame:
    """``(file, caller, start_line, callee, line_no)``: first appearance of each callee in a scope, the first ``most`` a scope.

    ``scopes``: (file, symbol, start_line, end_line).
    """
    s = scopes.select(*FILE, F.col("symbol").alias("caller"), "start_line", "end_line", F.when(F.col("end_line") > F.col("start_line"), F.col("start_line") + 1).otherwise(F.col("start_line")).alias("from_line"))
    own = F.lower(T.leaf(F.col("caller"))) == F.lower(T.leaf(F.col("callee")))
    inside = within(s, tokens, F.col("from_line"), F.col("end_line")).where(~own)
    first = inside.groupBy(*FILE, "caller", "start_line", "callee").agg(F.min(F.struct("line_no", "pos")).alias("at"))
    order = Window.partitionBy(*FILE, "caller", "start_line").orderBy("at")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select(*FILE, "caller", "start_line", "callee", F.col("at.line_no").alias("line_no"))


def edge_nodes(edges: DataFrame, language: Column, confidence: float = 0.72) -> DataFrame:
    symbol = F.concat("caller", F.lit("->"), "callee")
    out = edges.select(*FILE, language.alias("language"), F.lit("call_edge").alias("node_type"), symbol.alias("symbol"), F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.lit(confidence).alias("confidence"))
    return out.dropDuplicates([*FILE, "symbol", "start_line"])


def _latest(ops: DataFrame, marks: DataFrame, at: str, mark_at: str, name: str, *, back: bool) -> DataFrame:
    """``ops`` plus ``name``: the mark at or before each (at or after, if ``back``), the first emitted of several at one place.

    Both sides are laid in one order and a running window carries the latest mark on, so work is linear in their number.
    """
    rank = F.col("place").desc() if back else F.col("place").asc()
    laid = ops.withColumns({"place": F.col(at), "is_op": F.lit(1), "seq": F.lit(None).cast("bigint")}).unionByName(
        marks.select(*FILE, F.struct("symbol", "start_line", "end_line").alias("mark"), F.col(mark_at).alias("place"), F.lit(0).alias("is_op"), F.col("emit_seq").cast("bigint").alias("seq")), allowMissingColumns=True
    )
    order = Window.partitionBy(*FILE).orderBy(rank, "is_op", F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = laid.withColumn(name, F.last("mark", ignorenulls=True).over(order)).where(F.col("is_op") == 1)
    return found.drop("place", "is_op", "seq", "mark")


def flow_chains(nodes: DataFrame) -> DataFrame:
    """Route -> nearest guard before -> sensitive operation -> nearest audit after, a file at a time.

    Guards and audits meet operations in two running windows; only routes meet operations in a join, whose rows are the result.
    """
    of = lambda kind: nodes.where(F.col("node_type") == kind).select(*FILE, "symbol", "start_line", "end_line", "emit_seq")
    ops = of("sensitive_op").select(*FILE, *[F.col(c).alias(f"s_{c}") for c in ("symbol", "start_line", "end_line")])
    guarded = _latest(ops, of("auth_guard"), "s_start_line", "end_line", "g", back=False).where("g IS NOT NULL")
    safe = _latest(guarded, of("audit_log"), "s_end_line", "start_line", "a", back=True).where("a IS NOT NULL")
    route = of("route").select(*FILE, *[F.col(c).alias(f"r_{c}") for c in ("symbol", "start_line", "end_line")])
    chain = route.join(safe, FILE).where(F.col("s_start_line") >= F.col("r_start_line"))
    r_name = F.coalesce("r_symbol", F.concat(F.lit("route@"), "r_start_line"))
    s_name = F.coalesce("s_symbol", F.concat(F.lit("sensitive@"), "s_start_line"))
    g_name, a_name = F.coalesce("g.symbol", F.lit("auth_guard")), F.coalesce("a.symbol", F.lit("audit_log"))
    text = F.concat(F.lit("Entrypoint: "), r_name, F.lit("\nSecurity check: "), g_name, F.lit("\nSensitive op: "), s_name, F.lit("\nAudit log: "), a_name)
    start = F.least("r_start_line", "g.start_line", "s_start_line", "a.start_line")
    stop = F.greatest("r_end_line", "g.end_line", "s_end_line", "a.end_line")
    return chain.select(*FILE, F.concat(r_name, F.lit("->"), s_name).alias("symbol"), start.alias("start_line"), stop.alias("end_line"), text.alias("text"), F.lit(0.82).alias("confidence"))
