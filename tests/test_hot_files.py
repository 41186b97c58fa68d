"""Files with very many nodes: as-of and covering joins stay linear, with the results of a plain search."""

import random
import time

from pyspark.sql import functions as F

from loomspan.operators import code, graph

NODE = "repo_name string, file_path string, node_type string, symbol string, start_line int, end_line int, emit_seq long"


def brute_chains(rows):
    out = []
    for f in {r[1] for r in rows}:
        of = lambda t: [r for r in rows if r[1] == f and r[2] == t]  # noqa: E731, B023
        for s in of("sensitive_op"):
            gs = [g for g in of("auth_guard") if g[5] <= s[4]]
            audits = [a for a in of("audit_log") if a[4] >= s[5]]
            if gs and audits:
                g = max(gs, key=lambda g: (g[5], -g[6]))
                a = min(audits, key=lambda a: (a[4], a[6]))
                out += [(f, f"{r[3]}->{s[3]}", min(x[4] for x in (r, g, s, a)), max(x[5] for x in (r, g, s, a)), g[3], a[3]) for r in of("route") if s[4] >= r[4]]
    return sorted(out)


def test_chains_equal_a_plain_search(spark):
    pick = random.Random(2)
    rows = []
    for i in range(300):
        start = pick.randrange(1, 30)
        rows.append(("r", f"f{i % 5}", pick.choice(["route", "auth_guard", "sensitive_op", "audit_log", "function"]), f"s{i}", start, start + pick.randrange(0, 5), i))
    got = graph.flow_chains(spark.createDataFrame(rows, NODE)).collect()
    part = lambda text, name: text.split(f"{name}: ")[1].split("\n")[0]
    assert sorted((r.file_path, r.symbol, r.start_line, r.end_line, part(r.text, "Security check"), part(r.text, "Audit log")) for r in got) == brute_chains(rows)


def test_a_file_with_very_many_guarded_operations(spark):
    n = 200_000
    kind = F.element_at(F.array(*map(F.lit, ("auth_guard", "sensitive_op", "audit_log"))), (F.col("id") % 3 + 1).cast("int"))
    nodes = spark.range(n).select(F.lit("r").alias("repo_name"), F.lit("f").alias("file_path"), F.when(F.col("id") == 0, "route").otherwise(kind).alias("node_type"), F.concat(F.lit("n"), "id").alias("symbol"), (F.col("id") + 1).cast("int").alias("start_line"), (F.col("id") + 1).cast("int").alias("end_line"), F.col("id").alias("emit_seq"))
    began = time.monotonic()
    chains = graph.flow_chains(nodes)
    assert chains.count() == len([i for i in range(n) if i % 3 == 1 and 3 <= i and i + 1 < n])
    assert time.monotonic() - began < 60


def test_a_file_with_very_many_routines_and_uses(spark):
    n = 10_000
    kinds = [F.concat(F.lit("create procedure p"), "k", F.lit(" as")), F.concat(F.lit("select * from t"), "k"), F.lit("where a = 1;"), F.concat(F.lit("update u"), "k", F.lit(" set a = 1;"))]
    rows = spark.range(4 * n).withColumn("k", F.floor(F.col("id") / 4).cast("string"))
    lines = rows.select(F.lit("r").alias("repo_name"), F.lit("f.sql").alias("file_path"), (F.col("id") + 1).cast("int").alias("line_no"), F.element_at(F.array(*kinds), (F.col("id") % 4 + 1).cast("int")).alias("line"))
    began = time.monotonic()
    edges = code.sql_lineage(lines).where("node_type = 'call_edge'")
    assert {r[0]: r[1] for r in edges.groupBy(F.substring("symbol", 1, 1)).count().collect()} == {"p": n, "q": n}
    assert edges.where("symbol = 'p7->t7'").count() == 1
    assert time.monotonic() - began < 60
