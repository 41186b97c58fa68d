"""Markdown, plain documents and configuration: headings, sections, fences, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import spans
from loomspan.sources.corpus import snippet, with_lines

FILE = ["repo_name", "file_path"]
# What a heading and a fence look like.
HEADING = r"(?U)^\s*+(#{1,6})\s++(\S(?:.*\S)?)\s*$"
FENCE = r"(?U)^\s*(```|~~~)\s*([A-Za-z0-9_+.\-#]*)"


def chunks(files: DataFrame, size: int, overlap: int, *, kind: str, confidence: float) -> DataFrame:
    """Overlapping line chunks of whole files, without a shuffle."""
    rows = with_lines(files).where(F.col("n_lines") > 0).withColumn("c", F.explode(spans.chunk_ranges(F.lit(1), F.col("n_lines"), size, overlap)))
    rows = rows.select(*FILE, "lang", F.col("c.a").alias("start_line"), F.col("c.b").alias("end_line"), snippet(F.col("lines"), F.col("c.a"), F.col("c.b")).alias("text"))
    node_id = F.concat(F.lit(f"{kind}::"), "file_path", F.lit("::"), "start_line", F.lit("-"), "end_line")
    return rows.where(T.strip(F.col("text")) != "").withColumns({"node_id": node_id, "node_type": F.lit(kind), "content_hash": T.sha256(F.col("text")), "confidence": F.lit(confidence)})


def plain_chunks(files: DataFrame) -> DataFrame:
    return chunks(files, 120, 20, kind="doc", confidence=0.9)


def config_chunks(files: DataFrame) -> DataFrame:
    return chunks(files, 160, 20, kind="config", confidence=0.85)


def headings(lines: DataFrame) -> DataFrame:
    """``(file, line_no, level, title, section_path)``: the path joins a heading and its open ancestors."""
    h = lines.where(F.col("line").rlike(HEADING)).select(*FILE, "line_no", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), T.strip(F.regexp_replace(F.regexp_extract("line", HEADING, 2), r"^#+|(?<!#)#+$", "")).alias("title")).where("title <> ''")
    sofar = spans.by_line().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(1, 7):
        h = h.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), ignorenulls=True).over(sofar))
    parts = []
    for k in range(1, 7):
        shallower = F.greatest(F.lit(0), *[F.coalesce(F.col(f"h{j}.line_no"), F.lit(0)) for j in range(1, k)]) if k > 1 else F.lit(0)
        parts.append(F.when((F.col("level") >= k) & (F.col(f"h{k}.line_no") > shallower), F.col(f"h{k}.title")))
    return h.select(*FILE, "line_no", "level", "title", F.concat_ws(" > ", *parts).alias("section_path"))


def sections(lines: DataFrame) -> DataFrame:
    """``(file, start_line, end_line, title, section_path, level)``: preamble and heading sections with text in them."""
    hs = headings(lines)
    has_text = T.strip(F.col("line")) != ""
    n = lines.groupBy(*FILE).agg(F.max("line_no").alias("n_lines"), F.min(F.when(has_text, F.col("line_no"))).alias("first_text"))
    nxt = F.lead("line_no").over(spans.by_line())
    body = hs.withColumn("nxt", nxt).join(n, FILE).select(*FILE, F.col("line_no").alias("start_line"), (F.coalesce("nxt", F.col("n_lines") + 1) - 1).alias("end_line"), "title", "section_path", "level")
    firsts = hs.groupBy(*FILE).agg(F.min("line_no").alias("first"))
    head = n.join(firsts, FILE, "left").withColumn("end_line", F.coalesce("first", F.col("n_lines") + 1) - 1).where("first_text <= end_line")
    pre = head.select(*FILE, F.lit(1).alias("start_line"), "end_line", F.lit("").alias("title"), F.lit("").alias("section_path"), F.lit(0).alias("level"))
    return pre.unionByName(body)


def section_spans(lines: DataFrame) -> DataFrame:
    """Sections cut to chunks of 100 lines with 20 in common; chunks of blank lines are among them."""
    cut = sections(lines).withColumn("c", F.explode(spans.chunk_ranges(F.col("start_line"), F.col("end_line"), 100, 20)))
    return cut.select(*FILE, F.col("c.a").alias("start_line"), F.col("c.b").alias("end_line"), "title", "section_path", "level")


def section_chunks(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Sections' chunks with their text."""
    out = section_spans(lines).join(with_lines(files).select(*FILE, "lines"), FILE).withColumn("text", snippet(F.col("lines"), F.col("start_line"), F.col("end_line"))).drop("lines")
    return out.where(T.strip(F.col("text")) != "").withColumns({"node_type": F.lit("doc"), "confidence": F.lit(0.92)})


def doc_titles(files: DataFrame, lines: DataFrame) -> DataFrame:
    """``(file, doc_title)``: the first level-1 heading, else the file's stem."""
    first = headings(lines).where(F.col("level") == 1).groupBy(*FILE).agg(F.min_by("title", "line_no").alias("t"))
    return files.select(*FILE).join(first, FILE, "left").select(*FILE, F.coalesce("t", T.stem(F.col("file_path"))).alias("doc_title"))


def fences(lines: DataFrame) -> DataFrame:
    """``(file, start_line, end_line, code_language, fence_closed)``: fenced code; a fence closes on its own marker only."""
    mark = F.struct("line_no", F.regexp_extract("line", FENCE, 1).alias("marker"), F.lower(F.regexp_extract("line", FENCE, 2)).alias("code_lang"))
    by_file = lines.groupBy(*FILE).agg(F.max("line_no").alias("n_lines"), F.array_sort(F.collect_list(F.when(F.col("line").rlike(FENCE), mark))).alias("ms"))
    blank = F.struct(F.lit(0).alias("at"), F.lit("").alias("marker"), F.lit("").alias("code_lang"), F.array().cast("array<struct<a:int,b:int,code_lang:string,closed:boolean>>").alias("out"))

    def state(at: Column, marker: Column, lang: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), marker.alias("marker"), lang.alias("code_lang"), out.alias("out"))

    def one(a: Column, b: Column, lang: Column, closed: bool) -> Column:
        return F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), lang.alias("code_lang"), F.lit(closed).alias("closed")))

    def step(s: Column, m: Column) -> Column:
        begun = state(m["line_no"], m["marker"], m["code_lang"], s["out"])
        ended = state(F.lit(0), F.lit(""), F.lit(""), F.concat(s["out"], one(s["at"], m["line_no"], s["code_lang"], True)))
        return F.when(s["at"] == 0, begun).when(s["marker"] == m["marker"], ended).otherwise(s)

    folded = by_file.withColumn("e", F.aggregate("ms", blank, step))
    every = F.when(F.col("e.at") > 0, F.concat("e.out", one(F.col("e.at"), F.col("n_lines"), F.col("e.code_lang"), False))).otherwise(F.col("e.out"))
    rows = folded.select(*FILE, F.explode(every).alias("f"))
    return rows.select(*FILE, F.col("f.a").alias("start_line"), F.col("f.b").alias("end_line"), F.when(F.col("f.code_lang") == "", "text").otherwise(F.col("f.code_lang")).alias("code_language"), F.col("f.closed").alias("fence_closed"))
