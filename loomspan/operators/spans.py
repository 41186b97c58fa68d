"""Spans over the line table: blocks, statements, annotations, comments, chunks.

Every window is partitioned by file, so one shuffle by (repo_name, file_path) serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomspan.functions import text as T

FILE = ["repo_name", "file_path"]


def by_line(*extra: str) -> WindowSpec:
    return Window.partitionBy(*FILE, *extra).orderBy("line_no")


def chunk_ranges(start: Column, stop: Column, size: int, overlap: int, drop_contained: bool = False) -> Column:
    """Array of (a, b): windows of ``size`` lines that step back ``overlap``, plus a tail chunk of the last ``overlap`` lines."""
    step = size - overlap if overlap < size else size
    n = stop - start + 1
    m = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    full = F.transform(F.sequence(F.lit(0), m), lambda k: F.struct((start + k * step).cast("int").alias("a"), F.least(start + k * step + size - 1, stop).cast("int").alias("b")))
    if drop_contained or not 0 < overlap < size:
        return F.when(n > 0, full)
    tail = F.struct((stop - overlap + 1).cast("int").alias("a"), stop.cast("int").alias("b"))
    return F.when(n > 0, F.when(tail["a"] > start + m * step, F.concat(full, F.array(tail))).otherwise(full))


def islands(lines: DataFrame, flag: Column, *extra: str) -> DataFrame:
    """``(file, extra, start_line, end_line)``: maximal runs of flagged lines."""
    flagged = lines.where(flag)
    grp = flagged.withColumn("g", F.col("line_no") - F.row_number().over(by_line(*extra)))
    return grp.groupBy(*FILE, *extra, "g").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).drop("g")


def hash_comments(lines: DataFrame) -> DataFrame:
    return islands(lines, F.startswith(T.strip(F.col("line")), F.lit("#")))


def cobol_comments(lines: DataFrame) -> DataFrame:
    return islands(lines, (F.substring("line", 7, 1) == "*") | F.startswith(T.strip(F.col("line")), F.lit("*>")))


def marked_comments(lines: DataFrame, marker: str) -> DataFrame:
    """``(file, kind, start_line, end_line)``: runs of marker lines and /* */ blocks.

    A line with a mark either leaves the text inside a block, outside of one, as it was, or turned over. So
    whether a line begins inside a block is a running sum: what the latest line that decides by itself left,
    turned over as often as lines since did. Work is linear in the lines with marks; others only give their number.
    """
    text = T.strip(F.col("line"))
    is_line = F.startswith(text, F.lit(marker))
    opens = F.locate("/*", F.col("line"))
    same = F.coalesce((opens > 0) & (F.locate("*/", F.substring(F.col("line"), opens + 2, F.length("line"))) > 0), F.lit(False))
    closes = F.contains("line", F.lit("*/"))
    marks = lines.select(*FILE, "line_no", is_line.alias("mark"), same.alias("same"), (opens > 0).alias("open"), closes.alias("close")).where("mark OR open OR close")
    begins = F.col("open") & ~F.col("mark") & ~F.col("same")  # where a line begins outside
    turned = begins & F.col("close")
    decides = F.when(begins & ~F.col("close"), True).when(~begins & F.col("close"), False)
    upto = by_line().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = marks.withColumn("turns", F.sum(turned.cast("int")).over(upto)).withColumn("left", F.last(F.when(decides.isNotNull(), F.struct(decides.alias("inside"), "turns")), ignorenulls=True).over(upto))
    odd = (F.col("turns") - F.coalesce("left.turns", F.lit(0))) % 2 == 1
    marks = marks.withColumn("after", F.coalesce("left.inside", F.lit(False)) != odd)
    before = F.coalesce(F.lag("after").over(by_line()), F.lit(False))
    marks = marks.withColumns({"before": before, "is_last": F.lead("line_no").over(by_line()).isNull()})
    starts = ~F.col("before") & F.col("after")
    marks = marks.withColumn("begun", F.last(F.when(starts, F.col("line_no")), ignorenulls=True).over(upto))
    span = lambda rows, kind, a, b: rows.select(*FILE, F.lit(kind).alias("kind"), a.cast("int").alias("start_line"), b.cast("int").alias("end_line"))
    here, begun = F.col("line_no"), F.col("begun")
    whole = span(marks.where("before AND NOT after"), "block", begun, here)
    one = span(marks.where("NOT before AND NOT after AND same AND NOT mark"), "block", here, here)
    n = lines.groupBy(*FILE).agg(F.max("line_no").alias("n_lines"))
    open_end = span(marks.where("is_last AND after").join(n, FILE), "block", begun, F.col("n_lines"))
    runs = islands(marks.where("NOT before AND mark").select(*FILE, "line_no"), F.lit(True)).select(*FILE, F.lit("line_block").alias("kind"), "start_line", "end_line")
    return runs.unionByName(whole).unionByName(one).unionByName(open_end)


def next_within(value: Column, max_span: int, *extra: str) -> Column:
    """The first ``value`` that is not null at or after each line, at most ``max_span - 1`` lines on: a running window from the end, linear in lines.

    ``value`` is a struct whose first field is its line_no.
    """
    back = Window.partitionBy(*FILE, *extra).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last(value, ignorenulls=True).over(back)
    return F.when(found["line_no"] < F.col("line_no") + max_span, found)


def brace_blocks(lines: DataFrame, max_span: int = 300) -> DataFrame:
    """``lines`` plus ``block_end``: where the first block at or after each line closes.

    Every brace gets its depth by a running sum; at one depth, an opening brace's next neighbour is its
    close. An unclosed or longer block ends ``max_span`` lines on; without a brace the line is its own end.
    """
    braces = lines.select(*FILE, "line_no", F.posexplode(F.regexp_extract_all("line", F.lit("[{}]"), F.lit(0))).alias("pos", "ch"))
    order = Window.partitionBy(*FILE).orderBy("line_no", "pos")
    depth = F.sum(F.when(F.col("ch") == "{", 1).otherwise(-1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = F.when(F.col("ch") == "{", F.col("depth")).otherwise(F.col("depth") + 1)
    leveled = braces.withColumn("depth", depth).withColumn("level", level)
    close = F.lead("line_no").over(Window.partitionBy(*FILE, "level").orderBy("line_no", "pos"))
    first = leveled.withColumn("close", close).where(F.col("ch") == "{").groupBy(*FILE, "line_no").agg(F.min_by("close", "pos").alias("close"))
    # Blocks are laid among the lines, each just before its own line from the end, so lines meet them in one window and no join.
    blocks = first.select(*FILE, "line_no", F.struct("line_no", "close").alias("open"), F.lit(0).alias("is_line"))
    laid = lines.withColumn("is_line", F.lit(1)).unionByName(blocks, allowMissingColumns=True)
    back = Window.partitionBy(*FILE).orderBy(F.desc("line_no"), "is_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = laid.withColumns({"f": F.last("open", ignorenulls=True).over(back), "n_lines": F.first("line_no").over(back)}).where("is_line = 1")
    limit = F.least(F.col("n_lines"), F.col("line_no") - 1 + max_span)
    near = F.col("f.line_no") < F.col("line_no") + max_span
    end = F.when(near, F.least(F.coalesce(F.col("f.close"), limit), limit)).otherwise(F.col("line_no"))
    return marked.select(*lines.columns, end.cast("int").alias("block_end"))


def statement_ends(lines: DataFrame, max_span: int = 400) -> DataFrame:
    """``lines`` plus ``statement_end``: the first line at or after each with ';', within ``max_span`` lines."""
    n = F.first("line_no").over(Window.partitionBy(*FILE).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = next_within(F.when(F.contains("line", F.lit(";")), F.struct("line_no")), max_span)["line_no"]
    return lines.withColumn("statement_end", F.coalesce(hit, F.least(n, F.col("line_no") + max_span - 1)).cast("int"))


def annotation_blocks(lines: DataFrame, prefix: str, window: int = 6) -> DataFrame:
    """``lines`` plus ``annotations`` (array, in order) and ``ann_start``: the nearest run of prefix lines up to ``window`` lines above.

    Lines before the first annotation are passed over; the run ends at the first other line. The
    frame is at most ``window`` rows, so the fold is over a tiny array.
    """
    above = by_line().rowsBetween(-window, -1)
    w = lines.withColumn("w", F.collect_list(F.struct("line_no", T.strip(F.col("line")).alias("raw"))).over(above))
    empty = F.struct(F.array().cast("array<string>").alias("anns"), F.lit(None).cast("int").alias("at"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        more = F.struct(F.concat(F.array(x["raw"]), s["anns"]).alias("anns"), x["line_no"].alias("at"), F.lit(False).alias("done"))
        stop = F.struct(s["anns"].alias("anns"), s["at"].alias("at"), F.lit(True).alias("done"))
        return F.when(s["done"], s).when(F.startswith(x["raw"], F.lit(prefix)), more).when(F.size(s["anns"]) > 0, stop).otherwise(s)

    out = w.withColumn("a", F.aggregate(F.reverse("w"), empty, step))
    return out.select(*lines.columns, F.col("a.anns").alias("annotations"), F.coalesce("a.at", "line_no").cast("int").alias("ann_start"))


def annotation_path(annotations: Column) -> Column:
    """First quoted argument of the first annotation that has one; else ''."""
    paths = F.transform(annotations, lambda a: F.regexp_extract(a, r"""\(\s*(?:value\s*=\s*|path\s*=\s*)?["']([^"']+)["']""", 1))
    return F.coalesce(F.get(F.filter(paths, lambda p: p != ""), F.lit(0)), F.lit(""))
