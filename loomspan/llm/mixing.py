"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are laid in a shuffled order (a hash of the id) into a stream of tokens,
repeated where its target exceeds its size, and cut into blocks of equal length. Slot s of the schedule
has the golden-ratio point frac((s+1) * phi), mapped through the cumulative target weights to a source;
its rank among that source's slots names the block. Every source is within a few blocks of its
target after any number of slots; closing slots take what is left to each target.

Sources are a table as any other: they are numbered, weighed and matched to slots by joins, however
many there are. The driver gets a few sums.

Edge cases: null texts and texts without a token have size 0 and are never taken; a null source is
a source of its own, last in order; null and repeated ids are ordinary rows (identical rows share
the tokens drawn for them evenly by order). Empty input gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.support import partitions, written

WEIGHTS, SHARE, MAX_REPEAT = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK_TOKENS = 512
BUCKET_ROWS = 1 << 12
_PHI32 = 2654435769  # 2**32 over the golden ratio, odd


def word_count(text: Column) -> Column:
    """Runs of anything but space and \\x09-\\x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _upto(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """``df`` plus the sum of ``value`` over the rows before, within ``keys``, in the order of ``order``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w) - F.col(value))


def _ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` written in ranges of ``order``, numbered by ``range``."""
    return written(df.repartitionByRange(partitions(df), *order).withColumn("range", F.spark_partition_id()), "mix-ranges")


def _running(df: DataFrame, order: list[str | Column], value: str, name: str) -> DataFrame:
    """``df`` plus the sum of ``value`` over all rows before: within ranges of the order, and of the ranges (one row each)."""
    ranged = _ranged(df, *order)
    inside = ranged.withColumn(name, F.sum(value).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value))
    sums = _upto(ranged.groupBy("range").agg(F.sum(value).alias("n")).withColumn("all", F.lit(1)), ["all"], "range", "n", "before").select("range", "before")
    return inside.join(sums, "range").withColumn(name, F.col(name) + F.col("before")).drop("range", "before")


def shares(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_REPEAT) -> DataFrame:
    """``(src, source, rows, source_size, target)``: sources by code point, null last, weigh in turn.

    Targets are in proportion to the weights and add up to ``share`` of all sizes; none is above ``most``
    times its size, the excess is reshared among the others until none is. A round is one sum over the
    sources that are not full yet.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).withColumn("one", F.lit(1).cast("long"))
    ordered = _running(sums, [F.col("source").asc_nulls_last()], "one", "src").drop("one")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    found = written(ordered.withColumn("w", F.get(turn, (F.col("src") % len(weights)).cast("int"))), "mix-sources")
    left = share * (found.agg(F.sum("source_size")).first()[0] or 0)
    free = (F.col("source_size") > 0)
    unit = 0.0
    while left > 0:
        w = found.where(free).agg(F.sum("w")).first()[0]
        if not w:
            break
        unit = left / w
        full = F.col("w") * unit >= most * F.col("source_size")
        now = found.where(free & full).agg(F.sum("source_size")).first()[0]
        if not now:
            break
        left -= most * now
        free = free & ~full
    target = F.when(F.col("source_size") == 0, 0.0).when(free & (left > 0), F.col("w") * unit).otherwise(most * F.col("source_size"))
    return written(found.select("src", "source", "rows", "source_size", target.cast("double").alias("target")), "mix-targets")


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """``(slot, src, rank, tokens)``: the slots, each a block of a source's stream; closing slots follow in the order of the sources.

    Slots meet sources by equal cells of the unit interval, about one a source, then by the exact bounds.
    """
    spark = plan.sparkSession
    facts = plan.where("target > 0").agg(F.sum("target"), F.count(F.lit(1))).first()
    total, n_sources = facts[0] or 0.0, facts[1]
    n_slots, cells = int(total // block), max(1, n_sources)
    laid = _running(plan.where("target > 0"), ["src"], "target", "low").withColumns({"low": F.col("low") / (total or 1.0), "high": (F.col("low") + F.col("target")) / (total or 1.0)})
    in_cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    last = F.col("high") >= 1 - 1e-9
    laid = written(laid.withColumn("high", F.when(last, 2.0).otherwise(F.col("high"))).select("src", "target", "low", "high", F.explode(F.sequence(in_cell(F.col("low")), in_cell(F.col("high")))).alias("cell")), "mix-cells")
    point = (((F.col("id") + 1) % (1 << 31)) * F.lit(_PHI32) % (1 << 32)) / F.lit(float(1 << 32))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", in_cell(F.col("u")))
    met = slots.join(laid, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("slot", "src", "target", F.floor(F.col("slot") / BUCKET_ROWS).alias("chunk"))
    inside = met.withColumn("r", F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")))
    before = _upto(met.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n")), ["src"], "chunk", "n", "before")
    ranked = inside.join(before, ["src", "chunk"]).select("slot", "src", F.floor("target").alias("goal"), (F.col("r") + F.col("before") - 1).alias("rank"))
    taken = ranked.where(F.col("rank") * block < F.col("goal")).select("slot", "src", "rank", F.least(F.lit(block), F.col("goal") - F.col("rank") * block).cast("long").alias("tokens"))
    # From the last whole block of a source to its target, block by block (a few at most).
    counts = before.groupBy("src").agg(F.sum("n").alias("n"))
    rest = plan.where("target > 0").select("src", F.floor("target").alias("goal")).join(counts, "src", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("goal") > F.col("n") * block)
    closing = rest.select("src", "goal", F.explode(F.sequence(F.col("n"), F.floor((F.col("goal") - 1) / block))).alias("rank"))
    return taken.unionByName(closing.select((F.col("src") + n_slots).alias("slot"), "src", "rank", F.least(F.lit(block), F.col("goal") - F.col("rank") * block).cast("long").alias("tokens")))


def streams(docs: DataFrame, id_col: str, text_col: str, source_col: str, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_REPEAT, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The rows, each with its place in its source's stream: ``(src, bucket, nth, id, row, source, size, source_size, target, start)``; and the sources."""
    sized = written(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    plan = shares(sized, weights, share, most)
    facts = plan.select("src", F.col("source").alias("of"), "source_size", "target", F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets"))
    rows = sized.join(facts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    mixed = F.xxhash64(F.lit(seed), "id", "row")
    rows = rows.withColumn("h", mixed).withColumn("bucket", F.floor(F.shiftrightunsigned("h", 32) * F.col("buckets") / F.lit(float(1 << 32))))
    order = Window.partitionBy("src", "bucket").orderBy("h", "id", "row")
    rows = rows.withColumns({"upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "nth": F.row_number().over(order)})
    before = _upto(rows.groupBy("src", "bucket").agg(F.sum("size").alias("n")), ["src"], "bucket", "n", "before").drop("n")
    laid = rows.join(before, ["src", "bucket"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    return written(laid.select("src", "bucket", "nth", "id", "row", "source", "size", "source_size", "target", "start"), "mix-streams"), plan


def drawn(laid: DataFrame, plan: DataFrame, *, block: int = BLOCK_TOKENS, most: float = MAX_REPEAT) -> DataFrame:
    """``(slot, src, rank, bucket, nth, first, n)``: the pieces of documents in each slot of the mix; ``first`` is a piece's first token in its document."""
    place = F.explode(F.transform(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)), lambda p: F.col("start") + p * F.col("source_size"))).alias("a")
    passes = laid.where(F.col("size") > 0).select("src", "bucket", "nth", "size", "target", place).where(F.col("a") < F.col("target"))
    pieces = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("a") + F.col("size") - 1) / block))))
    first = F.greatest("a", F.col("rank") * block)
    n = F.least(F.col("a") + F.col("size"), F.col("rank") * block + F.col("tokens")) - first
    return pieces.join(schedule(plan, block), ["src", "rank"]).select("slot", "src", "rank", "bucket", "nth", (first - F.col("a")).alias("first"), n.alias("n")).where(F.col("n") > 0)


def blocks(docs: DataFrame, id_col: str, text_col: str, source_col: str, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_REPEAT, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """``(slot, source, id, row, first, n)``: the mix in order: of each slot, which words of which documents it holds."""
    laid, plan = streams(docs, id_col, text_col, source_col, weights=weights, share=share, most=most, seed=seed)
    out = drawn(laid, plan, block=block_tokens, most=most).join(laid.select("src", "bucket", "nth", "source", "id", "row"), ["src", "bucket", "nth"])
    return out.select("slot", "source", F.col("id").alias(id_col), "row", "first", "n")


def mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_REPEAT, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """``(id, row, source, size, source_size, target, taken)`` for each row of ``docs``; ``row`` hashes the text.

    Two narrow shuffles of ids and sizes (by source and hash bucket; by source and block), none of
    text. A hot source spreads over its hash buckets and blocks; only the sums of its buckets, one row
    for BUCKET_ROWS documents, pass one task.
    """
    laid, plan = streams(docs, id_col, text_col, source_col, weights=weights, share=share, most=most, seed=seed)
    taken = drawn(laid, plan, block=block_tokens, most=most).groupBy("src", "bucket", "nth").agg(F.sum("n").alias("taken"))
    out = laid.join(taken, ["src", "bucket", "nth"], "left")
    return out.select(F.col("id").alias(id_col), "row", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
