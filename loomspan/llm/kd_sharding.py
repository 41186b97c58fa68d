"""K-d tree sharding: recursive splits at weighted medians along the widest metadata dimension.

Only DataFrame operations. The dimensions describe the text alone (bytes, lines, bytes a code
point, mean line length), so equal texts always share a leaf. A split's weighted median comes from
histograms: one pass bins every node's widest dimension, one refines the bin that holds half of
the node's bytes, and one splits ties on the median value by a hash of the text. A histogram has
at most nodes x bins rows however large the input. Nodes and their cuts are small tables that rows
are joined to, so thousands of leaves cost no more than rows in those tables; the driver only gets
the ranges of the four dimensions.

Edge cases: null texts have size 1 (0 bytes plus 1). Equal texts, repeated rows and null texts
each form one group that is never split; if such a group outweighs a leaf's target, leaves are as
near to equal as whole groups allow. An empty table gives an empty result. Null ids are ordinary
rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.support import written

BINS = 4096
SLOT_ROWS = 1 << 12
COPIES = 1 << 14
DIMENSIONS = ("d_bytes", "d_lines", "d_width", "d_run")
_HASH_SPAN = float(1 << 32)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row a document: id, size, checksum, dimensions and a tie hash in [0, 1)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_bytes, n_chars = F.octet_length(text).cast("double"), F.char_length(text).cast("double")
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.lit(1.0)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).cast("long").alias("crc"),
        F.log2(n_bytes + 1).alias("d_bytes"),
        F.log2(n_lines).alias("d_lines"),
        (n_bytes / F.greatest(n_chars, F.lit(1.0))).alias("d_width"),
        F.log2(n_chars / n_lines + 1).alias("d_run"),
        (F.shiftrightunsigned(F.xxhash64(text), 32) / F.lit(_HASH_SPAN)).alias("tie"),
    )


def _cut(inside: DataFrame, value: Column, low: Column, high: Column, bins: int) -> DataFrame:
    """For each node of (shard, size, v, goal), the bin of ``value`` in [low, high] that holds the goal's weight, and the weight below it."""
    span = high - low
    at = F.when(span > 0, F.least(F.floor((value - low) / span * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    hist = inside.groupBy("shard", at.cast("int").alias("bin")).agg(F.sum("size").alias("w"), F.first("goal").alias("goal"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))
    cum = hist.withColumn("upto", F.sum("w").over(Window.partitionBy("shard").orderBy("bin")))
    found = cum.where((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("w") < F.col("goal")))
    return found.withColumn("under", F.col("upto") - F.col("w"))


def leaves(rows: DataFrame, n_leaves: int, bins: int = BINS) -> DataFrame:
    """``rows`` plus ``shard`` in 0..n_leaves-1. A few aggregations a level, over narrow rows.

    A node is named by the first shard below it and has k of them; a split gives k // 2 to the left.
    """
    ends = rows.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]).first()
    unit = {d: ((ends[f"max_{d}"] or 0.0) - (ends[f"min_{d}"] or 0.0)) or 1.0 for d in DIMENSIONS}
    rows = rows.withColumns({"shard": F.lit(0), "k": F.lit(n_leaves)})
    for _ in range((n_leaves - 1).bit_length()):
        spread = rows.where(F.col("k") > 1).groupBy("shard", "k").agg(F.sum("size").alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)])
        widest = F.greatest(*[F.struct(((F.col(f"max_{d}") - F.col(f"min_{d}")) / unit[d]).alias("span"), F.lit(d).alias("d"), F.col(f"min_{d}").alias("low"), F.col(f"max_{d}").alias("high")) for d in DIMENSIONS])
        left = F.floor(F.col("k") / 2).cast("int")
        nodes = spread.withColumn("x", widest).select("shard", F.col("x.d").alias("dim"), F.col("x.low").alias("low"), F.col("x.high").alias("high"), (F.col("w") * left / F.col("k")).alias("goal"))
        value = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in DIMENSIONS])

        def within(nodes: DataFrame) -> DataFrame:
            opened = rows.where(F.col("k") > 1).join(nodes, "shard").withColumn("v", value)
            return opened.where(F.col("v").between(F.col("low"), F.col("high")))

        # Pass 1 and 2 narrow the range of values that holds the median.
        for _ in range(2):
            nodes = written(nodes, "kd-nodes")
            cut = _cut(within(nodes), F.col("v"), F.col("low"), F.col("high"), bins)
            nodes = nodes.select("shard", "dim").join(cut.select("shard", F.col("v_min").alias("low"), F.col("v_max").alias("high"), (F.col("goal") - F.col("under")).alias("goal")), "shard")
        # Pass 3: within the values left (mostly one), the hash of the text orders the rows. A group is never split: take the nearer edge.
        nodes = written(nodes, "kd-nodes")
        cut = _cut(within(nodes), F.col("tie"), F.lit(0.0), F.lit(1.0), bins)
        near_end = F.col("upto") - F.col("goal") <= F.col("goal") - F.col("under")
        cut = cut.select("shard", ((F.col("bin") + F.when(near_end, 1).otherwise(0)) / bins).alias("tie_cut"))
        nodes = written(nodes.join(cut, "shard"), "kd-nodes")
        placed = rows.join(nodes.select("shard", "dim", "low", "high", "tie_cut"), "shard", "left").withColumn("v", value)
        goes_left = (F.col("v") < F.col("low")) | ((F.col("v") <= F.col("high")) & (F.col("tie") < F.col("tie_cut")))
        is_open = F.col("k") > 1
        shard = F.when(is_open & ~goes_left, F.col("shard") + left).otherwise(F.col("shard"))
        k = F.when(~is_open, F.col("k")).when(goes_left, left).otherwise(F.col("k") - left)
        # Written each level: the next level reads stored columns, not all conditions so far.
        rows = written(placed.withColumns({"shard": shard.cast("int"), "k": k.cast("int")}).select(*rows.columns), "kd-level")
    return rows.drop("k")


def slots(rows: DataFrame) -> DataFrame:
    """``(id, size, crc, shard, slot)``: slots are gapless from 0 in each shard, ordered by hash bucket, then id.

    Rows alike in id, size and checksum take slots one after another: they are counted before the shuffle and written out
    again COPIES at a time, so a row that repeats without end is no large window and no large task.
    """
    n = max(1, -(-rows.count() // SLOT_ROWS))
    alike = rows.groupBy("shard", "id", "crc", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", F.pmod(F.xxhash64("id", "crc"), F.lit(n)))
    inside = alike.withColumn("nth", F.sum("copies").over(Window.partitionBy("shard", "bucket").orderBy("id", "crc", "size")) - F.col("copies"))
    sums = alike.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = sums.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    runs = inside.join(before, ["shard", "bucket"]).withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    runs = runs.repartition("id", "crc", "begin")
    nth = F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + COPIES, F.col("copies")) - 1)).alias("copy")
    return runs.select("id", "size", "crc", "shard", (F.col("before") + F.col("nth")).alias("at"), nth).select("id", "size", "crc", "shard", (F.col("at") + F.col("copy")).alias("slot"))


def shard(docs: DataFrame, id_col: str, text_col: str, *, n_shards: int = 0, target_bytes: int = 0) -> DataFrame:
    """``(id, size, crc, shard, slot)``: leaves of near equal bytes, ``n_shards`` or of ``target_bytes`` each.

    The text is read once, for a narrow table of measures; every later pass reads that table.
    """
    rows = written(measured(docs, id_col, text_col), "kd-measures")
    if not n_shards:
        total = rows.agg(F.sum("size")).first()[0] or 0
        n_shards = max(1, -(-total // target_bytes))
    placed = slots(leaves(rows, n_shards))
    return placed.select(F.col("id").alias(id_col), "size", "crc", "shard", "slot")
