"""WARC fixity audit with Merkle trees.

A record's leaf is the SHA-256 of its WARC bytes. An archive holds the records of PER_ARCHIVE ids; its
tree stands on fixed places: a slot an id, ranges of FANOUT slots above, up to one root. A node's hash
covers each child's place, hash and length, and its offsets follow from the lengths. Two replicas
compare roots first and then only the children of nodes that differ, so an intact archive costs one
comparison and a corrupt record a path from root to leaf; a record that is lost or added moves the
offsets of those after it, but no place in the tree, so it is named alone.

Many records of one id meet no task together: below a slot stand two more levels over ranges of digests,
65,536 parts of 65,536 pieces. A piece's hash covers the digests and copies of its distinct records in order, a
part's those of its pieces, so hashes are SHA-256 of ordered ranges at every level, and no group but that of
digests with the same first 32 bits is without a bound.

Edge cases: null urls and bodies count as empty. Null ids have no order: their records form archives
from NULL_ARCHIVE on, placed by digest. Repeated rows are one record with a number of copies. Of an id
whose records differ, one record lost and one gained make one ``altered`` row; otherwise the lost ones
are ``missing`` and the gained ones ``extra``. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.support import written

FANOUT = 16
PER_ARCHIVE = 256  # ids
NULL_ARCHIVE = -(1 << 62)
SLOT, PART = ["archive", "slot"], ["archive", "slot", "part"]  # four hex digits of the digest make a part


def record_bytes(url: Column, body: Column) -> Column:
    """A WARC response record: header, blank line, body, two line ends."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str, url_col: str, body_col: str, per_archive: int = PER_ARCHIVE) -> DataFrame:
    """``(archive, slot, part, id, digest, n, copies)``: distinct records; digests and lengths are shuffled, bodies stay where they are read."""
    raw = record_bytes(F.col(url_col), F.col(body_col))
    leaf = pages.select(F.col(id_col).cast("long").alias("id"), F.octet_length(raw).cast("long").alias("n"), F.sha2(raw, 256).alias("digest"))
    digits = lambda at, k: F.conv(F.substring("digest", at, k), 16, 10).cast("long")
    above = F.floor(F.col("id") / per_archive).cast("long")
    place = leaf.withColumns({
        "archive": F.coalesce(above, NULL_ARCHIVE + digits(1, 2)),
        "slot": F.coalesce(F.col("id") - above * per_archive, digits(3, 2)),
        "part": F.when(F.col("id").isNull(), digits(5, 4)).otherwise(digits(1, 4)),
    })
    return place.groupBy(*PART, "id", "digest").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))


def parts(leaves: DataFrame) -> DataFrame:
    """``(archive, slot, part, bytes, hash)``: records of a slot whose digests begin alike, by pieces that begin alike further on. One shuffle, by part."""
    def hashed(lines: str) -> Column:
        return F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256).alias("hash")

    piece = F.when(F.col("id").isNull(), F.substring("digest", 9, 4)).otherwise(F.substring("digest", 5, 4))  # the four digits after the part's
    rows = leaves.repartition(*PART).select(*PART, piece.alias("piece"), F.concat_ws(":", "digest", "copies").alias("line"), (F.col("n") * F.col("copies")).alias("bytes"))
    pieces = rows.groupBy(*PART, "piece").agg(F.sum("bytes").alias("bytes"), hashed("line"))
    return pieces.withColumn("line", F.concat_ws(":", "piece", "hash", "bytes")).groupBy(*PART).agg(F.sum("bytes").alias("bytes"), hashed("line"))


def tree(of_parts: DataFrame, depth: int, fanout: int = FANOUT) -> DataFrame:
    """``(archive, level, idx, bytes, hash)``: slots at level 0, roots at level ``depth``; at most ``fanout`` children a node, or 65,536 parts a slot."""
    def above(children: DataFrame, place: str, idx: Column, level: int) -> DataFrame:
        child = F.struct(F.col(place), F.concat_ws(":", place, "hash", "bytes").alias("d"))
        grouped = children.groupBy("archive", idx.cast("long").alias("idx")).agg(F.array_sort(F.collect_list(child)).alias("kids"), F.sum("bytes").alias("bytes"))
        return grouped.select("archive", F.lit(level).alias("level"), "idx", "bytes", F.sha2(F.array_join(F.transform("kids", lambda x: x["d"]), "\n"), 256).alias("hash"))

    levels = [above(of_parts, "part", F.col("slot"), 0)]
    for k in range(1, depth + 1):
        levels.append(above(levels[-1], "idx", F.floor(F.col("idx") / fanout), k))
    return reduce(DataFrame.unionByName, levels)


def depth_for(per_archive: int = PER_ARCHIVE, fanout: int = FANOUT) -> int:
    """Levels above the slots of an archive (of null ids: 256 slots)."""
    depth = 1
    while fanout**depth < max(per_archive, 256):
        depth += 1
    return depth


def differing_slots(a: DataFrame, b: DataFrame, depth: int, fanout: int = FANOUT) -> DataFrame:
    """``(archive, slot)`` where two trees differ: roots are compared, then the children of differing nodes only."""
    frontier = None
    for level in range(depth, -1, -1):
        here = [x.where(F.col("level") == level) for x in (a, b)]
        if frontier is not None:
            here = [x.withColumn("above", F.floor(F.col("idx") / fanout)).join(frontier, ["archive", "above"], "left_semi") for x in here]
        frontier = _unequal(*here, ["archive", "idx"], "hash").withColumnRenamed("idx", "above")
    return frontier.withColumnRenamed("above", "slot")


def _unequal(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that only one side has or whose values differ."""
    both = a.select(*keys, F.col(value).alias("va")).join(b.select(*keys, F.col(value).alias("vb")), keys, "full_outer")
    return both.where(~F.col("va").eqNullSafe(F.col("vb"))).select(*keys)


def _placed(leaves: DataFrame, of_parts: DataFrame, nodes: DataFrame, where: DataFrame, spots: DataFrame) -> DataFrame:
    """Records of differing parts with their offsets: the slot's, plus the parts and records before. Each window holds a slot or a part at most."""
    def before(keys: list[str], *order: str, value: Column) -> Column:
        return F.sum(value).over(Window.partitionBy(*keys).orderBy(*order)) - value

    slots = nodes.where(F.col("level") == 0).join(where.select("archive").distinct(), "archive", "left_semi").withColumn("slot_at", before(["archive"], "idx", value=F.col("bytes")))
    ps = of_parts.join(where, SLOT, "left_semi").withColumn("part_at", before(SLOT, "part", value=F.col("bytes")))
    rs = leaves.join(spots, PART, "left_semi").withColumn("at", before(PART, "digest", "id", value=F.col("n") * F.col("copies")))
    rs = rs.join(ps.select(*PART, "part_at"), PART).join(slots.select("archive", F.col("idx").alias("slot"), "slot_at"), SLOT)
    start = F.col("slot_at") + F.col("part_at") + F.col("at")
    return rs.select(*PART, "id", "digest", "copies", start.alias("start"), (start + F.col("n") * F.col("copies")).alias("stop"))


def audit(a: DataFrame, b: DataFrame, *, per_archive: int = PER_ARCHIVE, fanout: int = FANOUT) -> DataFrame:
    """``(archive, idx, id, start, stop, replica_start, replica_stop, digest, replica_digest, copies, kind)`` for two tables of records."""
    of_parts = [written(parts(x), "warc-parts") for x in (a, b)]
    nodes = [written(tree(p, depth_for(per_archive, fanout), fanout), "warc-tree") for p in of_parts]
    where = written(differing_slots(*nodes, depth_for(per_archive, fanout), fanout), "warc-differing")
    spots = written(_unequal(*[p.join(where, SLOT, "left_semi") for p in of_parts], PART, "hash"), "warc-parts-differing")
    sides = [_placed(*x, where, spots) for x in zip((a, b), of_parts, nodes)]
    names = ["start", "stop", "copies"]
    one, two = (s.withColumns({"key": F.coalesce("id", F.lit(0).cast("long"))}).select(*PART, "key", "id", "digest", *[F.col(c).alias(f"{c}_{k}") for c in names]) for k, s in enumerate(sides))
    both = one.join(two.withColumnRenamed("id", "id_1"), [*PART, "key", "digest"], "full_outer")
    less = F.coalesce("copies_0", F.lit(0)) - F.coalesce("copies_1", F.lit(0))
    changed = both.withColumn("id", F.coalesce("id", "id_1")).withColumn("less", less).where(F.col("less") != 0)
    changed = written(changed, "warc-changed")
    lost, gained = F.col("less") > 0, F.col("less") < 0
    # An id with one record lost and one gained, as often: altered.
    of_id = changed.where(F.col("id").isNotNull()).groupBy("archive", "slot", "id").agg(
        F.count_if(lost).alias("n_lost"), F.count_if(gained).alias("n_gained"), F.sum("less").alias("net"), F.max(F.abs("less")).alias("copies"),
        *[F.max(F.when(k, F.col(c))).alias(n) for n, k, c in (("start", lost, "start_0"), ("stop", lost, "stop_0"), ("replica_start", gained, "start_1"), ("replica_stop", gained, "stop_1"), ("digest", lost, "digest"), ("replica_digest", gained, "digest"))],
    )
    altered = of_id.where((F.col("n_lost") == 1) & (F.col("n_gained") == 1) & (F.col("net") == 0))
    rest = changed.join(altered.select("archive", "slot", "id"), ["archive", "slot", "id"], "left_anti")
    columns = ["archive", F.col("slot").alias("idx"), "id", "start", "stop", "replica_start", "replica_stop", "digest", "replica_digest", "copies", "kind"]
    single = rest.select(
        "archive", "slot", "id", F.col("start_0").alias("start"), F.col("stop_0").alias("stop"), F.col("start_1").alias("replica_start"), F.col("stop_1").alias("replica_stop"),
        F.when(lost, F.col("digest")).alias("digest"), F.when(gained, F.col("digest")).alias("replica_digest"), F.abs("less").alias("copies"), F.when(lost, "missing").otherwise("extra").alias("kind"),
    )
    return altered.withColumn("kind", F.lit("altered")).select(*columns).unionByName(single.select(*columns))


def compare(pages: DataFrame, replica: DataFrame, id_col: str, url_col: str, body_col: str, per_archive: int = PER_ARCHIVE, fanout: int = FANOUT) -> DataFrame:
    """Audit of two replicas given as tables of pages."""
    sides = [written(records(x, id_col, url_col, body_col, per_archive), "warc-leaves") for x in (pages, replica)]
    return audit(*sides, per_archive=per_archive, fanout=fanout)
