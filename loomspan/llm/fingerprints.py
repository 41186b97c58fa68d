"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Only DataFrame functions. A text is cut into pieces: its first HEAD_CHARS code points finely, so that
short texts have several, the rest at sentence ends, at word ends that the character before them
picks, or at the greatest length. A piece's digest is 64 bits: a hash, and in the low 12 bits the piece's length.
Digests are dealt by their top bits to blocks of at most LOAD on average, and each block has a sketch
of 3 x width cells (count, exclusive or of digests, exclusive or of check hashes). The width is the
least of WIDTHS at which the block's own sketch can be peeled, so a fingerprint of any size gives back
all its digests by itself, and whatever follows from the digests follows from the fingerprint.

To compare two fingerprints, the sketches of equal blocks are subtracted and the difference is peeled
one pure cell at a time. Where the two have different numbers of blocks or widths, or peeling fails, it
is retried larger: with the greater number of blocks, then the next width. Likeness is 1 - length of
the differing pieces / length of the pieces of both, or 1 if neither has any: the share of text in common.

Equal texts have equal fingerprints. Edge cases: null and empty texts have no piece; repeated
pieces count once; rows with equal or null ids are ordered by id (null first), then text hash.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.support import let, partitions

HEAD_CHARS = (16, 256)  # up to the first in pieces of 8, up to the second in pieces of 40 and more
HEAD_PIECES = (r"[^\n]{1,8}", r"[^\n]{40,80}?(?=\s|$)|[^\n]{1,80}")
PIECES = r"[^\n]{200,600}?(?:[.!?](?=\s|$)|[\u3002\uff01\uff1f\uff61])|[^\n]{200,600}?[b-gB-G0-4,;:)}](?=\s)|[^\n]{1,600}"
LOAD, WIDTHS = 8, (16, 64, 512)
MAX_DEPTH = 10  # 4**10 blocks: a string holds no more pieces
ROUNDS = 24
MAX_RANGES = 8192  # a row finds its range by looking at every cut
_LENGTH = 0xFFF
_NULL_ID = -(1 << 63)



def pieces(text: Column) -> Column:
    """All pieces of a text, in order."""
    fine, some = HEAD_CHARS
    zones = [(F.substring(text, 1, fine), HEAD_PIECES[0]), (F.substring(text, fine + 1, some - fine), HEAD_PIECES[1]), (F.substring(text, F.lit(some + 1), F.char_length(text)), PIECES)]
    return F.concat(*[F.regexp_extract_all(zone, F.lit(pattern), F.lit(0)) for zone, pattern in zones])


def digests(text: Column) -> Column:
    def digest(p: Column) -> Column:
        return F.xxhash64(p).bitwiseAND(~_LENGTH).bitwiseOR(F.char_length(p).cast("bigint"))

    return F.array_distinct(F.transform(pieces(text), digest))


def _shifted(k: Column, by: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", k, F.lit(by) if isinstance(by, int) else by)


def depth_of(n: Column) -> Column:
    """Blocks are 4 to this power."""
    return F.when(n <= LOAD, 0).otherwise(F.least(F.lit(MAX_DEPTH), F.ceil(F.log2(n / F.lit(float(LOAD))) / 2))).cast("int")


def blocks(keys: Column, depth: Column) -> Column:
    """Digests dealt to 4**depth blocks by their top bits, two bits a level: each digest is looked at four times a level."""
    def finer(dealt: Column, j: Column) -> Column:
        def quarter(b: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.filter(b, lambda k: _shifted(k, 64 - 2 * j).bitwiseAND(F.lit(3).cast("bigint")) == i))

        return F.flatten(F.transform(dealt, quarter))

    levels = F.slice(F.array(*[F.lit(j) for j in range(1, MAX_DEPTH + 1)]), F.lit(1), depth)
    return F.aggregate(levels, F.array(keys), finer)


def _cell(c: Column, k: Column, h: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), k.cast("bigint").alias("k"), h.cast("bigint").alias("h"))


def _zero() -> Column:
    return _cell(F.lit(0), F.lit(0), F.lit(0))


def _at(k: Column, table: Column | int, width: int) -> Column:
    """A digest's cell in a sub-table."""
    return _shifted(k, 12 + 9 * table).bitwiseAND(F.lit(width - 1).cast("bigint"))


def sketch(keys: Column, width: int = WIDTHS[0]) -> Column:
    """Three sub-tables of ``width`` cells for the digests of a block."""
    xor = lambda xs, f: F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, k: s.bitwiseXOR(f(k)))

    def sub_table(j: int) -> Column:
        def cells(hit: Column) -> Column:
            def cell(i: Column) -> Column:
                mine = F.filter(keys, lambda k: _at(k, j, width) == i)
                return F.when(F.array_contains(hit, i), let(mine, lambda ks: _cell(F.size(ks), xor(ks, lambda k: k), xor(ks, F.xxhash64)))).otherwise(_zero())

            return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint")), cell)

        return let(F.transform(keys, lambda k: _at(k, j, width)), cells)

    return F.array(*[sub_table(j) for j in range(3)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda s, t: F.zip_with(s, t, lambda x, y: _cell(x["c"] - y["c"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"]))))


def peel(tables: Column, width: int = WIDTHS[0]) -> Column:
    """Digests that a subtracted sketch holds, or null if it can't be peeled.

    Each step takes the pure cells of one sub-table (a count of 1 or -1 whose check hash fits its
    digest). They hold different digests; their cells empty, and the digests leave the other two
    sub-tables. The three take turns: ``t`` is the one at hand, ``u`` and ``v`` come next. Often every
    digest is alone in some cell: then the pure cells of all three hold as much as the first, and are all.
    """
    def pure(c: Column) -> Column:
        return (F.abs(c["c"]) == 1) & (F.xxhash64(c["k"]) == c["h"])

    def state(t: Column, u: Column, v: Column, keys: Column, idle: Column) -> Column:
        return F.struct(t.alias("t"), u.alias("u"), v.alias("v"), keys.alias("keys"), idle.alias("idle"))

    def less(table: Column, found: Column, j: Column) -> Column:
        def one(cell: Column, i: Column, hit: Column) -> Column:
            without = F.aggregate(found, cell, lambda c, f: F.when(_at(f["k"], j, width) == i, _cell(c["c"] - f["c"], c["k"].bitwiseXOR(f["k"]), c["h"].bitwiseXOR(f["h"]))).otherwise(c))
            return F.when(F.array_contains(hit, i.cast("bigint")), without).otherwise(cell)

        return let(F.transform(found, lambda f: _at(f["k"], j, width)), lambda hit: F.transform(table, lambda cell, i: one(cell, i, hit)))

    def total(cells: Column) -> Column:
        return F.aggregate(cells, _zero(), lambda s, c: _cell(s["c"] + c["c"], s["k"].bitwiseXOR(c["k"]), s["h"].bitwiseXOR(c["h"])))

    def step(at: Column, r: Column) -> Column:
        def without(found: Column) -> Column:
            rest = F.transform(at["t"], lambda c: F.when(pure(c), _zero()).otherwise(c))
            gone = state(less(at["u"], found, F.pmod(r + 1, F.lit(3))), less(at["v"], found, F.pmod(r + 2, F.lit(3))), rest, F.concat(at["keys"], F.transform(found, lambda c: c["k"])), F.lit(0))
            return F.when(F.size(found) == 0, state(at["u"], at["v"], at["t"], at["keys"], at["idle"] + 1)).otherwise(gone)

        return F.when(at["idle"] >= 3, at).otherwise(let(F.filter(at["t"], pure), without))

    return let(tables, lambda given: _peeled(given, pure, total, state, step))


def _peeled(tables: Column, pure: Callable, total: Callable, state: Callable, step: Callable) -> Column:
    start = state(*[F.get(tables, F.lit(j)) for j in range(3)], F.array().cast("array<bigint>"), F.lit(0))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    empty = lambda t: F.forall(t, lambda c: (c["c"] == 0) & (c["k"] == 0) & (c["h"] == 0))
    peeled = let(end, lambda e: F.when(empty(e["t"]) & empty(e["u"]) & empty(e["v"]), e["keys"]))
    alone = F.array_distinct(F.filter(F.flatten(tables), pure))
    return let(alone, lambda cs: F.when(total(cs) == total(F.get(tables, F.lit(0))), F.transform(cs, lambda c: c["k"])).otherwise(peeled))


def block_sketch(keys: Column) -> Column:
    """The sketch of the least width that gives back its own digests."""
    def tried(k: int) -> Column:
        if k == len(WIDTHS) - 1:
            return sketch(keys, WIDTHS[k])
        return let(sketch(keys, WIDTHS[k]), lambda t: F.when(peel(t, WIDTHS[k]).isNotNull(), t).otherwise(tried(k + 1)))

    return tried(0)


def sketches(dealt: Column) -> Column:
    return F.transform(dealt, block_sketch)


def recovered(tables: Column) -> Column:
    """All digests of a fingerprint, from its sketches alone."""
    def one(t: Column) -> Column:
        width = F.size(F.get(t, F.lit(0)))
        return F.coalesce(*[F.when(width == w, peel(t, w)) for w in WIDTHS])

    return F.flatten(F.transform(tables, one))


def _difference(a: Column, b: Column) -> Column:
    """Digests in one of two blocks only; each is (keys, cells)."""
    def attempt(w: int) -> Column:
        given = lambda x: F.when(F.size(F.get(x["cells"], F.lit(0))) == w, x["cells"]).otherwise(sketch(x["keys"], w))
        least = F.greatest(F.size(F.get(a["cells"], F.lit(0))), F.size(F.get(b["cells"], F.lit(0))))
        return F.when(least <= w, peel(subtract(given(a), given(b)), w))

    sets = F.concat(F.array_except(a["keys"], b["keys"]), F.array_except(b["keys"], a["keys"]))  # should the largest fail: what both give back
    return F.when(F.size(a["keys"]) + F.size(b["keys"]) == 0, F.array().cast("array<bigint>")).otherwise(F.coalesce(*[attempt(w) for w in WIDTHS], sets))


def differing(a_blocks: Column, a_cells: Column, b_blocks: Column, b_cells: Column) -> Column:
    """Digests in one of two fingerprints only. The one with fewer blocks gives back its digests, which are dealt and sketched anew."""
    def at_depth(dealt: Column, cells: Column, most: Column) -> Column:
        pair = lambda k, c: F.struct(k.alias("keys"), c.alias("cells"))
        anew = let(blocks(F.flatten(dealt), F.round(F.log2(most.cast("double")) / 2).cast("int")), lambda x: F.zip_with(x, F.transform(x, sketch), pair))
        return F.when(F.size(dealt) == most, F.zip_with(dealt, cells, pair)).otherwise(anew)

    most = F.greatest(F.size(a_blocks), F.size(b_blocks))
    return F.flatten(F.zip_with(at_depth(a_blocks, a_cells, most), at_depth(b_blocks, b_cells, most), _difference))


def length(keys: Column) -> Column:
    """Code points that digests stand for."""
    return F.aggregate(keys, F.lit(0).cast("bigint"), lambda s, k: s + k.bitwiseAND(F.lit(_LENGTH).cast("bigint")))


def likeness(different: Column, a_blocks: Column, b_blocks: Column) -> Column:
    both = length(F.flatten(a_blocks)) + length(F.flatten(b_blocks))
    return let(both, lambda n: F.when(n == 0, F.lit(1.0)).otherwise(1.0 - length(different) / n))


def rendered(n: Column, root: Column, cells: Column) -> Column:
    """Text form: digests, hash of the whole text, then for each block its width and its cells in use as place=count:digest:check in hex."""
    def block(t: Column) -> Column:
        cell = F.transform(F.flatten(t), lambda c, i: F.when((c["c"] != 0) | (c["k"] != 0), F.concat(F.hex(i), F.lit("="), c["c"].cast("string"), F.lit(":"), F.hex(c["k"]), F.lit(":"), F.hex(c["h"]))))
        return F.concat(F.size(F.get(t, F.lit(0))).cast("string"), F.lit(" "), F.array_join(cell, " "))

    return F.lower(F.concat_ws("|", n.cast("string"), F.hex(root), F.array_join(F.transform(cells, block), "|")))


def fingerprint(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, blocks, cells, fingerprint)`` of each row; row-local."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = _sketched(docs.select(F.col(id_col), text.alias("text")), "text", "")
    return one.select(id_col, "blocks", "cells", rendered(F.size(F.flatten("blocks")), F.xxhash64("text"), F.col("cells")).alias("fingerprint"))


def _sketched(rows: DataFrame, text_col: str, prefix: str) -> DataFrame:
    dealt = let(digests(F.col(text_col)), lambda k: blocks(k, depth_of(F.size(k))))
    return rows.withColumn(f"{prefix}blocks", dealt).withColumn(f"{prefix}cells", sketches(F.col(f"{prefix}blocks")))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, blocks, cells, next_text, next_blocks, next_cells)`` in ascending id order; the last row's next is the first.

    Rows go to ranges of the id, cut at quantiles (a few numbers a partition on the driver). The row
    that starts a range is also sent to the range before it, so each range is complete by itself:
    one shuffle, of the texts. Digests and sketches are made after it, once a row.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = min(partitions(docs), MAX_RANGES)
    quantiles = F.percentile_approx("key", [i / n for i in range(1, n)], 100 * n) if n > 1 else F.array().cast("array<bigint>")
    ends = docs.select(key.alias("key")).agg(quantiles.alias("q"), F.min("key").alias("low")).first()
    cuts = sorted({q for q in ends["q"] or [] if q > ends["low"]})
    bounds = F.array(*[F.lit(q) for q in cuts]) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("at", F.size(F.filter(bounds, lambda q: q <= F.col("key"))).cast("int"))

    def place(part: Column, tail: bool, turn: int) -> Column:
        return F.struct(part.cast("int").alias("part"), F.lit(tail).alias("tail"), F.lit(turn).alias("turn"))

    own = place(F.col("at"), False, 0)
    places = F.array(own)
    if cuts:
        places = F.when(F.col("key").isin(cuts), F.array(own, place(F.col("at") - 1, True, 0))).otherwise(places)
    if ends["low"] is not None:
        places = F.when(F.col("key") == ends["low"], F.array(own, place(F.lit(len(cuts)), True, 1))).otherwise(places)
    placed = rows.withColumn("p", F.explode(places)).select("id", "key", "text", "p.*").withColumn("tie", F.xxhash64("text"))
    dealt = placed.repartitionById(max(n, len(cuts) + 1), "part")
    made = _sketched(dealt, "text", "")
    order = Window.partitionBy("part").orderBy("turn", "key", "tail", "tie")
    following = {f"next_{c}": F.lead(c).over(order) for c in ("text", "blocks", "cells")}
    return made.withColumns(following).where(~F.col("tail")).select(F.col("id").alias(id_col), "text", "blocks", "cells", *following)


def compare_edited(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each text against its edited form (its last quarter replaced by the start of the next) and against the next text."""
    rows = with_next(docs, id_col, text_col)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited", edited).select(
        id_col, n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("root"), F.xxhash64("edited").alias("edited_root"),
        "blocks", "cells", "next_blocks", "next_cells", "edited",
    )
    rows = _sketched(rows, "edited", "edited_").drop("edited")
    mine = (F.col("blocks"), F.col("cells"))
    rows = rows.withColumn("diff_edited", differing(*mine, F.col("edited_blocks"), F.col("edited_cells")))
    rows = rows.withColumn("diff_next", differing(*mine, F.col("next_blocks"), F.col("next_cells")))
    return rows.select(
        id_col, "n_chars", "edited_sha256",
        rendered(F.size(F.flatten("blocks")), F.col("root"), F.col("cells")).alias("fingerprint"),
        rendered(F.size(F.flatten("edited_blocks")), F.col("edited_root"), F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("diff_edited"), F.col("blocks"), F.col("edited_blocks")).alias("near_edited"),
        likeness(F.col("diff_next"), F.col("blocks"), F.col("next_blocks")).alias("near_next"),
        F.size("diff_edited").cast("long").alias("n_diff_edited"), F.size("diff_next").cast("long").alias("n_diff_next"),
    )
