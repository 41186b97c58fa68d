"""N-gram Jaccard join by chosen paths.

Documents are sets of word n-grams (five words, lower-cased, split at white space). Equal sets are
one class from the start. Each set has T MinHash tokens, samples of its n-grams. A run starts with
all sets in one bucket and splits it: a bucket picks one or two of the T token positions (1/threshold
on average) and a set goes to the child of each token it holds there, so similar sets tend to stay
together. A bucket of at most BUCKET sets is brute-forced on short sketches; one that is still
larger after DEPTH splits is brute-forced in blocks. Runs repeat until the target recall.

The pairs found join into candidate groups; within a group every pair is then compared exactly on
its whole n-gram sets, block by block, and only counts and spanning links leave the task. So the
number of rows follows the documents, not the square of a group, and no link inside a group is lost.

Edge cases: a text of fewer than five words is one n-gram of all its words; null texts and texts
without a word have no n-gram and link to nothing. Rows with equal ids are separate documents with
that id; a null id counts as smaller than all others and is returned as null. Columns other than
the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.support import may_be_in, text_batches, written

WORDS, THRESHOLD = 5, 0.8
TOKENS = 64  # MinHash tokens of a set
BUCKET, DEPTH, RECALL = 128, 4, 0.999
BLOCK_GRAMS, BLOCK_SETS = 1 << 19, 1024  # of one side of an exact comparison
WORDS_HELD = 1 << 17  # word hashes that a worker remembers
_NULL_ID = -(1 << 63)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_WORD_HASH: dict[str, int] = {}


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def word_grams(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word n-grams."""
    found = (text or "").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(_WORD_HASH) > WORDS_HELD:
        _WORD_HASH.clear()
    known = _WORD_HASH
    codes = np.empty(len(found), np.uint64)
    for i, w in enumerate(found):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        codes[i] = h
    k = min(words, len(found))
    h = np.full(len(found) - k + 1, k, np.uint64)
    for j in range(k):
        h = _scramble(h * _MIX[1] + codes[j : len(found) - k + 1 + j])
    return np.unique(h)


def loss(runs: int, threshold: float = THRESHOLD, depth: int = DEPTH, tokens: int = TOKENS) -> float:
    """Probability that a pair at the threshold shares no bucket of the deepest level in any of the runs, or falls to the sketches' cut.

    In a split the pair meets in a child with probability 1 - (1 - p)(1 - p q): one position always, a
    second with q = 1/threshold - 1; a pair in more than one child only helps. All runs split on the same
    tokens, so p is the share of tokens on which the pair agrees, and the loss is its mean over that.
    """
    q = 1 / threshold - 1
    lost = 0.0
    for same in range(tokens + 1):
        p, meets = same / tokens, 1.0
        for _ in range(depth):  # generating function of the shared children, from the last level up
            meets = 1 - (1 - p * meets) * (1 - p * q * meets)
        lost += math.comb(tokens, same) * threshold**same * (1 - threshold) ** (tokens - same) * (1.0 if same < least_same(tokens, threshold) else (1 - meets) ** runs)
    return lost


def least_same(tokens: int, threshold: float) -> float:
    """Equal tokens that a pair of sketches must have: four deviations below the threshold."""
    return tokens * threshold - 4 * math.sqrt(tokens * threshold * (1 - threshold))


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = DEPTH, tokens: int = TOKENS) -> int:
    """Runs after which a pair at the threshold is found with this probability."""
    if loss(1 << 16, threshold, depth, tokens) > 1 - recall:
        raise ValueError(f"{tokens} tokens can't give a recall of {recall}")
    return next(r for r in range(1, (1 << 16) + 1) if loss(r, threshold, depth, tokens) <= 1 - recall)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, tokens: int = TOKENS) -> DataFrame:
    """``(id, row, s1, s2, n, sig)``: for each row a 128-bit hash of its set, the set's size and its tokens."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    rng = np.random.default_rng(20240607)
    mult = rng.integers(1, 1 << 63, (tokens, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, (tokens, 1), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            keys, sizes, sigs = [], [], []
            for text in batch.column(2):
                g = word_grams(text.as_py(), words)
                digest = xxhash.xxh3_128_digest(g.tobytes())
                keys.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
                sizes.append(len(g))
                least = np.full((tokens, 1), np.iinfo(np.uint32).max, np.uint32)
                for at in range(0, len(g), 4096):
                    part = ((mult * g[at : at + 4096] + plus) >> np.uint64(32)).astype(np.uint32)
                    least = np.minimum(least, part.min(1, keepdims=True))
                sigs.append(least[:, 0].view(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * tokens), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32)))
            k = np.array(keys, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(sizes, pa.int32()), lists], ["id", "row", "s1", "s2", "n", "sig"])

    return text_batches(rows).mapInArrow(run, "id long, row long, s1 long, s2 long, n int, sig array<int>")


def _children(sets: DataFrame, threshold: float, tokens: int) -> DataFrame:
    """Rows of the children of each (path, set)."""
    def pos(salt: int):
        return F.pmod(F.xxhash64(F.lit(salt), "path"), F.lit(tokens)).cast("int")

    def child(salt: int):
        return F.xxhash64(F.lit(salt), "path", F.element_at("sig", pos(salt) + 1))

    twice = F.pmod(F.xxhash64(F.lit(3), "path"), F.lit(1_000_000)) < int((1 / threshold - 1) * 1_000_000)
    both = twice & (pos(1) != pos(2))
    return sets.withColumn("path", F.explode(F.when(both, F.array(child(1), child(2))).otherwise(F.array(child(1)))))


def _similar(n: np.ndarray, sk: np.ndarray, m: np.ndarray, sl: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of pairs that may reach the threshold: set sizes allow it, sketches are within four deviations."""
    t = sk.shape[1]
    least = least_same(t, threshold)
    ratio = np.minimum(n[:, None], m[None, :]) >= threshold * np.maximum(n[:, None], m[None, :]) - 1e-9
    same = np.zeros(ratio.shape, np.int16)
    for j in range(t):
        same += sk[:, j][:, None] == sl[:, j][None, :]
    return ratio & (same >= least)


def _roots(link: np.ndarray) -> np.ndarray:
    """Least row index reachable from each row of a symmetric boolean matrix."""
    n = len(link)
    root = np.arange(n)
    while True:
        new = np.where(link, root[None, :], n).min(1)
        new = np.minimum(np.minimum(new, root), root[np.minimum(new, root)])
        if (new == root).all():
            return root
        root = new


def _found(ids: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a bucket: each set to the least set it reaches."""
    link = link | link.T
    some = link.any(1)
    root = _roots(link)
    far = some & (root != np.arange(len(ids)))
    return ids[far], ids[root[far]]


def _pairs_schema(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([flat(a), flat(b)], ["a", "b"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def candidates(sets: DataFrame, *, threshold: float = THRESHOLD, tokens: int = TOKENS, recall: float = RECALL, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """``(a, b)``: links between sets that their sketches allow, enough to connect what a bucket holds.

    ``sets``: (sid, n, sig). Rows are (path, sid) pairs; tokens are joined again only for buckets that
    must be split, sketches only for buckets with at least two sets.
    """
    spark = sets.sparkSession
    runs = runs_for(recall, threshold, depth, tokens)
    sketch = sets.select("sid", "n", F.transform("sig", lambda x: (x.bitwiseAND(255) - 128).cast("tinyint")).alias("sk"))
    open_rows = _children(sets.select("sid", "sig", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(runs).cast("long"))).alias("path")), threshold, tokens).select("path", "sid")
    leaves = None
    for level in range(1, depth + 1):
        open_rows = written(open_rows, "paths")
        # Written by itself, so that the join deals out rows alone and a hot bucket can be split.
        size = written(open_rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "bucket-sizes")
        sized = written(open_rows.join(size, "path"), "path-sizes")
        small = sized.where(F.col("size") <= bucket).select("path", "sid")
        leaves = small if leaves is None else leaves.unionByName(small)
        large = sized.where(F.col("size") > bucket)
        if large.isEmpty():
            large = None
            break
        if level < depth:
            open_rows = _children(large.select("path", "sid").join(sets.select("sid", "sig"), "sid"), threshold, tokens).select("path", "sid")

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for group in batch.column(0):
                rows = group.values
                ids, n = rows.field("sid").to_numpy(), rows.field("n").to_numpy()
                sk = rows.field("sk").flatten().to_numpy().reshape(len(ids), -1)
                order = np.argsort(ids)
                a, b = _found(ids[order], _similar(n[order], sk[order], n[order], sk[order], threshold) & ~np.eye(len(ids), dtype=bool))
                out_a.append(a)
                out_b.append(b)
            yield _pairs_schema(out_a, out_b)

    member = F.struct("sid", "n", "sk")
    together = leaves.join(sketch, "sid").groupBy("path").agg(F.collect_list(member).alias("m")).select("m")
    pairs = together.mapInArrow(brute, "a long, b long").distinct()
    if large is not None:
        pairs = pairs.unionByName(_in_blocks(large, sketch, threshold, BLOCK_SETS).distinct())
    return pairs


def _in_blocks(large: DataFrame, sketch: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links within buckets that splitting left large: every pair of blocks of a bucket meets in one group."""
    n_blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = large.withColumn("blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64(F.lit(5), "sid"), F.col("blocks")).cast("int")).join(sketch, "sid")
    turn = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = dealt.select("path", "sid", "n", "sk", "own", turn).select("path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sid", "n", "sk", "own")

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sid")
        ids, n, sk = rows["sid"].to_numpy(), rows["n"].to_numpy(), np.stack(rows["sk"].to_numpy())
        link = _similar(n, sk, n, sk, threshold) & ~np.eye(len(ids), dtype=bool)
        a, b = _found(ids, link)
        return pd.DataFrame({"a": a, "b": b})

    return met.groupBy("path", "i", "j").applyInPandas(meet, "a long, b long")


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)``: each linked node's least reachable node, by alternating star contraction.

    Every round lowers links towards their least neighbour with two joins; rounds grow with the
    logarithm of the number of nodes. Links are rewritten to the shared folder each round.
    """
    links = written(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct(), "links")
    before = None
    while True:
        sym = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Least neighbours are written, so that the joins deal out links alone and a node with very many can be split.
        low = written(sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least-neighbours")
        large = sym.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = written(large, "large-links")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least-neighbours")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = written(small.where(F.col("u") != F.col("v")).distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def _intersections(grams: list[np.ndarray]) -> np.ndarray:
    """Matrix of common n-grams of some sets, over the n-grams that occur in two sets at least."""
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    code, column = np.unique(np.concatenate(grams), return_inverse=True)
    shared = np.flatnonzero(np.bincount(column, minlength=len(code)) > 1)
    place = np.full(len(code), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    common = np.zeros((len(grams), len(grams)), np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, len(shared), 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        dense = np.zeros((len(grams), min(4096, len(shared) - at)), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        common += dense @ dense.T
    return common


def exact_links(grouped: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``(sid, to, links)`` over all pairs within candidate groups: partial link counts and spanning links.

    ``grouped``: (sid, id, row, n, root). Small groups are dealt to shared bins of bounded size; a group
    too large for one block is cut into blocks by hash, and each pair of blocks meets once.
    """
    # Written, so that the join deals out sets alone: a group with a third of all sets can be split.
    sums = written(grouped.groupBy("root").agg(F.sum("n").alias("grams"), F.count(F.lit(1)).alias("sets")), "group-sizes")
    blocks = F.ceil(F.greatest(F.col("grams") / BLOCK_GRAMS, F.col("sets") / BLOCK_SETS)).cast("int")
    total = sums.agg(F.sum("grams")).first()[0] or 0
    bins = max(1, math.ceil(total / BLOCK_GRAMS))
    sized = grouped.join(sums.select("root", blocks.alias("blocks")), "root")
    own = F.pmod(F.xxhash64(F.lit(5), "sid"), F.col("blocks")).cast("int")
    dealt = sized.select("sid", "id", "row", "root", "blocks", own.alias("own"), F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).alias("bin"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    # Most texts belong to no group: they stay where they are read.
    rows = text_batches(rows).where(may_be_in(grouped, "row")("row"))
    with_text = rows.join(dealt.withColumnRenamed("id", "d_id").withColumnRenamed("row", "d_row"), (F.col("id") == F.col("d_id")) & (F.col("row") == F.col("d_row"))).drop("d_id", "d_row", "id", "row")

    def gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            grams = [word_grams(t.as_py(), words).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(grams, pa.binary())], [*batch.schema.names[1:], "grams"])

    # A text that repeats as a row (same id, same text) gives its set twice; once is enough.
    sets = with_text.select("text", "sid", "root", "blocks", "own", "bin").mapInArrow(gram_sets, "sid long, root long, blocks int, own int, bin long, grams binary").dropDuplicates(["sid"])
    turn = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = sets.select("*", turn).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    unit = F.when(F.col("blocks") == 1, F.struct(F.col("bin").alias("k"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))).otherwise(F.struct(F.col("root").alias("k"), "i", "j"))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        frm, to, counts = [], [], []
        for _, group in rows.groupby("root", sort=False):
            group = group.sort_values("sid")
            ids, own = group["sid"].to_numpy(), group["own"].to_numpy()
            grams = [np.frombuffer(g, np.uint64) for g in group["grams"]]
            n = np.array([len(g) for g in grams], np.float64)
            common = _intersections(grams)
            link = (common >= threshold * (n[:, None] + n[None, :] - common) - 1e-9) & ~np.eye(len(ids), dtype=bool)
            counted = link
            if group["blocks"].iloc[0] > 1 and group["i"].iloc[0] != group["j"].iloc[0]:
                counted = link & (own[:, None] != own[None, :])  # pairs within a block are counted where it meets itself
            a, b = _found(ids, link)
            root = dict(zip(a, b))
            frm.append(ids)
            to.append(np.array([root.get(x, x) for x in ids]))
            counts.append(counted.sum(1))
        return pd.DataFrame({"sid": np.concatenate(frm), "to": np.concatenate(to), "links": np.concatenate(counts).astype(np.int64)})

    return met.withColumn("unit", unit).drop("other", "bin").groupBy("unit").applyInPandas(compare, "sid long, to long, links long")


def join(docs: DataFrame, id_col: str, text_col: str, *, words: int = WORDS, threshold: float = THRESHOLD, tokens: int = TOKENS, recall: float = RECALL, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """``(id, row, class_id, class_row, n_links, n_equal)``: one row a document.

    ``class_id``: the least id that a chain of links reaches (its own id without any); ``class_row``: the
    least ``row`` with that id in the class, so that both name its representative; ``n_links``:
    different sets whose similarity to the document's reaches the threshold; ``n_equal``: other
    documents with the same set; ``row``: a hash of the text.
    """
    signed = written(signatures(docs, id_col, text_col, words, tokens), "signatures")
    filled = signed.where(F.col("n") > 0)
    # The least document stands for its set; equal sets are merged in each task before the shuffle.
    heads = filled.groupBy("s1", "s2").agg(F.min(F.struct("id", "row")).alias("head"), F.count(F.lit(1)).alias("rows"))
    heads = written(heads.select("s1", "s2", "head.id", "head.row", "rows", F.xxhash64("s1", "s2").alias("sid")), "set-heads")
    tokens_of = filled.join(heads.select("id", "row"), ["id", "row"], "left_semi").select(F.xxhash64("s1", "s2").alias("sid"), "n", "sig").dropDuplicates(["sid"])
    sets = written(tokens_of, "sets")
    found = components(candidates(sets, threshold=threshold, tokens=tokens, recall=recall, bucket=bucket, depth=depth))
    grouped = found.withColumnRenamed("node", "sid").join(sets.select("sid", "n"), "sid").join(heads.select("sid", "id", "row"), "sid")
    exact = written(exact_links(written(grouped, "candidate-groups"), docs, id_col, text_col, words, threshold), "exact-links")
    counts = exact.groupBy("sid").agg(F.sum("links").alias("n_links"))
    whole = components(exact.where(F.col("sid") != F.col("to")).select(F.col("sid").alias("a"), F.col("to").alias("b")))
    of_set = heads.join(whole.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    # Written, so that the joins below deal out rows alone: a class or a set with a third of all rows can be split.
    of_set = written(of_set, "set-roots")
    named = written(of_set.groupBy("root").agg(F.min(F.struct("id", "row")).alias("least")).select("root", F.col("least.id").alias("class_id"), F.col("least.row").alias("class_row")), "class-names")
    of_set = of_set.join(named, "root").join(counts, "sid", "left").select("s1", "s2", "class_id", "class_row", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("rows") - 1).alias("n_equal"))
    of_set = written(of_set, "set-results")
    rows = filled.select("id", "row", "s1", "s2").join(of_set, ["s1", "s2"]).drop("s1", "s2")
    alone = signed.where(F.col("n") == 0).select("id", "row", F.col("id").alias("class_id"), F.col("row").alias("class_row"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_equal"))
    named_null = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c)).alias(c)
    return rows.unionByName(alone).select(named_null("id"), "row", named_null("class_id"), "class_row", "n_links", "n_equal").withColumnRenamed("id", id_col)
