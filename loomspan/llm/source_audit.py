"""Source divergence audit: how far the sources of a language are from each other, and which terms set each apart.

Single-pass in-memory indexing. Tasks read texts once and gather postings (term, source, occurrences,
documents) of a block until its memory bound is reached, then give the block out as a run sorted by
(shard, language, term), cut to chunks. Shards of runs meet in one task each, which merges the chunks of
all runs through a heap, in the order of their first terms, and so streams whole frequencies term by term.
A pair of sources differs on every kept term of its language, but most terms are missing on both sides,
where all prices are alike: a pair's value is that constant, plus one correction for the counts that occur
on each side (from histograms of counts), plus one for each term that occurs on both, which tasks stream
term by term and sum before they give it out.

Terms are runs of letters A-Z and of code points from 128 on; only A-Z is lower-cased. Each row is a
document. Null language, source and text are empty strings. A group without terms, and a language without
a kept term, still has its pairs (value 0 where the language keeps none). Repeated rows count as often as
they stand there; an empty table gives no row. Other columns are not read. Very long texts are taken apart
a megabyte at a time.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.support import partitions, text_batches, written

MIN_DOCS, TOP = 3, 200
UNIT = 1_000_000_000
BLOCK_POSTINGS, BLOCK_TERMS = 1 << 21, 1 << 19  # of a block, before it is given out as a run
CHUNK_TERMS = 512
SHARDS_A_TASK = 4
PAIRS_AT_ONCE = 1 << 20
_PIECE = 1 << 20
# Terms' bytes as they are, A-Z lower-cased, all else as spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GROUP = b""  # stands for the group itself in the frequencies: no term is empty

RUN = "shard int, lang string, first binary, terms array<binary>, docs array<bigint>, stops array<int>, sources array<string>, counts array<bigint>"
FREQUENCIES = "lang string, term string, n_docs bigint, sources array<string>, counts array<bigint>"
_Batches = Iterator[pa.RecordBatch]


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, a piece at a time; pieces end between terms."""
    at = 0
    while at < len(text):
        stop = at + _PIECE
        piece = text[at:stop].translate(_FOLD)
        while stop < len(text) and not piece.endswith(b" "):  # on to the end of the term
            more = text[stop : stop + 4096].translate(_FOLD)
            cut = more.find(b" ") + 1 or len(more)
            piece, stop = piece + more[:cut], stop + cut
        yield piece.split()
        at = stop


class _Block:
    """Postings in memory: term numbers and counts of each document, by group."""

    def __init__(self) -> None:
        self.numbers = itertools.count()
        self.terms: dict[str, defaultdict] = {}  # language -> term -> number
        self.groups: dict[tuple[str, str], int] = {}
        self.at: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.of: list[int] = []
        self.size = self.known = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        if lang not in self.terms:
            self.terms[lang] = defaultdict(self.numbers.__next__)
        ids = self.terms[lang]
        parts = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in terms_of(text) if words]
        tallies = [np.unique(p, return_counts=True) for p in [*parts, np.array([ids[_GROUP]])]]
        at, counts = (np.concatenate(x) for x in zip(*tallies))
        if len(tallies) > 2:  # a document's pieces are one document
            at, back = np.unique(at, return_inverse=True)
            total = np.zeros(len(at), np.int64)
            np.add.at(total, back, counts)
            counts = total
        self.at.append(at)
        self.counts.append(counts)
        self.of.append(self.groups.setdefault((lang, source), len(self.groups)))
        self.size += len(at)
        self.known = sum(map(len, self.terms.values()))

    @property
    def full(self) -> bool:
        return self.size >= BLOCK_POSTINGS or self.known >= BLOCK_TERMS

    def run(self, shards: int) -> _Batches:
        """The block as a run: chunks of its terms by (shard, language, term), each with its postings by source."""
        if not self.at:
            return
        groups = sorted(self.groups, key=lambda g: (g[0], g[1].encode()))
        place = np.empty(len(groups), np.int64)
        place[[self.groups[g] for g in groups]] = np.arange(len(groups))
        order = sorted((zlib.crc32(t, zlib.crc32(lang.encode())) % shards, lang.encode(), t, n) for lang, ids in self.terms.items() for t, n in ids.items())
        rank = np.empty(len(order), np.int64)
        rank[[x[3] for x in order]] = np.arange(len(order))
        key = rank[np.concatenate(self.at)] * len(groups) + np.repeat(place[self.of], [len(x) for x in self.at])
        by = np.argsort(key, kind="stable")
        key, counts = key[by], np.concatenate(self.counts)[by]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        docs, counts, key = np.diff(np.r_[begins, len(key)]), np.add.reduceat(counts, begins), key[begins]
        term, group = key // len(groups), key % len(groups)
        first = np.searchsorted(term, np.arange(len(order) + 1))  # of each term's postings
        n_docs = np.add.reduceat(docs, first[:-1])
        home = [x[:2] for x in order]
        turns = [0, *(i for i in range(1, len(order)) if home[i] != home[i - 1]), len(order)]
        cuts = [0, *(c for a, b in zip(turns, turns[1:]) for c in [*range(a + CHUNK_TERMS, b, CHUNK_TERMS), b])]
        names = pa.array([s for _, s in groups]).take(pa.array(group))
        words = pa.array([x[2] for x in order], pa.binary())
        at, posts = pa.array(cuts, pa.int32()), pa.array(first[cuts], pa.int32())
        stops = first[1:] - np.repeat(first[cuts[:-1]], np.diff(cuts))
        heads = [order[i] for i in cuts[:-1]]
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in heads], pa.int32()), pa.array([x[1].decode() for x in heads]), pa.array([x[2] for x in heads], pa.binary()),
                pa.ListArray.from_arrays(at, words), pa.ListArray.from_arrays(at, pa.array(n_docs, pa.int64())), pa.ListArray.from_arrays(at, pa.array(stops, pa.int32())),
                pa.ListArray.from_arrays(posts, names), pa.ListArray.from_arrays(posts, pa.array(counts, pa.int64())),
            ],
            ["shard", "lang", "first", "terms", "docs", "stops", "sources", "counts"],
        )
        for a in range(0, batch.num_rows, 256):
            yield batch.slice(a, 256)


def _index(shards: int) -> Callable[[_Batches], _Batches]:
    def run(batches: _Batches) -> _Batches:
        block = _Block()
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block.add(lang, source, text.as_py())
                if block.full:
                    yield from block.run(shards)
                    block = _Block()
        yield from block.run(shards)

    return run


def _merge(min_docs: int) -> Callable[[_Batches], _Batches]:
    """Heap-merge of chunks that come by (shard, language, first term): a term is whole once no open chunk holds it and the next chunk begins after it."""

    def run(batches: _Batches) -> _Batches:
        heap: list[tuple[bytes, int]] = []  # next term of each open chunk
        chunks: dict[int, list] = {}  # number -> [terms, docs, stops, sources, counts, place]
        out: list[tuple] = []
        numbers = itertools.count()
        home: tuple = ()

        def closed(before: bytes | None) -> Iterator[None]:
            """Terms less than ``before`` (all, if None) go out."""
            while heap and (before is None or heap[0][0] < before):
                term, n_docs, sources, counts = heap[0][0], 0, [], []
                while heap and heap[0][0] == term:
                    n = heap[0][1]
                    c = chunks[n]
                    i = c[5]
                    a, b = c[2][i - 1] if i else 0, c[2][i]
                    n_docs += c[1][i]
                    sources += c[3][a:b]
                    counts += c[4][a:b]
                    if i + 1 < len(c[0]):
                        c[5] = i + 1
                        heapq.heapreplace(heap, (c[0][i + 1], n))
                    else:
                        heapq.heappop(heap)
                        del chunks[n]
                if term == _GROUP or n_docs >= min_docs:
                    total: dict[str, int] = {}
                    for s, x in zip(sources, counts):
                        total[s] = total.get(s, 0) + x
                    out.append((home[1], term.decode("utf-8", "replace"), n_docs, list(total), list(total.values())))
                    if len(out) >= 4096:
                        yield

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*out))
            types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["lang", "term", "n_docs", "sources", "counts"])
            out.clear()
            return done

        for batch in batches:
            shard, lang = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                chunk = [batch.column(k)[i].as_py() for k in range(3, 8)]
                here = (shard[i], lang[i])
                for _ in closed(chunk[0][0] if here == home else None):
                    yield flushed()
                home = here
                n = next(numbers)
                chunks[n] = [*chunk, 0]
                heapq.heappush(heap, (chunk[0][0], n))
        for _ in closed(None):
            yield flushed()
        if out:
            yield flushed()

    return run


def frequencies(docs: DataFrame, text_col: str, lang_col: str, source_col: str, *, min_docs: int = MIN_DOCS) -> DataFrame:
    """``FREQUENCIES``: the terms in at least ``min_docs`` documents of a language, with their occurrences by source; the empty term has the documents of every group."""
    n = partitions(docs)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    runs = text_batches(named).mapInArrow(_index(n * SHARDS_A_TASK), RUN)
    dealt = runs.repartition(n, "shard").sortWithinPartitions("shard", "lang", "first")
    return dealt.mapInArrow(_merge(min_docs), FREQUENCIES)


def _price(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (n + v)), exact at any count; null where v is 0."""
    wide = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.when(v > 0, F.call_function("div", wide, (n + v).cast("decimal(20,0)")) + 1)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _both(batches: _Batches) -> _Batches:
    """Sums of the corrections of pairs of sources over the terms that both have; rows (lang, term, sid, p, p0) come term by term."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def sums(t: pa.Table) -> _Batches:
        lang, term = t.column(0).combine_chunks(), t.column(1).combine_chunks()
        sid, p, p0 = (t.column(i).to_numpy() for i in (2, 3, 4))
        same = lambda x: pc.equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False) if len(x) > 1 else np.zeros(0, bool)
        starts = np.flatnonzero(np.r_[True, ~(same(lang) & same(term))])
        length = np.diff(np.r_[starts, len(sid)])
        a, k = np.repeat(starts, length), np.repeat(length, length)
        code = lang.dictionary_encode()
        names, number = code.dictionary, code.indices.to_numpy().astype(np.int64)
        width = int(sid.max()) + 1
        upto = np.cumsum(k)
        lo = 0
        while lo < len(k):  # rows whose pairs fit
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            i = np.repeat(np.arange(lo, hi), k[lo:hi])
            j = np.arange(len(i)) - np.repeat(np.r_[0, np.cumsum(k[lo:hi])[:-1]], k[lo:hi]) + a[i]
            apart = i != j
            i, j = i[apart], j[apart]
            value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
            keys, back = np.unique((number[i] * width + sid[i]) * width + sid[j], return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, back, value)
            if len(keys):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(keys // width // width)), pa.array(keys // width % width), pa.array(keys % width), pa.array(total)], ["lang", "sid", "tid", "value"])
            lo = hi

    held: pa.Table | None = None  # rows of the term that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        lang, term = t.column(0), t.column(1)
        last = pc.and_(pc.equal(lang, lang[-1]), pc.equal(term, term[-1])).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(last))
        if cut:
            yield from sums(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None:
        yield from sums(held)


def audit(docs: DataFrame, text_col: str, lang_col: str, source_col: str, *, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` sets each source beside each other one of its language, part ``term`` lists the terms that a source has more often than its language."""
    found = written(frequencies(docs, text_col, lang_col, source_col, min_docs=min_docs), "term-frequencies")
    groups = found.where("term = ''").select("lang", F.explode("sources").alias("source"))
    kept = found.where("term <> ''")
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    flat = kept.select("lang", "term", total.alias("all_count"), F.explode(F.arrays_zip("sources", "counts")).alias("z")).select("lang", "term", "all_count", F.col("z.sources").alias("source"), F.col("z.counts").alias("count"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(total).alias("all_n"))
    sizes = flat.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = F.lit(0).cast("bigint")
    sid = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint")
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"), F.coalesce("all_n", zero).alias("all_n"))
    groups = written(groups.withColumns({"sid": sid, "p0": _price(zero, F.col("n"), F.col("v"))}), "term-groups")
    priced = flat.join(groups, ["lang", "source"]).withColumns({"p": _price(F.col("count"), F.col("n"), F.col("v")), "q": _price(F.col("all_count"), F.col("all_n"), F.col("v"))})

    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("sid").alias("tid"), F.col("p0").alias("q0"))
    p, p0, q0, n = F.col("p"), F.col("p0"), F.col("q0"), F.col("n")
    shared = priced.select("lang", "term", "sid", "p", "p0").repartition(partitions(found), "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_both, "lang string, sid bigint, tid bigint, value bigint")
    counts = written(priced.groupBy("lang", "sid", "p", "p0").agg(F.count("*").alias("n")), "term-histograms")
    beside = counts.join(other, "lang").where("sid <> tid")
    given = beside.select("lang", "sid", "tid", (n * (_apart(p, q0) - _apart(p0, q0))).alias("value"))
    taken = beside.select("lang", F.col("tid").alias("sid"), F.col("sid").alias("tid"), (n * (_apart(q0, p) - _apart(q0, p0))).alias("value"))
    same = groups.join(other, "lang").where("sid <> tid").select("lang", "sid", "tid", F.coalesce(F.col("v") * _apart(p0, q0), zero).alias("value"))
    sums = same.unionByName(shared).unionByName(given).unionByName(taken).groupBy("lang", "sid", "tid").agg(F.sum("value").alias("value"))
    named = groups.select("lang", "sid", "source")
    pairs = sums.join(named, ["lang", "sid"]).join(named.select("lang", F.col("sid").alias("tid"), F.col("source").alias("item")), ["lang", "tid"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(own))
    return pairs.unionByName(terms)
