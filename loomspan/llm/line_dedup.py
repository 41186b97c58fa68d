"""Line dedup: range-partitioned line hashes, streamed in order, kept lines as compressed bitmaps.

Hashes of the line keys are range-partitioned by (hash, document) and sorted by (hash, largest
document first, position). A range cut may fall inside one hash, so a line that a third of all
documents hold is spread over many tasks. Each task streams its sorted rows once, with a constant
state per run. Only the first and the last run of a task can continue in another one; their few
totals are written and joined back, so Spark sees their size. Hashes are written once, because range cuts need a pass over them before the
one that deals them out. Results are bitmaps by document; the text is touched again only to apply
them.

A document is a doc_id. Rows with the same doc_id count as one document; rows that also have the
same text are the same row and get the same bitmap. A null doc_id counts as one document, smaller
than all others. Null and empty texts have one empty line. Columns other than the two named are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.support import may_be_in, partitions, text_batches, written

MIN_CHARS, MIN_DOCS = 20, 3
_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NULL_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _UPPER.lower())


def _runs(min_docs: int):
    """Stream sorted (h1, h2, doc, row, pos); give rows to drop (drop), rows of a run that may go on
    in another task (open), and one row of totals for each such run (pos null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "doc", "row", "pos", "n_docs"]

        def out(cols: list[np.ndarray], mask: np.ndarray, n_docs: int) -> pa.RecordBatch:
            """n_docs: 0 for rows to drop, 1 for open rows."""
            arrays = [pa.array(c[mask]) for c in cols]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(int(mask.sum()), n_docs, np.int64))], names)

        def totals(key, n_docs: int, most: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((key[0], pa.int64()), (key[1], pa.int64()), (most, pa.int64()), (0, pa.int64()), (None, pa.int32()), (n_docs, pa.int64()))], names)

        key = None  # of the run that the last batch ended in
        first = True  # that run is the task's first
        most = last_doc = rank = 0  # its largest document, its latest document, its documents so far
        second: list[list[np.ndarray]] = []  # its rows of rank 2, while it has no rank min_docs
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            h1, h2, doc = cols[:3]
            new_run = np.r_[key is None or (h1[0], h2[0]) != key, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_run | np.r_[doc[0] != last_doc, doc[1:] != doc[:-1]]
            if new_run[0] and key is not None:  # the run before is complete and not the task's last
                if first:
                    yield totals(key, rank, most)
                    first = False
                second = []
            run_id = np.cumsum(new_run)  # 0: goes on from the last batch
            count = np.cumsum(new_doc)
            starts = np.flatnonzero(new_run)
            base = np.zeros(int(run_id[-1]) + 1, np.int64)
            base[0] = -rank
            base[1:] = count[starts] - 1
            ranks = count - base[run_id]
            ends = np.r_[starts[1:] - 1 if new_run[0] else starts - 1, len(doc) - 1]  # of each run present
            size = np.zeros(len(base), np.int64)
            size[run_id[ends]] = ranks[ends]
            is_first = (run_id == run_id[0]) if (first and (not new_run[0] or key is None)) else np.zeros(len(doc), bool)
            last_run = run_id == run_id[-1]
            drop = ~is_first & (ranks >= 2) & (size[run_id] >= min_docs)
            if drop.any():
                yield out(cols, drop, 0)
            if is_first.any():
                yield out(cols, is_first, 1)
            if not new_run[0] and second and not is_first[0]:
                if size[0] >= min_docs:
                    for kept in second:
                        yield out(kept, np.ones(len(kept[0]), bool), 0)
                    second = []
                elif run_id[-1] > 0:
                    second = []
            if first and not is_first[-1]:  # the first run ended within this batch
                at = int(np.flatnonzero(is_first)[-1])
                yield totals((int(h1[at]), int(h2[at])), int(ranks[at]), most if not new_run[0] else int(doc[0]))
                first = False
            wait = last_run & ~is_first & (ranks >= 2) & (size[run_id] < min_docs)
            if wait.any():
                second.append([c[wait] for c in cols])
            if run_id[-1] > 0:  # the last run began in this batch
                most = int(doc[starts[-1]])
            key, last_doc, rank = (int(h1[-1]), int(h2[-1])), int(doc[-1]), int(ranks[-1])
        if key is not None:
            yield totals(key, rank, most)
            for kept in second if not first else ():
                yield out(kept, np.ones(len(kept[0]), bool), 1)

    return run


def keep_bitmaps(docs: DataFrame, id_col: str, text_col: str, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(doc, row, dropped, keep_bitmap)`` for each row of ``docs`` that loses a line.

    ``doc`` is the id (nulls: the smallest long), ``row`` a hash of the text. ``keep_bitmap`` holds
    one bit a line (1: kept), packed little-endian and deflated, up to the last line that is lost;
    all lines after it are kept, and so are all lines of documents not listed.
    """
    lines = docs.select(_doc(id_col).alias("doc"), F.xxhash64(text_col).alias("row"), F.posexplode(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), line_key)).alias("pos", "key"))
    hashes = lines.where(F.char_length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc", "row", "pos")
    ordered = written(hashes, "line-hashes").repartitionByRange(partitions(docs), "h1", "h2", F.desc("doc")).sortWithinPartitions("h1", "h2", F.desc("doc"), "row", "pos")
    found = written(ordered.mapInArrow(_runs(min_docs), "h1 long, h2 long, doc long, row long, pos int, n_docs long"), "line-runs")
    sure = found.where((F.col("n_docs") == 0) & F.col("pos").isNotNull()).select("doc", "row", "pos")
    whole = found.where(F.col("pos").isNull()).groupBy("h1", "h2").agg(F.sum("n_docs").alias("docs"), F.max("doc").alias("most")).where(F.col("docs") >= min_docs)
    whole = written(whole, "run-totals")  # from at most two rows a task
    unsure = found.where((F.col("n_docs") == 1) & F.col("pos").isNotNull()).join(whole, ["h1", "h2"]).where(F.col("doc") < F.col("most")).select("doc", "row", "pos")
    lost = sure.unionByName(unsure).groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("lost"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, maps = [], []
            for at in batch.column(2):
                at = np.asarray(at.values)
                bits = np.ones(int(at[-1]) // 8 * 8 + 8, np.uint8)  # whole bytes
                bits[at] = 0
                n.append(len(at))
                maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(maps, pa.binary())], ["doc", "row", "dropped", "keep_bitmap"])

    return lost.mapInArrow(pack, "doc long, row long, dropped long, keep_bitmap binary")


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))


def _without(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    """The lines of texts that their bitmaps keep; all lines without a bitmap."""
    def one(t: str, b: bytes | None) -> str:
        if b is None:
            return t
        lines = t.split("\n")
        kept = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), bitorder="little")[: len(lines)]
        return "\n".join(x for x, keep in zip(lines, np.pad(kept, (0, len(lines) - len(kept)), constant_values=1)) if keep)

    return text.combine(bitmap, one)


def kept_text(docs: DataFrame, id_col: str, text_col: str, bitmaps: DataFrame, *, text_out: str = "kept_text", dropped_out: str = "n_dropped") -> DataFrame:
    """``docs`` plus the text that is kept and the number of lines dropped, under the names given.

    A column of ``docs`` that has one of these two names gives way to the result; choose other names to
    keep it. Rows whose text hash no bitmap has stay where they are read; only the others are shuffled to meet the bitmaps.
    """
    docs = docs.drop(*[c for c in (text_out, dropped_out) if c not in (id_col, text_col)])
    doc, row, lost, kept = "__line_doc", "__line_row", "__line_lost", "__line_map"
    small = written(bitmaps.select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("dropped").alias(lost), F.col("keep_bitmap").alias(kept)), "keep-bitmaps")
    keyed = docs.withColumns({doc: _doc(id_col), row: F.xxhash64(text_col)})
    text = F.coalesce(F.col(text_col), F.lit(""))
    listed = may_be_in(small, row)(row)
    same = keyed.where(~listed).withColumns({text_out: text, dropped_out: F.lit(0).cast("long")})
    met = text_batches(keyed.where(listed).join(small, [doc, row], "left"))
    met = met.withColumns({text_out: F.pandas_udf(_without, "string")(text, F.col(kept)), dropped_out: F.coalesce(lost, F.lit(0).cast("long"))})
    return same.drop(doc, row).unionByName(met.drop(doc, row, lost, kept))
