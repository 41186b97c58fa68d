"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Edge cases: a null text counts as empty (no tokens; hash of no bytes). Every row gives one row,
repeated ids included; other columns are never read. Very long texts are cut at places that no
match of the pattern crosses, so the ids are those of the whole text; a long run of any white space
is one match and is merged as such, because the library's pattern matcher would overflow its stack.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.support import text_batches

#: Characters after which a long text is cut at the next safe place.
PIECE_CHARS = 1 << 16

# What the library's patterns count as white space (Unicode's property; Python's \\s has more).
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# No match spans a change from non-space to space, so a cut before such a space changes nothing.
_WORD_END = re.compile(r"(?<=\S)[ \n]")
# A run of spaces before a word is one match up to its last space, which starts the next match; at the end, all of it.
_SPACE_RUN = re.compile(rf"(?<![{_SPACES}])[{_SPACES}]{{256,}}(?=[^{_SPACES}]|\Z)")
_ALL_SPACE = re.compile(rf"[{_SPACES}]{{255,}}")

_LOADED: dict[tuple[str, str], tiktoken.Encoding] = {}


def load(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; each Python worker loads it once."""
    if (rank_file, pattern) not in _LOADED:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _LOADED[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[rank_file, pattern]


def safe_pieces(text: str, piece_chars: int = PIECE_CHARS) -> list[str]:
    """Cut a text where the pre-splitting pattern ends a match in any case; joined they are the text."""
    if len(text) <= piece_chars:
        return [text]
    cuts = {at for m in _SPACE_RUN.finditer(text) for at in (m.start(), m.end() - (m.end() < len(text)))}
    at = piece_chars
    while at < len(text) and (m := _WORD_END.search(text, at)):
        cuts.add(m.start())
        at = m.start() + piece_chars
    bounds = [0, *sorted(cuts - {0, len(text)}), len(text)]
    return [text[a:b] for a, b in zip(bounds, bounds[1:])]


def encode_text(enc: tiktoken.Encoding, text: str, piece_chars: int = PIECE_CHARS) -> list[int]:
    if len(text) <= piece_chars:
        return enc.encode_ordinary(text)
    # The library's pattern matcher backtracks over a long run of spaces; the run is one match, so it is merged as it is.
    one = lambda piece: enc._encode_single_piece(piece) if _ALL_SPACE.fullmatch(piece) else enc.encode_ordinary(piece)
    return [i for piece in safe_pieces(text, piece_chars) for i in one(piece)]


def encode(docs: DataFrame, id_col: str, text_col: str, *, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``(id, token_ids array<int>)`` for each row of ``docs``; row-local, no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encode_text(enc, t, piece_chars) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "token_ids"])

    return text_batches(rows).mapInArrow(run, "id long, token_ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str, ids_col: str, *, rank_file: str, pattern: str) -> DataFrame:
    """``(id, raw binary)``: the bytes of each row's ids, which need not be valid UTF-8 by themselves."""
    rows = tokens.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(rank_file, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "raw"])

    return text_batches(rows).mapInArrow(run, "id long, raw binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str, text_col: str, *, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS, with_ids: bool = False) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encode and decode in one pass.

    Without ``with_ids`` the token ids stay inside the task and a few bytes a document leave it; with
    it they are returned as ``token_ids array<int>``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed, of_raw = [], []
                for text in part.column(1):
                    ids = encode_text(enc, text.as_py(), piece_chars)
                    packed.append(np.array(ids, "<u4"))
                    of_raw.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                counts = np.array([len(x) for x in packed], np.int64)
                of_ids = [hashlib.sha256(x.tobytes()).hexdigest() for x in packed]
                columns = [part.column(0), pa.array(counts), pa.array(of_ids, pa.string()), pa.array(of_raw, pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, counts.cumsum()].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, "<u4"), *packed]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return text_batches(rows).mapInArrow(run, schema).withColumnRenamed("id", id_col)
