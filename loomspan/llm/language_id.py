"""Language identification by rank-order n-gram profiles (out-of-place distance).

Grams: one to three letters of a word, lower-cased, with a mark at each word end. A language's
profile is its most frequent grams over all labelled documents; a document's distance to a
profile is the sum, over the document's own most frequent grams, of how far out of place each
gram is (the profile's length if it is missing). The nearest profile wins; ties go to the
smaller name.

Edge cases: null texts and texts without a letter are ``und`` with score 0; so is everything if
nothing is labelled. Null or repeated ids change nothing; other columns are not read. Very long
texts are counted piece by piece, whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from loomspan.llm.support import text_batches, written

PROFILE = 400  # grams of a profile
UNDETERMINED = "und"
LANGUAGES_A_PASS = 256  # whose profiles are broadcast together, at most PROFILE rows each
_PIECE = 1 << 20
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """1 where a code point is a letter; built once a worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _counts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of a padded run of code points (0: between words) and their counts."""
    a, b, c = code[:-2], code[1:-1], code[2:]
    inner = b > 0
    b1, two = b[inner], np.uint64(1 << 21)
    left, right = a[inner], c[inner]
    tri = ((left + np.uint64(1)) * two + b1) * two + right  # the +1 keeps three symbols apart from two
    bi = b1 * two + right  # letter and what follows
    lead = (np.uint64(0x1FFFFF) * two + b1)[left == 0]  # word start and letter
    return np.unique(np.concatenate([b1, bi, lead, tri]), return_counts=True)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Gram codes (int64) and counts of a whole text."""
    parts = []
    for at in range(0, len(text), _PIECE):
        piece = text[max(0, at - 1) : at + _PIECE + 1]
        code = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        code = np.where(_letters()[code.astype(np.int64)], code, np.uint64(0))
        code = np.concatenate([code if at else np.r_[np.uint64(0), code], np.zeros(1 if at + _PIECE >= len(text) else 0, np.uint64)])
        if len(code) >= 3:
            parts.append(_counts(code))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, counts = parts[0]
    if len(parts) > 1:
        codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)
    return codes.view(np.int64), counts


def top(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent grams, most frequent first, ties by code."""
    if len(codes) > n:  # only what can be among the first n is sorted
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:n]


def learn(docs: DataFrame, text_col: str, lang_col: str, *, profile: int = PROFILE) -> DataFrame:
    """``(lang, gram, rank)``: profiles over all rows with a text and a language.

    Tasks add up grams by language before the shuffle, which moves distinct grams only, so a
    language with a third of the rows costs no more than another.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)
                held[lang] = [(codes, total)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(total)], ["lang", "gram", "n"])

        def merge() -> int:
            for lang, parts in held.items():
                codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                held[lang] = [(codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64))]
            return sum(len(p[0][0]) for p in held.values())

        limit = 4_000_000
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                found = grams(text.as_py())
                held.setdefault(lang, []).append(found)
                size += len(found[0])
                if size > limit:
                    size = merge()
                    if size > limit // 2:  # many rare grams: hand them on and start anew
                        yield from flush()
                        held.clear()
                        size = 0
        yield from flush()

    totals = text_batches(rows).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return totals.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= profile).select("lang", "gram", "rank")


def predict(docs: DataFrame, id_col: str, text_col: str, profiles: DataFrame, *, profile: int = PROFILE) -> DataFrame:
    """``(id, lang_pred, score, has_letter)``; the id may be of any type. Score is 1 less the nearest distance over the greatest possible one.

    Texts pass the profiles of LANGUAGES_A_PASS languages at a time, in the order of their names, so that
    what a task holds does not grow with their number.
    """
    kept = written(profiles, "language-profiles")
    names = Window.orderBy("lang")  # one row a language
    numbered = written(kept.select("lang").distinct().withColumn("turn", F.floor((F.row_number().over(names) - 1) / LANGUAGES_A_PASS)), "languages")
    passes = numbered.agg(F.max("turn")).first()[0]
    start = [StructField("id", docs.schema[id_col].dataType)]
    text = [StructField("text", StringType())]
    answer = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("has_letter", BooleanType())]
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("has_letter"))
    last = passes if passes is not None else 0
    for turn in range(last + 1):
        mine = kept.join(numbered.where(F.col("turn") == turn), "lang").select("lang", "gram", "rank")
        carry = turn < last  # for the passes to come
        found = text_batches(found).mapInArrow(_nearer(_slab(mine), profile, carry), StructType(start + (text if carry else []) + answer))
    return found.select(F.col("id").alias(id_col), F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), "score", "has_letter")


def _slab(profiles: DataFrame) -> Broadcast:
    """At most LANGUAGES_A_PASS profiles as one list of places: names, grams, where each gram's places begin, and the places (language, rank) by gram."""
    places = list(profiles.toLocalIterator())
    langs = sorted({p.lang for p in places})
    number = {lang: i for i, lang in enumerate(langs)}
    rows = np.array(sorted((p.gram, number[p.lang], p.rank) for p in places), np.int64).reshape(-1, 3)
    known, begin = np.unique(rows[:, 0], return_index=True)
    begin = np.append(begin, len(rows))
    return profiles.sparkSession.sparkContext.broadcast((langs, known, begin, rows[:, 1].astype(np.int32), rows[:, 2].astype(np.int32)))


def _nearer(shared: Broadcast, profile: int, with_text: bool) -> Callable:
    """A pass over texts: the language of this slab, if it is nearer than what was found before it. Earlier names win ties."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, known, begin, lang, rank = shared.value
        for batch in batches:
            pred, score, letter = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            for i, text in enumerate(batch.column(1)):
                mine = top(*grams(text.as_py() or ""), profile)
                letter.append(len(mine) > 0)
                if not len(mine) or not langs:
                    continue
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                mine_place = np.flatnonzero(known[at] == mine)
                at = at[mine_place]
                n = begin[at + 1] - begin[at]  # languages that have the gram
                entry = np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                off = np.minimum(np.abs(rank[entry] - np.repeat(mine_place + 1, n)), profile)
                away = profile * len(mine) + np.bincount(lang[entry], off - profile, len(langs))
                best = int(away.argmin())
                near = 1.0 - float(away[best]) / (profile * len(mine))
                if pred[i] is None or near > score[i]:
                    pred[i], score[i] = langs[best], near
            text = {"text": batch.column(1)} if with_text else {}
            out = {"id": batch.column(0), **text, "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "has_letter": pa.array(letter, pa.bool_())}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run
