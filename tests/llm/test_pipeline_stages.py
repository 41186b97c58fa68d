"""Each stage of the pipeline against brute force, on a table with nulls, repeated rows and clashing names."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from loomspan.llm import bpe, mixing
from tests.llm.test_operators import brute_lines, brute_links

SF = "/root/testdata/sf0.001"
NAMES = ["n_dropped", "kept_text", "lang_pred", "row", "size", "taken", "doc", "class_id", "has_letter", "token_ids", "__x"]


@pytest.fixture(scope="module")
def docs(spark):
    """Given documents beside odd rows; every clashing column holds a value of its own."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    words = " ".join(f"word{i}" for i in range(60))
    odd = [(None, words, "en", "s", 1), (900, words, None, None, 1), (901, words + " more", "en", "s", 1), (902, None, "en", "s", None), (903, "", None, "s", 0), (904, "12 34", "en", "s", 5), (905, "one line\nA line that stands in three documents\nlast", "en", "s", 1), (906, "a line THAT stands in three documents", "en", "t", 1), (907, "A line that stands in three documents ", "en", "t", 1)]
    table = base.unionByName(spark.createDataFrame(odd, base.schema)).unionByName(spark.createDataFrame(odd[:1], base.schema))
    return table.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in NAMES}).cache()


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES[:-1]], ids=[n for n, _ in cp.STAGES[:-1]])
def test_clashing_columns_keep_their_values(spark, docs, stage):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    for r in out.collect():
        assert all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for c in NAMES)


def test_language_stage_rejects_texts_without_a_letter_only(spark, docs):
    want = sorted(((r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or "")), key=str)
    assert kept(cp.identify_language(spark, docs, SF)) == want


def test_line_stage_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(i, new if new != (t or "") else t) for (i, t), (_, new) in zip(rows, brute_lines(rows)) if new == (t or "") or new.strip(" ")]
    assert kept(cp.drop_repeated_lines(spark, docs, SF)) == sorted(want, key=str)


def test_near_duplicate_stage_equals_brute_force(spark, docs):
    plain = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text) for r in plain.collect()]
    classes = brute_links(rows)
    assert {r.doc_id for r in cp.drop_near_duplicates(spark, plain, SF).collect()} == {i for i, _ in rows if classes[i][0][0] == i}
    ids = [r.doc_id for r in cp.drop_near_duplicates(spark, docs, SF).collect()]
    assert ids.count(None) == 1 and not {900, 901} & set(ids)  # the null id is the least of its group and stays, once


def test_mix_stage_repeats_by_what_is_taken(spark, docs):
    plain = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    taken = {r.doc_id: r for r in mixing.mix(plain, "doc_id", "text", "source").collect()}
    want = {i: int(r.taken / r.size + 0.5) for i, r in taken.items() if r.size and int(r.taken / r.size + 0.5)}
    assert collections.Counter(r.doc_id for r in cp.mix_sources(spark, plain, SF).collect()) == want


def test_encode_stage_equals_the_library(spark, docs):
    enc = bpe.load(**cp.tokenizer())
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    for r in cp.encode(spark, docs, SF).collect():
        ids = enc.encode_ordinary(texts[r.doc_id][0])
        assert r.token_ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id][0].encode()).hexdigest()
