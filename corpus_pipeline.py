"""A corpus pipeline of five operators: each stage takes what the one before kept."""

from __future__ import annotations

import uuid
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import bpe, jaccard_join, language_id, line_dedup, mixing
from loomspan.llm.support import scratch, written

_ID, _ROW, _TEXT, _LOST = "__stage_id", "__stage_row", "__stage_text", "__stage_lost"


def tokenizer() -> dict[str, str]:
    """Rank file and pre-splitting pattern of the production tokenizer."""
    return {"rank_file": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all documents whose language is given; documents without any letter go; a missing language is filled in if any was learnt.

    Null texts have no letter and go. Null ids are ordinary; repeated rows all stay or all go. Columns
    not named are carried along, whatever their names.
    """
    profiles = language_id.learn(docs, "text", "lang")
    keyed = docs.withColumns({_ID: F.struct("doc_id", F.xxhash64("text").alias("row"))})
    found = language_id.predict(keyed, _ID, "text", profiles).where("has_letter")
    known = F.when(F.col("lang_pred") != language_id.UNDETERMINED, F.col("lang_pred"))
    found = found.select(F.col(_ID)["doc_id"].alias(_ID), F.col(_ID)["row"].alias(_ROW), known.alias("__lang")).dropDuplicates([_ID, _ROW])
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col(_ID)) & (F.xxhash64(docs["text"]) == F.col(_ROW)))
    return joined.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents stay in one document only; documents left without text go.

    Rows with one id are one document; a null id is one document, the least. Documents that lose no line
    stay as they are, empty ones too. Columns not named are carried along, whatever their names.
    """
    kept = line_dedup.kept_text(docs, "doc_id", "text", line_dedup.keep_bitmaps(docs, "doc_id", "text"), text_out=_TEXT, dropped_out=_LOST)
    changed = F.col(_LOST) > 0
    out = kept.where(~changed | (F.trim(_TEXT) != ""))
    out = out.withColumn("n_chars", F.when(changed, F.char_length(_TEXT).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.when(changed, F.col(_TEXT)).otherwise(F.col("text"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: the least by id (null first), then text hash, then the other columns.

    Rows with one id and like texts are a group as any other. Texts without a word are no group and stay.
    Columns not named are carried along, whatever their names.
    """
    classes = written(jaccard_join.join(docs, "doc_id", "text"), "classes")
    head = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("row") == F.col("class_row"))
    key = [F.col("doc_id").alias(_ID), F.col("row").alias(_ROW)]
    same = docs["doc_id"].eqNullSafe(F.col(_ID)) & (F.xxhash64(docs["text"]) == F.col(_ROW))
    kept = docs.join(classes.where(~head).select(*key).distinct(), same, "left_anti")
    # Representatives that are several rows; rows without a word (n_equal 0) are no group.
    repeated = written(classes.where(head & (F.col("n_equal") > 0)).groupBy(*key).count().where(F.col("count") > 1), "repeated-rows")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    row = F.struct(*[c for c in docs.columns if c != "doc_id"])
    one = docs.join(repeated, same).groupBy(_ID, _ROW).agg(F.min(row).alias("__least")).select(F.col(_ID).alias("doc_id"), "__least.*")
    return kept.join(repeated, same, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words, to the nearest whole time; texts without a word go.

    A null source is a source of its own. Rows with one id, text and source share what is taken for them.
    Columns not named are carried along, whatever their names.
    """
    taken = mixing.mix(docs, "doc_id", "text", "source").groupBy("doc_id", "row", "source").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = taken.where(F.col("size") > 0).select(F.col("doc_id").alias(_ID), F.col("row").alias(_ROW), F.col("source").alias("__source"), times.alias("__times")).where(F.col("__times") > 0)
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(F.col(_ID)) & (F.xxhash64(docs["text"]) == F.col(_ROW)) & docs["source"].eqNullSafe(F.col("__source")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[docs[c] for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids)`` of every row; a null text has no token."""
    return bpe.round_trip(docs, "doc_id", "text", **tokenizer(), with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Language ID, the Jaccard join's path sampling, the mix and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written to the shared folder and read again."""
    base = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"

    def step(docs: DataFrame, numbered: tuple) -> DataFrame:
        k, (_, stage) = numbered
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        return spark.read.parquet(f"{base}/{k}")

    return reduce(step, enumerate(STAGES), spark.read.parquet(f"{sf_dir}/documents.parquet"))
