"""Rows that repeat in k-d sharding, and hashes of the fixity tree recomputed."""

import collections
import hashlib

from pyspark.sql import functions as F

from loomspan.llm import kd_sharding, warc_fixity


def test_a_row_that_repeats_has_a_slot_a_copy(spark, monkeypatch):
    monkeypatch.setattr(kd_sharding, "SLOT_ROWS", 64)
    monkeypatch.setattr(kd_sharding, "COPIES", 10)
    hot = spark.range(1000).selectExpr("7L AS doc_id", "'the same' AS text")
    null = spark.range(333).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text")
    long = spark.range(2).selectExpr("8L + id AS doc_id", "repeat('é', 1000000) AS text")
    rest = spark.range(500).selectExpr("100 + id % 400 AS doc_id", "repeat('ab ', cast(1 + id % 90 AS int)) AS text")
    docs = hot.unionAll(null).unionAll(long).unionAll(rest)
    rows = kd_sharding.shard(docs, "doc_id", "text", n_shards=4).collect()
    assert len(rows) == 1000 + 333 + 2 + 500
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1 and {r.size for r in rows if r.doc_id in (8, 9)} == {2_000_001}


def test_hashes_of_parts_and_slots_cover_digests_in_order(spark):
    pages = spark.range(3000).selectExpr("CASE WHEN id % 5 > 0 THEN 3L END AS page_id", "concat('u', id % 2900) AS url", "'b' AS html")
    long = spark.createDataFrame([(3, "long", "x" * 3_000_000)], "page_id long, url string, html string")
    leaves = warc_fixity.records(pages.unionByName(long), "page_id", "url", "html")
    of = warc_fixity.parts(leaves)
    sha = lambda lines: hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()
    pieces, sizes = collections.defaultdict(list), collections.Counter()
    for r in leaves.collect():
        at = 8 if r.id is None else 4
        pieces[r.archive, r.slot, r.part, r.digest[at : at + 4]].append(f"{r.digest}:{r.copies}")
        sizes[r.archive, r.slot, r.part, r.digest[at : at + 4]] += r.n * r.copies
    want, total = collections.defaultdict(list), collections.Counter()
    for (*key, piece), lines in pieces.items():
        want[tuple(key)].append(f"{piece}:{sha(lines)}:{sizes[(*key, piece)]}")
        total[tuple(key)] += sizes[(*key, piece)]
    got = {(r.archive, r.slot, r.part): (r.bytes, r.hash) for r in of.collect()}
    assert got == {k: (total[k], sha(v)) for k, v in want.items()}
    roots = warc_fixity.tree(of, warc_fixity.depth_for())
    more = warc_fixity.tree(warc_fixity.parts(leaves.withColumn("copies", F.col("copies") + (F.col("digest") == leaves.first().digest).cast("int"))), warc_fixity.depth_for())
    assert warc_fixity.differing_slots(roots, more, warc_fixity.depth_for()).count() == 1
