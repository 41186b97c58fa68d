"""Each operator against brute force on small and awkward tables."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomspan.llm import bpe, fingerprints, graph_ann, jaccard_join, kd_sharding, language_id, line_dedup, mixing, queries, support, url_filter, warc_fixity
from tests.oracle import check, duck

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside.
CLASH = ["row", "doc", "pos", "key", "size", "shard", "slot", "node", "source_size", "id", "text_", "taken", "h1", "path", "sid", "lang_pred", "score", "kept_text_", "part", "tail"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    words = [f"w{i}" for i in range(3000)]
    long_text = "\n".join(" ".join(words[i : i + 40]) for i in range(0, 3000, 40))
    rows = [
        (1, "Some shared line of text here\nown line one of the first", "en", "a"), (2, "some shared line of TEXT here  \nmore words follow now", "en", "b"),
        (3, "  Some shared line of text here", "de", None), (4, None, "en", "a"), (5, "", None, "b"), (6, "\n\n", "en", "a"), (None, "no id at all", None, None),
        (7, long_text, "en", "a"), (8, long_text + " tail", "en", "a"), (9, long_text, "en", "b"), (9, long_text, "en", "b"), (10, "!!! 123 ...", "en", "c"), (11, "éa ça été là où naïve ♥ 漢字", "fr", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    check(spark, queries.QUERIES, queries.ORACLES, name, SF)


def brute_pieces(t):
    """Distinct pieces of a text by the documented cuts."""
    out = re.findall(r"[^\n]{1,8}", t[:16]) + re.findall(r"[^\n]{40,80}?(?=\s|$)|[^\n]{1,80}", t[16:256])
    return set(out + re.findall(r"[^\n]{200,600}?(?:[.!?](?=\s|$)|[\u3002\uff01\uff1f\uff61])|[^\n]{200,600}?[b-gB-G0-4,;:)}](?=\s)|[^\n]{1,600}", t[256:]))


def brute_like(a, b):
    n = lambda ps: sum(map(len, ps))
    return 1 - n(a ^ b) / (n(a) + n(b)) if a or b else 1.0


def test_fingerprints_equal_brute_force(spark, odd, empty):
    docs = duck(SF, "SELECT doc_id, text FROM documents ORDER BY 1")
    got = {r.doc_id: r for r in queries.op1_fingerprints(spark, SF).collect()}
    texts = list(docs.text)
    for i, (k, t) in enumerate(zip(docs.doc_id, texts)):
        nxt, q = texts[(i + 1) % len(texts)], len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[k]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        assert r.near_edited == pytest.approx(brute_like(brute_pieces(t), brute_pieces(edited))) and r.near_next == pytest.approx(brute_like(brute_pieces(t), brute_pieces(nxt)))
        assert r.near_edited > 0 or len(t) < 20
    rows = fingerprints.compare_edited(odd, "doc_id", "text").collect()
    assert len(rows) == 13 and len({r.fingerprint for r in rows if r.doc_id in (7, 9)}) == 1
    assert all(0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.compare_edited(empty, "doc_id", "text").count() == 0


def test_fingerprints_give_back_their_digests_at_any_size(spark):
    rng = random.Random(6)
    texts = ["", "a", "短い文。" * 3, "one word", *(" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) for n in (5, 50, 500, 5000, 100_000)), "漢字の長い文章" * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = fingerprints.fingerprint(docs, "doc_id", "text").select("doc_id", fingerprints.recovered(F.col("cells")).alias("got"), F.flatten("blocks").alias("want"))
    for r in own.collect():
        assert sorted(r.got) == sorted(r.want) and len(r.want) == len(brute_pieces(texts[r.doc_id]))
    for r in fingerprints.compare_edited(docs, "doc_id", "text").collect():
        nxt = texts[(r.doc_id + 1) % len(texts)]
        assert r.near_next == pytest.approx(brute_like(brute_pieces(texts[r.doc_id]), brute_pieces(nxt)))
        assert r.near_edited > 0.4 or r.n_chars < 20  # long texts without a sentence end, too


def test_peeling_recovers_and_fails_as_it_should(spark):
    few = spark.createDataFrame([([1 << 12, 2 << 12, 3 << 20, 4 << 30], [3 << 20, 4 << 30, 5 << 33])], "a array<long>, b array<long>")
    got = few.select(fingerprints.peel(fingerprints.subtract(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))).alias("d")).first().d
    assert sorted(got) == [1 << 12, 2 << 12, 5 << 33]
    keys = [random.Random(k).getrandbits(63) for k in range(1000)]
    many = spark.createDataFrame([(keys[:400], keys[300:])], "a array<long>, b array<long>")
    ab = [F.struct(F.col(c).alias("keys"), fingerprints.sketch(F.col(c)).alias("cells")) for c in "ab"]
    r = many.select(fingerprints.peel(fingerprints.subtract(ab[0]["cells"], ab[1]["cells"])).alias("d"), fingerprints._difference(*ab).alias("n")).first()
    assert r.d is None and sorted(r.n) == sorted(set(keys[:300] + keys[400:]))


def brute_lines(rows, least=20, docs=3):
    up, space = {c: c + 32 for c in range(65, 91)}, " \t\n\x0b\x0c\r"
    of = collections.defaultdict(set)
    key = lambda line: line.strip(space).translate(up)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                of[key(line)].add(-(1 << 63) if i is None else i)
    gone = {k: max(v) for k, v in of.items() if len(v) >= docs}
    keep = lambda i, line: gone.get(key(line), i if i is not None else -(1 << 63)) == (i if i is not None else -(1 << 63))
    return [(i, "\n".join(line for line in (t or "").split("\n") if keep(i, line))) for i, t in rows]


def test_line_dedup_on_odd_rows_and_hot_lines(spark, odd, empty):
    def run(df):
        kept = line_dedup.kept_text(df, "doc_id", "text", line_dedup.keep_bitmaps(df, "doc_id", "text"))
        return sorted(((r.doc_id, r.kept_text) for r in kept.collect()), key=str)

    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert run(odd) == sorted(brute_lines(rows), key=str)
    assert run(empty) == []
    rng = random.Random(3)
    pool = ["a very common line in this corpus", *(f"line number {i} of the shared pool" for i in range(30)), "short"]
    made = [(i, "\n".join(rng.choice(pool[:1] if rng.random() < 0.4 else pool) for _ in range(rng.randint(1, 6)))) for i in range(400)]
    for parts in (1, 3, 17):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert run(spark.createDataFrame(made, "doc_id long, text string").repartition(5)) == sorted(brute_lines(made), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_runs_across_batches_and_tasks():
    """The stream's state over any cut of the sorted rows into batches gives the same decisions."""
    import pyarrow as pa

    rng = random.Random(9)
    for _ in range(200):
        rows = sorted(((rng.randint(0, 2), 0, -rng.randint(0, 4), 0, rng.randint(0, 3)) for _ in range(rng.randint(1, 25))))
        rows = [(a, b, -d, r, p) for a, b, d, r, p in dict.fromkeys(rows)]
        cuts = sorted(rng.sample(range(len(rows) + 1), min(2, len(rows))))
        tasks = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        # A task boundary never splits one document of a hash.
        tasks = [rows] if any(x and y and x[-1][:3] == y[0][:3] for x, y in zip(tasks, tasks[1:])) else tasks
        out = []
        for task in tasks:
            step = rng.randint(1, 5)
            batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in task[k : k + step]], pa.int32() if i == 4 else pa.int64()) for i in range(5)], list("abcde")) for k in range(0, len(task), step)]
            for b in line_dedup._runs(3)(iter(batches)):
                out += b.to_pylist()
        sure = {(x["h1"], x["doc"], x["pos"]) for x in out if x["n_docs"] == 0 and x["pos"] is not None}
        totals = collections.defaultdict(lambda: [0, -9])
        for x in out:
            if x["pos"] is None:
                totals[x["h1"]][0] += x["n_docs"]
                totals[x["h1"]][1] = max(totals[x["h1"]][1], x["doc"])
        sure |= {(x["h1"], x["doc"], x["pos"]) for x in out if x["n_docs"] == 1 and x["pos"] is not None and totals[x["h1"]][0] >= 3 and x["doc"] < totals[x["h1"]][1]}
        docs = collections.defaultdict(set)
        for r in rows:
            docs[r[0]].add(r[2])
        want = {(r[0], r[2], r[4]) for r in rows if len(docs[r[0]]) >= 3 and r[2] < max(docs[r[0]])}
        assert sure == want, (rows, tasks)


def test_url_rules_and_wildcards(spark):
    rules = [*queries.RULES, url_filter.Rule("net", "/a*z/?x", "block")]
    urls = ["http://EXAMPLE.org/es/1", "https://m.example.org/en/12", "http://badexample.org/es/", "http://evil.com/x.org/", "http://org", "http://a.net/a--z/qx1", "http://a.net/az/x", "x", "", None, "http://h.com/de/" + "y" * 5000]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r.host, r.rule, r.verdict) for r in url_filter.judge(df, "page_id", "url", rules).orderBy("page_id").collect()]
    assert [g[1:] for g in got] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), (None, "allow"), (None, "allow"), ("net/a*z/?x", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/de/", "block")]
    assert got[0][0] == "example.org" and got[7][0] == ""
    assert url_filter.judge(df.where("false"), "page_id", "url", rules).count() == 0


def test_automaton_over_many_words():
    globs = [[*f"{i:03d}".encode(), url_filter.REST] for i in range(200)]
    automaton = url_filter.ShiftAnd(globs)
    texts = [f"{i:03d}tail".encode() for i in range(0, 200, 7)] + [b"", b"x"]
    hit = automaton.accepted(texts)
    assert automaton.words > 10
    assert [list(np.flatnonzero(h)) for h in hit] == [[i] for i in range(0, 200, 7)] + [[], []]


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(2000 + i, [float(x) for x in v[3]]) for i in range(60)]
    bad = [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [None] * 16), (None, [1.0] * 16), (3005, [float("inf")] + [0.0] * 15), (3020, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    nodes = graph_ann.usable(df, "vec_id", "embedding")
    index = support.written(graph_ann.build(nodes, 20, shard_vectors=400), "test-index")
    hits = graph_ann.search(index, nodes.where("id % 20 = 0"), 20).collect()
    ids, vs = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    by = collections.defaultdict(list)
    for h in hits:
        by[h.query_id].append(h)
    found = total = 0
    for q, hs in by.items():
        if q == 3020:
            continue
        s = (vs * vs[ids == q][0]).sum(1)  # row by row: equal vectors tie exactly
        order = [i for _, i in sorted((-x, i) for x, i in zip(s, ids) if i != q)][:20]
        assert [h.rank for h in sorted(hs, key=lambda h: h.rank)] == list(range(1, 21))
        found += len({h.id for h in hs} & set(order))
        total += 20
    assert found / total >= 0.95 and 3000 not in by
    assert 2000 in by and 3020 not in by  # nothing else has two components
    none = nodes.where("false")
    assert graph_ann.search(graph_ann.build(none, 5), none, 5).count() == 0


def test_fixity_finds_altered_missing_and_extra(spark):
    rows = [(i, f"http://x/{i}", "b" * (i % 50)) for i in range(600)] + [(None, None, None), (5, "dup", "dup")]
    a = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("idx", F.lit(1))
    assert warc_fixity.compare(a, a, "page_id", "url", "html").count() == 0
    b = a.withColumn("html", F.when(F.col("page_id") == 77, F.lit("bad")).otherwise(F.col("html"))).where("coalesce(page_id, 0) <> 599")
    got = {(r.id, r.kind) for r in warc_fixity.compare(a, b, "page_id", "url", "html", per_archive=40, fanout=4).collect()}
    assert got == {(77, "altered"), (599, "missing")}
    assert warc_fixity.compare(a.where("false"), a.where("false"), "page_id", "url", "html").count() == 0


def test_fixity_names_what_is_lost_or_added_in_the_middle(spark):
    rows = [(i, f"http://x/{i}", "b" * (i % 50)) for i in range(256) if i != 99]
    whole = spark.createDataFrame(rows, "page_id long, url string, html string")
    gone = whole.where("page_id <> 10").unionByName(spark.createDataFrame([(99, "new", "n")], whole.schema))
    got = {r.id: r for r in warc_fixity.compare(whole, gone, "page_id", "url", "html").collect()}
    assert {k: r.kind for k, r in got.items()} == {10: "missing", 99: "extra"}
    sizes = [len("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: \r\nContent-Length: ") + len(u) + len(str(len(h))) + 8 + len(h) for _, u, h in rows]
    assert (got[10].start, got[10].stop) == (sum(sizes[:10]), sum(sizes[:11]))
    at = sum(sizes[:99]) - sizes[10]
    assert got[99].replica_start == at and got[99].replica_stop == at + len("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: new\r\nContent-Length: 1") + 8 + 1


def test_fixity_of_null_and_repeated_ids(spark):
    rows = [(None, f"u{i}", "x") for i in range(50)] + [(7, f"v{i}", "x") for i in range(50)] + [(8, "same", "x")] * 5 + [(-3, "neg", "x")]
    whole = spark.createDataFrame(rows, "page_id long, url string, html string")
    less = spark.createDataFrame([r for r in rows if r[1] not in ("u3", "v4", "v5")] + [(7, "v99", "x")] + [(8, "same", "x")], whole.schema)
    got = sorted((r.id or 0, r.kind, r.copies) for r in warc_fixity.compare(whole, less, "page_id", "url", "html").collect())
    assert got == [(0, "missing", 1), (7, "extra", 1), (7, "missing", 1), (7, "missing", 1), (8, "extra", 1)]


def brute_kd(rows, n):
    """Recursive weighted medians on sorted rows; ties on the median go by the hash, in 4096ths, at the edge nearer to the goal."""
    dims = kd_sharding.DIMENSIONS
    unit = {d: (max(r[d] for r in rows) - min(r[d] for r in rows)) or 1.0 for d in dims}

    def split(rows, first, k):
        if k == 1 or not rows:
            return {r["id"]: first for r in rows}
        d = max(dims, key=lambda d: ((max(r[d] for r in rows) - min(r[d] for r in rows)) / unit[d], d))
        goal, at = sum(r["size"] for r in rows) * (k // 2) / k, 0
        for value in sorted({r[d] for r in rows}):
            here = [r for r in rows if r[d] == value]
            if at + sum(r["size"] for r in here) >= goal:
                break
            at += sum(r["size"] for r in here)
        for b in range(4096):
            w = sum(r["size"] for r in here if int(r["tie"] * 4096) == b)
            if at + w >= goal and w:
                break
            at += w
        edge = b + (at + w - goal <= goal - at)
        left = [r for r in rows if r[d] < value or (r[d] == value and r["tie"] * 4096 < edge)]
        ids = {id(r) for r in left}
        return split(left, first, k // 2) | split([r for r in rows if id(r) not in ids], first + k // 2, k - k // 2)

    return split(rows, 0, n)


def test_kd_shards_by_target_bytes_have_thousands_of_leaves(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat(cast(id AS string), cast(1 + id % 7 AS int)) AS text")
    rows = kd_sharding.shard(docs, "doc_id", "text", target_bytes=100).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(rows) == 20_000 and len(sizes) > 3700 and max(sizes.values()) < 250


def test_kd_shards(spark, odd, empty):
    rows = queries.op6_kd_sharding(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.size == len(docs[r.doc_id].encode()) + 1
    assert len(rows) == len(docs) and set(by) == set(range(16))
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    shard_of = collections.defaultdict(set)
    for r in rows:
        shard_of[docs[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    total = sum(r.size for r in rows)
    assert max(sum(r.size for r in rs) for rs in by.values()) < 1.6 * total / 16
    assert {r.doc_id: r.shard for r in rows} == brute_kd([m.asDict() for m in kd_sharding.measured(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text").collect()], 16)
    placed = kd_sharding.shard(odd, "doc_id", "text", n_shards=3).collect()
    assert len(placed) == 13 and len({r.shard for r in placed if r.doc_id in (7, 9)}) == 1
    assert kd_sharding.shard(empty, "doc_id", "text", n_shards=4).count() == 0
    assert len({r.shard for r in kd_sharding.shard(odd, "doc_id", "text", target_bytes=20_000).collect()}) >= 2


def brute_links(rows, threshold=0.8):
    def grams(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, grams(t)) for i, t in rows]
    distinct = list({s for _, s in sets if s})
    near = collections.defaultdict(set)
    for a, b in itertools.combinations(distinct, 2):
        if len(a & b) >= threshold * len(a | b):
            near[a].add(b)
            near[b].add(a)
    out = {}
    for i, s in sets:
        seen, todo = {s}, [s]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        ids = [j for j, u in sets if s and u in seen]
        out.setdefault(i, []).append((min(ids) if s else i, len(near[s])))
    return {k: sorted(v) for k, v in out.items()}


def test_jaccard_join_equals_brute_force(spark, odd, empty):
    rng = random.Random(11)
    base = [[f"v{rng.randint(0, 400)}" for _ in range(rng.randint(3, 120))] for _ in range(60)]
    texts = [" ".join(w) for w in base]
    for w in base[:20]:
        for _ in range(rng.randint(1, 12)):
            x = list(w)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = f"z{rng.randint(0, 9)}"
            texts.append(" ".join(x))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_links(rows)
    for kw in ({}, {"bucket": 4, "depth": 2}):  # the second brute-forces large buckets in blocks
        got = {r.doc_id: [(r.class_id, r.n_links)] for r in jaccard_join.join(df, "doc_id", "text", **kw).collect()}
        assert got == want
    r = {x.doc_id: x for x in jaccard_join.join(odd, "doc_id", "text").collect()}
    assert r[8].class_id == 7 and r[9].class_id == 7 and r[7].n_equal == 2 and r[4].class_id == 4 and r[None].class_id is None
    assert jaccard_join.join(odd, "doc_id", "text").count() == 13
    assert jaccard_join.join(empty, "doc_id", "text").count() == 0


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    words = [f"u{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:50], f"x{i}", *words[50:]])) for i in range(30)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", bucket=6, depth=2).collect()
    want = brute_links(rows)
    assert {r.doc_id: [(r.class_id, r.n_links)] for r in got} == want and want[0] == [(0, 29)]


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in jaccard_join.components(pairs).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_language_id_held_out_accuracy_and_odd_texts(spark, odd, empty):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) / len(out) > 0.97
    profiles = language_id.learn(odd, "text", "lang")
    pred = {r.doc_id: r.lang_pred for r in language_id.predict(odd, "doc_id", "text", profiles).collect()}
    assert pred[4] == pred[5] == pred[6] == pred[10] == "und" and pred[11] == "fr"
    none = language_id.learn(empty, "text", "lang")
    assert {r.lang_pred for r in language_id.predict(odd, "doc_id", "text", none).collect()} == {"und"}


def brute_grams(text):
    """One to three letters of a word with a mark at each end, counted."""
    out = collections.Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        word = "".join(c for c in word if c.isalpha())
        out.update(word)  # single letters
        out.update(a + b for a, b in zip(word, word[1:] + "$"))
        out["^" + word[0]] += 1
        padded = f"^{word}$"
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


@pytest.mark.parametrize("at_once", [1, 256])
def test_language_id_equals_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(language_id, "LANGUAGES_A_PASS", at_once)
    rng = random.Random(5)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60)] for lang, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "éfghi"))}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 80))), lang) for i in range(90) for lang in [("aa", "bb", "cc")[i % 3]]]
    profile = 2000  # all grams: no order among equally frequent ones is cut off
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn(docs, "text", "lang", profile=profile)
    got = {(r.lang, r.rank) for r in profiles.collect()}
    counts = {lang: sum((brute_grams(t) for _, t, x in rows if x == lang), collections.Counter()) for lang in words}
    assert {lang: max(r for x, r in got if x == lang) for lang in words} == {lang: len(c) for lang, c in counts.items()}
    codes = {lang: {r.rank: r.gram for r in profiles.collect() if r.lang == lang} for lang in words}
    pred = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, "doc_id", "text", profiles, profile=profile).collect()}
    for i, text, _ in rows:
        mine = language_id.top(*language_id.grams(text), profile)
        assert len(mine) == len(brute_grams(text))
        away = {}
        for lang in words:
            place = {g: r for r, g in codes[lang].items()}
            away[lang] = sum(min(profile, abs(place[int(g)] - k)) if int(g) in place else profile for k, g in enumerate(mine, 1))
        best = min(sorted(away), key=lambda x: away[x])
        assert pred[i] == (best, pytest.approx(1 - away[best] / (profile * len(mine))))


def test_grams_do_not_depend_on_pieces(monkeypatch):
    text = "Ab cd éfg, hij. " * 50
    whole = language_id.grams(text)
    monkeypatch.setattr(language_id, "_PIECE", 7)
    parts = language_id.grams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def brute_targets(sizes, weights, total, most):
    """By bisection: the unit at which the capped targets add up to the total."""
    low, high = 0.0, most * sum(sizes) + 1
    for _ in range(200):
        unit = (low + high) / 2
        low, high = (unit, high) if sum(min(most * s, w * unit) for s, w in zip(sizes, weights)) < total else (low, unit)
    return [min(most * s, w * high) for s, w in zip(sizes, weights)]


def test_mix_meets_targets(spark, odd, empty):
    rows = queries.op9_mixing(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken <= 2 * r.size and r.size == len([w for w in re.split("[\x20\x09-\x0d]+", docs[r.doc_id].text or "") if w]) and r.source == docs[r.doc_id].source
    assert len(rows) == len(docs)
    names = sorted(by)
    sizes = [sum(r.size for r in by[s]) for s in names]
    want = brute_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    for s, size, target in zip(names, sizes, want):
        assert by[s][0].source_size == size and by[s][0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in by[s]) - target) <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op9_mixing(spark, SF).collect()))
    mixed = mixing.mix(odd, "doc_id", "text", "source").collect()
    assert len(mixed) == 13 and all(r.taken <= 2 * r.size for r in mixed)
    assert mixing.mix(empty, "doc_id", "text", "source").count() == 0


def test_mix_of_many_sources_and_its_blocks(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "trim(repeat('w ', cast(1 + id % 40 AS int))) AS text", "concat('s', id % 150) AS source")
    rows = mixing.mix(docs, "doc_id", "text", "source", block_tokens=7).collect()
    taken, sizes, targets = collections.Counter(), collections.Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        targets[r.source] = r.target
    names = sorted(sizes)
    want = brute_targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)
    assert [targets[s] for s in names] == pytest.approx(want) and all(abs(taken[s] - targets[s]) <= 1 for s in names)
    parts = mixing.blocks(docs, "doc_id", "text", "source", block_tokens=7).collect()
    got = collections.Counter()
    for p in parts:
        got[p.doc_id] += p.n
        assert 0 <= p.first and p.first + p.n <= 1 + p.doc_id % 40
    assert got == {r.doc_id: r.taken for r in rows if r.taken}
    slots = collections.defaultdict(set)
    for p in parts:
        slots[p.slot].add(p.source)
    assert all(len(s) == 1 for s in slots.values())


def test_bpe_equals_the_library(spark, odd, empty):
    t = dict(rank_file=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(t["rank_file"], "rb"))}
    enc = tiktoken.Encoding("test", pat_str=t["pattern"], mergeable_ranks=ranks, special_tokens={})
    got = bpe.round_trip(odd, "doc_id", "text", **t).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.round_trip(empty, "doc_id", "text", **t).count() == 0
    rng = random.Random(2)
    for _ in range(300):
        s = "".join(rng.choice(["a", "'s ", " ", "\n", "  ", "12", "é", " ", "!", "\x1c", " " * 300]) for _ in range(rng.randint(0, 60)))
        assert bpe.encode_text(enc, s, 5) == enc.encode_ordinary(s)
    long = " " * 3_000_000 + "x"
    assert "".join(bpe.safe_pieces(long)) == long and enc.decode(bpe.encode_text(enc, long)) == long
    small = bpe.decode(bpe.encode(odd, "doc_id", "text", **t), "doc_id", "token_ids", **t)
    assert {(r.doc_id, bytes(r.raw)) for r in small.collect()} == {(k, v.encode()) for k, v in texts.items()}
