"""The source audit against a direct computation over all terms and groups."""

import collections
import re

import pytest

from loomspan.llm import source_audit


def brute(rows, min_docs=3, top=200):
    docs = [tuple(x or "" for x in r) for r in rows]
    words = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    df, tf = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang, source in docs:
        ws = words(text)
        tf[lang, source].update(ws)
        df.update((lang, w) for w in set(ws))
    out = []
    for lang in {d[1] for d in docs}:
        kept = [w for (g, w), n in df.items() if g == lang and n >= min_docs]
        groups = {s: c for (g, s), c in tf.items() if g == lang}
        price = lambda c, w, n: 1 + 10**9 * (c[w] + 1) // (n + len(kept))
        ps = {s: {w: price(c, w, sum(c[x] for x in kept)) for w in kept} for s, c in groups.items()}
        whole = sum(groups.values(), collections.Counter())
        q = {w: price(whole, w, sum(whole[x] for x in kept)) for w in kept}
        far = lambda a, b: (a - b) ** 2 // b
        for s, p in ps.items():
            pairs = [(t, sum(far(p[w], o[w]) for w in kept)) for t, o in ps.items() if t != s]
            terms = [(w, far(p[w], q[w])) for w in kept if groups[s][w] > 0 and p[w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ranked)]
    return sorted(out)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string, source string, term string, p long, count long", verifySchema=False) if rows and len(rows[0]) == 6 else spark.createDataFrame(rows, "text string, lang string, source string")
    return sorted(tuple(r) for r in source_audit.audit(df, "text", "lang", "source", **kw).collect())


ODD = [
    ("a b c A-B é É ıi", "en", "x"), ("a b!!b c c c", "en", "x"), ("a é ée c", "en", "y"), ("a b c", "en", None), (None, "en", "z"), ("", None, None), ("123 !!", None, "x"),
    ("only here", "de", "x"), ("漢字 漢字 a", None, "x"), ("漢字", None, "x"), ("漢字 K", None, "y"), ("a " * 3, "en", "x"), ("a b c A-B é É ıi", "en", "x"),
]


def test_equals_brute_force_on_odd_rows(spark):
    assert got(spark, ODD) == brute(ODD)


def test_clashing_columns_and_empty_table(spark):
    assert got(spark, [(*r, "t", 1, 2) for r in ODD]) == brute(ODD)
    assert got(spark.range(0).sparkSession, []) == []


@pytest.mark.parametrize("postings", [3, 50])
def test_many_small_runs_merge_to_the_same(spark, monkeypatch, postings):
    """Blocks of a few postings, chunks of two terms, slabs of a few pairs."""
    rows = [(" ".join(f"w{(i * k) % 17}" for k in range(i % 9)).replace("1", "x").replace("2", "Y"), ["en", "de"][i % 2], f"s{i % 5}") for i in range(200)]
    rows = [(t.replace("0", "q").replace("3", "r").replace("4", "s"), a, b) for t, a, b in rows]
    batches = lambda: iter(spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("lang", "source", "cast(text as binary) text").toArrow().to_batches(max_chunksize=7))
    monkeypatch.setattr(source_audit, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(source_audit, "CHUNK_TERMS", 2)
    runs = [r for b in source_audit._index(3)(batches()) for r in b.to_pylist()]
    assert len(runs) > 40
    runs.sort(key=lambda r: (r["shard"], r["lang"], r["first"]))
    import pyarrow as pa

    merged = [r for b in source_audit._merge(3)(iter([pa.RecordBatch.from_pylist(runs)])) for r in b.to_pylist()]
    tf, df = collections.Counter(), collections.Counter()
    for t, lang, s in rows:
        ws = [w.lower() for w in re.findall(r"[A-Za-z]+", t)]
        tf.update((lang, w, s) for w in ws)
        df.update((lang, w) for w in set(ws))
    assert {(r["lang"], r["term"]): r["n_docs"] for r in merged if r["term"]} == {k: n for k, n in df.items() if n >= 3}
    assert {(r["lang"], r["term"], s): c for r in merged if r["term"] for s, c in zip(r["sources"], r["counts"])} == {k: n for k, n in tf.items() if df[k[:2]] >= 3}
    monkeypatch.setattr(source_audit, "PAIRS_AT_ONCE", 5)
    assert got(spark, rows) == brute(rows)


def test_a_very_long_text(spark):
    rows = [("alpha beta " * 300_000 + "x" * 3_000_000, "en", "x"), ("alpha gamma", "en", "y"), ("alpha beta gamma", "en", "y"), ("beta gamma", "en", "x")]
    assert got(spark, rows) == brute(rows)


def test_pieces_end_between_terms():
    text = ("é" * 700_000 + " " + "b" * 3_000_000 + " c").encode()
    assert [w for piece in source_audit.terms_of(text) for w in piece] == text.split()
