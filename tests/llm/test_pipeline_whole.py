"""Stages on tables without labels and with null or repeated ids."""

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_unlabelled_documents_stay(spark):
    docs = spark.createDataFrame([(1, "plain words", None, "s", 11), (2, "çà et là", None, "s", 8), (3, "123 !!", None, "s", 6), (4, None, None, "s", None)], SCHEMA)
    got = {(r.doc_id, r.lang) for r in cp.identify_language(spark, docs, SF).collect()}
    assert got == {(1, None), (2, None)}


def test_labels_of_any_document_are_learnt(spark):
    docs = spark.createDataFrame([(i, "plain words here", "en" if i == 4 else None, "s", 16) for i in (1, 2, 3, 4, 5)], SCHEMA)
    for labelled in range(1, 6):
        rows = docs.selectExpr("doc_id", "text", f"if(doc_id = {labelled}, 'en', null) AS lang", "source", "n_chars")
        assert {r.lang for r in cp.identify_language(spark, rows, SF).collect()} == {"en"}


def test_one_document_of_a_group_with_null_and_repeated_ids_stays(spark):
    words = [f"w{i}" for i in range(200)]
    near = lambda k, i: " ".join(f"{k}{w}" for w in [*words[:100], f"x{i}", *words[100:]])
    rows = [(i, near("a", i), "en", "s", 1) for i in range(5)] + [(None, near("a", 9), "en", "s", 1)]
    rows += [(None, near("b", i), "en", "s", 1) for i in range(4)]
    rows += [(50, near("c", 1), "en", s, 1) for s in ("z", "y", "y")] + [(50, near("c", 2), "en", "s", 1), (51, near("c", 1), "en", "a", 1)]
    rows += [(70, None, None, None, None), (70, None, None, None, None), (None, "own words only", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.text, r.source) for r in cp.drop_near_duplicates(spark, docs, SF).collect()]
    of = lambda k: [g for g in got if g[1] and g[1].startswith(f"{k}w")]
    assert [(g[0], g[1]) for g in of("a")] == [(None, near("a", 9))]
    assert len(of("b")) == 1 and of("b")[0][0] is None
    assert len(of("c")) == 1 and of("c")[0][0] == 50 and (of("c")[0][1] == near("c", 2) or of("c")[0][2] == "y")
    assert sorted(g[0] is None for g in got if not g[1] or g[1].startswith("own")) == [False, False, True] and len(got) == 6
