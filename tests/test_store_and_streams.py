from pyspark.sql import functions as F

from loomspan.operators import documents, embed, reports, store
from loomspan.sources import corpus
from loomspan.streaming import streams


def test_scan_finds_hidden_names_and_prunes_folders(spark, tmp_path):
    for path, text in (("a/x.py", b"a\r\nb\xff"), ("node_modules/y.py", b"no"), ("a/node_modules/deep/y.py", b"no"), ("conf/.env.x/q.py", b"hidden"), (".env", b"K=1"), ("a/b/c/d/e/f/.env", b"K=2"), ("_x/_y.py", b"z"), (".py", b"no"), ("z.bin", b"no"), ("big.py", b"x" * 2_000_001), ("E.PY", b"")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        rows = {r.file_path: r for r in corpus.scan_files(spark, root, "repo", [".py"]).collect()}
        assert set(rows) == {"a/x.py", "conf/.env.x/q.py", ".env", "a/b/c/d/e/f/.env", "_x/_y.py", "E.PY"}
        assert rows["a/x.py"].text == "a\nb" and rows["a/x.py"].lang == "python" and rows[".env"].text == "K=1" and rows[".env"].ext == "" and rows["E.PY"].ext == ".py"


def test_scan_of_many_folders_reads_each_file_once(spark, tmp_path):
    want = set()
    for i in range(300):
        path = f"r{i % 40}/s{i % 7}/f{i}.txt"
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(str(i))
        want.add((path, str(i)))
    files = corpus.scan_files(spark, str(tmp_path), "repo", [".txt"])
    assert sorted((r.file_path, r.text) for r in files.collect()) == sorted(want)
    assert files.rdd.getNumPartitions() > 40
    (tmp_path / "none").mkdir()
    assert corpus.scan_files(spark, str(tmp_path / "none"), "repo", [".txt"]).count() == 0


def test_counters_come_from_the_write_itself(spark, tmp_path):
    rows = spark.range(1000).select(F.lit("r").alias("repo_name"), (F.col("id") % 10).cast("string").alias("file_path"), F.when(F.col("id") % 4 == 0, "audit_log").otherwise("function").alias("node_type"), F.lit("abc").alias("text"))
    got = reports.written_with_counters(rows, str(tmp_path / "t"), "node_type", run_id="x").collect()[0]
    assert (got.run_id, got.nodes, got.files, got.security_tags, got.characters) == ("x", 1000, 10, 250, 3000) and got.finished_at >= got.started_at
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 1000 and back.where("node_type = 'audit_log'").count() == 250
    reports.append_json(spark.createDataFrame([got]), str(tmp_path / "log"))
    reports.append_json(spark.createDataFrame([got]), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    none = reports.written_with_counters(rows.where("false"), str(tmp_path / "u"), "node_type", run_id="y").collect()[0]
    assert (none.nodes, none.files, none.characters) == (0, 0, 0)


def test_stream_ingest_is_idempotent_and_replaces_files(spark, tmp_path):
    src, state = tmp_path / "src", str(tmp_path / "state")
    schema = "repo_name string, file_path string, text string, lang string, ext string, file_hash string"

    def push(name, rows):
        raw = spark.createDataFrame(rows, "repo_name string, file_path string, text string")
        files = corpus.files_from_texts(raw, F.col("repo_name"), F.col("file_path"), F.col("text"))
        files.select("repo_name", "file_path", "text", "lang", "ext", "file_hash").coalesce(1).write.mode("append").parquet(str(src))

    def go():
        q = streams.ingest(spark.readStream.schema(schema).parquet(str(src)), state, str(tmp_path / "cp"), lambda f: documents.plain_chunks(f).select("repo_name", "file_path", "node_id", "content_hash"))
        q.awaitTermination(60)

    push("a", [("r", "a.txt", "one"), ("r", "b.txt", "two")])
    go()
    push("b", [("r", "a.txt", "one"), ("r", "b.txt", "changed")])
    go()
    (first, _), (second, registry) = (streams.current(spark, state, before) for before in (1, None))
    assert first.count() == second.count() == 2
    assert first.join(second, ["file_path", "content_hash"]).select("file_path").collect()[0].file_path == "a.txt"
    assert registry.count() == 2
    # The second batch wrote the bucket of the changed file only.
    assert spark.read.parquet(f"{state}/registry").where("batch = 1").select("file_path").collect()[0].file_path == "b.txt"


def test_health_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, f"i{i % 2}", float(i)) for i in range(40)]
    log = spark.createDataFrame(rows, "m int, source_count int, intent string, elapsed_seconds double").select(F.timestamp_seconds(F.col("m") * 60).alias("ts"), "intent", "source_count", "elapsed_seconds")
    log.write.parquet(str(tmp_path / "log"))
    live = streams.retrieval_health(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")))
    q = live.writeStream.format("memory").queryName("health").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = ["window_start", "intent"]
    assert spark.table("health").orderBy(key).collect() == streams.retrieval_health(log).orderBy(key).collect()


def test_job_state_stream_keeps_the_latest(spark, tmp_path):
    ev = spark.createDataFrame([(1, "a", "starting", 1), (2, "a", "running", 5), (3, "b", "failed", 2), (4, "a", "stale", 3)], "event_id int, job_id string, status string, s int").select("event_id", "job_id", "status", F.timestamp_seconds("s").alias("updated_at"))
    ev.write.parquet(str(tmp_path / "ev"))
    q = streams.job_state(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("jobs_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.job_id, r.status) for r in spark.table("jobs_now").collect()} == {("a", "running"), ("b", "failed")}


def test_ingest_twice_changes_nothing(spark):
    raw = spark.createDataFrame([("r", "a", "x"), ("q", "a", "x")], "repo_name string, file_path string, text string")
    files = corpus.files_from_texts(raw, F.col("repo_name"), F.col("file_path"), F.col("text"))
    registry = files.select("repo_name", "file_path", "file_hash", F.lit("t").alias("last_indexed_at"))
    assert store.changed_files(files, registry).count() == 0
    assert store.changed_files(files, registry.where("repo_name = 'r'")).count() == 1


def test_embedding_inputs(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.embedding for r in embed.hashed_embeddings(texts, "id", "text", 8).collect()}
    twice = spark.createDataFrame([(1, "a b a"), (1, "c"), (1, "c")], "id long, text string")
    assert embed.hashed_embeddings(twice, "id", "text", 8).distinct().count() == 2
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and not any(got[2]) and not any(got[3])
    fn = lambda batch: [[float(len(t))] for t in batch]
    assert {r.id: r.embedding for r in embed.embed_batches(texts, "id", "text", fn, 2).collect()} == {1: [5.0], 2: [0.0], 3: [0.0]}


def test_vacuum_keeps_what_readers_need(spark, tmp_path):
    src, state = tmp_path / "src", str(tmp_path / "state")
    schema = "repo_name string, file_path string, text string, lang string, ext string, file_hash string"
    want = []
    for k in range(4):
        raw = spark.createDataFrame([("r", f"f{i}.txt", f"text {i} {k if i % 2 else 0}") for i in range(6)], "repo_name string, file_path string, text string")
        files = corpus.files_from_texts(raw, F.col("repo_name"), F.col("file_path"), F.col("text"))
        files.select("repo_name", "file_path", "text", "lang", "ext", "file_hash").coalesce(1).write.mode("append").parquet(str(src))
        streams.ingest(spark.readStream.schema(schema).parquet(str(src)), state, str(tmp_path / "cp"), lambda f: documents.plain_chunks(f).select("repo_name", "file_path", "node_id", "content_hash")).awaitTermination(60)
        want.append(sorted(map(tuple, streams.current(spark, state)[0].drop("bucket").collect())))
    snapshot = lambda before: sorted(map(tuple, streams.current(spark, state, before)[0].drop("bucket").collect()))
    assert [snapshot(b) for b in (1, 2, 3, 4)] == want
    assert streams.vacuum(spark, state, 3) > 0
    assert [snapshot(b) for b in (3, 4, None)] == [want[2], want[3], want[3]]
    assert streams.vacuum(spark, state, 3) == 0


def test_a_job_left_running_fails_by_itself(spark, tmp_path):
    def push(rows):
        ev = spark.createDataFrame(rows, "event_id int, job_id string, status string, s int").select("event_id", "job_id", "status", F.timestamp_seconds(F.col("s") + 100_000).alias("updated_at"))
        ev.coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))

    def go():
        live = streams.live_job_state(spark.readStream.schema("event_id int, job_id string, status string, updated_at timestamp").parquet(str(tmp_path / "ev")))
        put = lambda batch, n: batch.write.mode("append").parquet(str(tmp_path / "out"))
        live.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        rows = spark.read.parquet(str(tmp_path / "out"))
        return {r.job_id: (r.status, r.stale) for r in rows.groupBy("job_id").agg(F.max_by("status", F.struct("updated_at", "stale")).alias("status"), F.max_by("stale", F.struct("updated_at", "stale")).alias("stale")).collect()}

    push([(1, "dead", "running", 0), (2, "done", "running", 0), (3, "done", "completed", 60), (4, "late", "starting", 100)])
    assert go() == {"dead": ("running", False), "done": ("completed", False), "late": ("starting", False)}
    push([(5, "late", "running", 1700), (6, "other", "completed", 2600)])  # the watermark comes to 2,000 seconds: past dead's limit, before late's
    assert go() == {"dead": ("failed", True), "done": ("completed", False), "late": ("running", False), "other": ("completed", False)}
    push([(7, "other", "completed", 9000), (8, "dead", "running", 10)])
    assert go()["late"] == ("failed", True) and go()["dead"] == ("failed", True)
