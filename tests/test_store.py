import pytest
from pyspark.sql import functions as F

from quillstone import schemas
from quillstone.functions import text
from quillstone.operators import store
from quillstone.plans.engine import Busy, Engine, Known
from quillstone.sources import files
from quillstone.streaming import jobs


def test_upsert_keeps_and_replaces(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, store.upserted(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_failed_store_leaves_nothing(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "c"))
    good = spark.createDataFrame([("1", "d", "n", "f", "function", 1, 2, [])], "id string, document string, name string, file string, type string, start_line int, end_line int, calls array<string>")
    bad = good.withColumn("document", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        s.replace_all("r", {"_functions": good, "_classes": bad})
    assert s.count("r", "_functions") == 0


def test_engine(spark, tmp_path):
    src = tmp_path / "src"
    (src / "pkg").mkdir(parents=True)
    (src / "pkg/__init__.py").write_text("def load_all():\n    return read_one()\n")
    (src / "b.py").write_text("class Box:\n    def put(self):\n        return load_all()\n\ndef read_one():\n    return 1\n")
    e = Engine(spark, str(tmp_path / "data"))
    assert e.health() == {"status": "ok"} and e.list_repos().count() == 0
    repo, task = e.ingest(str(src), "https://github.com/o/pkg")
    with pytest.raises(Known):
        e.ingest(str(src), "https://github.com/o/pkg")
    row = e.list_repos().first()
    assert (row.status, row.name, tuple(row.stats)) == ("complete", "pkg", (2, 3, 1, 2))
    assert e.task_status(task).first().percent == 100
    q = spark.createDataFrame([(1, "what calls `load_all`?")], "question_id long, question string")
    hits = e.retrieve(repo, q)
    assert [(r.name, r.type, r.score) for r in sorted(hits.collect(), key=lambda r: r["rank"])] == [("load_all", "seed", 1.0), ("Box.put", "neighbor", 0.2), ("read_one", "neighbor", 0.2)]
    assert {r.name for r in e.retrieve(repo, q, "naive").collect()} == {"load_all"}
    assert "[SEED] load_all  (pkg/__init__.py  L1–2)\nFile: pkg/__init__.py" in e.build_prompts(hits, q).first().prompt
    e._status(repo, status="parsing")
    with pytest.raises(Busy):
        e.delete_repo(repo)
    e._status(repo, status="complete")
    e.delete_repo(repo)
    assert e.list_repos().count() == 0 and e.tasks().count() == 0
    with pytest.raises(KeyError):
        e.delete_repo(repo)


def test_files(spark, tmp_path):
    path = str(tmp_path / "x.json")
    schema = "a int, b string"
    assert files.read_result(spark, path, schema).collect()[0].a is None if files.read_result(spark, path, schema).count() else True
    files.write_json(spark.createDataFrame([(1, "z")], schema), path)
    assert open(path).read() == '{\n  "a": 1,\n  "b": "z"\n}\n'
    assert tuple(files.read_result(spark, path, schema).first()) == (1, "z")
    with pytest.raises(Exception):
        files.read_result(spark, str(tmp_path / "none.json"), schema, strict=True).collect()


def test_progress_stream(spark, tmp_path):
    src = str(tmp_path / "s")
    rows = [("t", 1, "cloning", 1, "running"), ("t", 2, "cloning", 1, "running"), ("t", 3, "parsing", 2, "running"), ("t", 4, "complete", 6, "complete"), ("t", 5, "complete", 7, "running"), ("u", 1, "x", 0, "failed")]
    schema = "task string, seq long, stage string, current_step int, status string"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(src)
    out = jobs.run_available(jobs.progress(spark.readStream.schema(schema).json(src), timed=False), "t")
    assert sorted((r.task, r.seq, r.event) for r in out.collect()) == [("t", 1, "progress"), ("t", 3, "progress"), ("t", 4, "complete"), ("u", 1, "error")]


def test_violations(spark):
    now = None
    repos = spark.createDataFrame([("1", "u", None, "complete", None, None, None, None, now, now), ("2", "u", None, "odd", None, None, None, None, now, now)], schemas.REPOS)
    tasks = spark.createDataFrame([("t", "9", "s", 1, 2, "running", now, now)], schemas.TASKS)
    assert sorted(map(tuple, store.violations(repos, tasks).collect())) == [("repo_status", "2"), ("task_repo", "t"), ("unique_url", "1")]


def test_rates(spark, tmp_path):
    src = str(tmp_path / "r")
    rows = [(f"2024-01-01 00:00:{i:02}", "a") for i in range(5)] + [("2024-01-01 00:00:30", "b"), ("2024-01-01 02:00:00", "b")]
    spark.createDataFrame(rows, "ts string, who string").select(F.to_timestamp("ts").alias("ts"), "who").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, who string").parquet(src)
    out = jobs.run_available(jobs.rates(stream, "who", 3), "rates").collect()
    assert [(r.who, r.n) for r in out] == [("a", 5)]


CHUNK = "id string, document string, name string, file string, type string, start_line int, end_line int, calls array<string>"


def test_failed_write_leaves_the_old_rows(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "c"))
    rows = lambda text: spark.createDataFrame([(str(i), text, "n", "f", "function", 1, 2, []) for i in range(4)], CHUNK)
    s.upsert("r", "_functions", rows("old"))
    with pytest.raises(Exception, match="broken"):
        s.upsert("r", "_functions", rows("new").withColumn("document", F.when(F.col("id") == "3", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("document"))))
    assert {r.document for r in s.collection("r", "_functions").collect()} == {"old"}
    reader = s.collection("r", "_functions")
    s.upsert("r", "_functions", rows("new"))
    assert {r.document for r in reader.collect()} == {"old"} and {r.document for r in s.collection("r", "_functions").collect()} == {"new"}
    twice = rows("a").union(rows("b"))
    s.upsert("r", "_functions", twice)
    assert {r.document for r in s.collection("r", "_functions").collect()} == {"b"} and s.count("r", "_functions") == 4


def test_scan_of_a_stream_stops_early(spark, tmp_path):
    """Batches of one file each: the scan goes on over batches and ends when it has enough."""
    for i in range(6):
        spark.createDataFrame([(10 * i + k, None if k % 2 else "bad") for k in range(10)], "pos long, reject_reason string").coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema("pos long, reject_reason string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    rows = jobs.scan_until(stream, "scan-test", accept=12, scan=1_000).collect()
    assert max(r.accepted for r in rows) == 12 and len(rows) == max(r.seen for r in rows) == 24
    rows = jobs.scan_until(stream, "scan-test", accept=1_000, scan=33).collect()
    assert len(rows) == 33


def test_order_of_answer_streams(spark):
    events = [("a", 1, "retrieval_done"), ("a", 2, "token"), ("a", 3, "token"), ("a", 4, "done"), ("b", 1, "token"), ("b", 2, "done"), ("c", 1, "error"), ("c", 2, "token"), ("d", 1, "retrieval_done"), ("d", 2, "retrieval_done"), ("d", 3, "error")]
    df = spark.createDataFrame(events, "stream string, seq long, event string")
    got = {(r.stream, r.seq, r.before) for r in text.order_faults(df).collect()}
    assert got == {("b", 1, None), ("c", 2, "error"), ("d", 2, "retrieval_done")}


def test_progress_stream_health_and_table_function(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "data"))
    e._note("t", "r", "parsing", 1, 3)
    e._note("t", "r", "parsing", 1, 3)
    e._note("t", "r", "complete", 3, 3, "complete")
    rows = jobs.run_available(e.progress_stream("t", timed=False), "progress-test")
    assert sorted(r.event for r in rows.collect()) == ["complete", "progress"]
    assert e.health() == {"status": "ok"} and e.list_repos("complete").count() == 0
    e.register_sql()
    rows = spark.sql("SELECT * FROM parse_units('a.py', encode('def f(x):\\n    return g(x)\\n', 'UTF-8'))").collect()
    assert [(r.name, r.type, r.calls) for r in rows] == [("f", "function", ["g"])]


def test_manifest_and_seeded_order(spark):
    from quillstone.operators import curate

    out = spark.createDataFrame([("/a/train.jsonl", bytearray(b"x")), ("/a/test.jsonl", bytearray(b"y"))], "path string, content binary")
    counts = spark.createDataFrame([("train", 3), ("test", 1)], "split string, n long")
    row = curate.manifest(out, counts).first()
    assert row.rows == {"train": 3, "test": 1} and row.sha256["train.jsonl"] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    keys = spark.range(50)
    a, b = ([r.id for r in curate.shuffled(keys, "id", seed).orderBy("pos").collect()] for seed in (42, 43))
    assert sorted(a) == list(range(50)) and a != sorted(a) and a != b and a == [r.id for r in curate.shuffled(keys, "id").orderBy("pos").collect()]


def chunk_rows(spark, ids, text):
    return spark.createDataFrame([(str(i), text, "n", "f", "function", 1, 2, []) for i in ids], CHUNK)


def buckets_of(df):
    return {f.split("bucket=")[1].split("/")[0] for f in df.inputFiles()}


def test_buckets_read_and_written(spark, tmp_path):
    """A get reads its ids' buckets only; an upsert writes its ids' buckets only, and leaves the others' files as they are."""
    s = store.ChunkStore(spark, str(tmp_path / "c"), buckets=8)
    s.upsert("r", "_functions", chunk_rows(spark, range(200), "old"))
    before = {f for f in s.collection("r", "_functions").inputFiles()}
    ids = spark.createDataFrame([("17",)], "id string")
    (bucket,) = buckets_of(s.get("r", "_functions", ids))
    assert [r.id for r in s.get("r", "_functions", ids).collect()] == ["17"] and buckets_of(s.collection("r", "_functions")) == {str(b) for b in range(8)}
    s.upsert("r", "_functions", chunk_rows(spark, [17], "new"))
    after = {f for f in s.collection("r", "_functions").inputFiles()}
    assert {f.split("bucket=")[1].split("/")[0] for f in after - before} == {bucket} == {f.split("bucket=")[1].split("/")[0] for f in before - after}
    texts = {r.id: r.document for r in s.collection("r", "_functions").collect()}
    assert len(texts) == 200 and texts["17"] == "new" and list(texts.values()).count("old") == 199
    for i in range(3):
        s.upsert("r", "_functions", chunk_rows(spark, [17], f"v{i}"))
    assert len(s._pointers("r")) == 2 and s.count("r", "_functions") == 200


def test_three_collections_in_one_commit(spark, tmp_path, monkeypatch):
    """A reader between the writes and a failure after the second one both see the old three."""
    s = store.ChunkStore(spark, str(tmp_path / "c"), buckets=4)
    three = lambda text: {c: chunk_rows(spark, range(10), text) for c in store.COLLECTIONS}
    seen = lambda: {c: {r.document for r in df.collect()} for c, df in s.collections("r").items()}
    s.replace_all("r", three("old"))
    old, between, write = {c: {"old"} for c in store.COLLECTIONS}, [], s._written

    def watched(*args):
        out = write(*args)
        between.append(seen())
        return out

    monkeypatch.setattr(s, "_written", watched)
    s.replace_all("r", three("new"))
    assert between == [old] * 3 and seen() == {c: {"new"} for c in store.COLLECTIONS}
    broken = three("third")
    broken["_files"] = broken["_files"].withColumn("document", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        s.replace_all("r", broken)
    assert seen() == {c: {"new"} for c in store.COLLECTIONS}
    files = [p for p in (tmp_path / "c").rglob("*.parquet") if "third" in str(p)]
    assert not files and len(list((tmp_path / "c/repo_id=r/collection=_functions").iterdir())) == 2


def test_two_writers(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "c"))
    s.upsert("r", "_functions", chunk_rows(spark, [1], "a"))
    with pytest.raises(store.Conflict):
        s._commit("r", 0, {})
    assert s.count("r", "_functions") == 1


def test_running_total_over_ranges(spark):
    """Sums of ranges carried over, for any number of ranges, with a null and values of zero."""
    rows = [(None, 4), *((f"k{i:03d}", i % 5) for i in range(200))]
    want, so_far = {}, 0
    for key, n in rows:
        want[key], so_far = so_far, so_far + n
    table = spark.createDataFrame(rows, "key string, n long").repartition(7)
    for parts in (1, 3, 64):
        got = store.running_total(table, "key", "n", "before", parts)
        assert got.columns == ["key", "n", "before"] and {r.key: r.before for r in got.collect()} == want
    assert store.running_total(table.where("n < 0"), "key", "n", "before").collect() == []
