import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import embed, metrics, text
from quillstone.operators import curate, retrieve


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_bucket_is_md5_mod_384(spark):
    words = [f"w{i}_{random.Random(i).random()}" for i in range(300)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", embed.bucket("w").alias("b")).collect()
    assert all(r.b == int(hashlib.md5(r.w.encode()).hexdigest(), 16) % 384 for r in got)


def test_zero_vector(spark):
    df = spark.createDataFrame([(1, "¡¿!"), (2, "a a b"), (3, None)], "id long, t string")
    assert {r.id for r in embed.sparse_vectors(df, "id", "t").collect()} == {2}
    assert embed.norms(embed.sparse_vectors(df, "id", "t")).first().norm == pytest.approx(1)
    assert len(embed.densify(embed.sparse_vectors(df, "id", "t")).first().vector) == 384


@pytest.mark.parametrize("d, sim", [(0.0, 1.0), (1.0, 0.0), (2.0, 0.0), (99.0, 0.0)])
def test_similarity(spark, d, sim):
    assert one(spark, embed.similarity(F.lit(d)))[0] == sim


def test_scores(spark):
    r = one(spark, retrieve.seed_score(F.lit(0.8)), retrieve.neighbour_score())
    assert r[0] == pytest.approx(0.88) and r[1] == pytest.approx(0.2)


@pytest.mark.parametrize(
    "q, want",
    [
        ("what does `run` do", ["run"]),
        ("call app.main_loop or os.path.join now", ["app.main_loop", "os.path.join"]),
        ("plain words only.", []),
        (" ".join(f"n_{i}" for i in range(9, -1, -1)), [f"n_{i}" for i in range(8)]),
        ("a_b a_b `a_b`", ["a_b"]),
    ],
)
def test_symbols(spark, q, want):
    assert one(spark, text.symbols(F.lit(q)))[0] == want


LONG = {"spaces": " " * 1_000_000, "signs": "*=" * 500_000, "dotted": "ab.c_d." * 200_000, "braces": "{" * 300_000, "fences": "```" * 200_000, "backticks": "`a" * 300_000}


@pytest.mark.parametrize("kind", LONG)
def test_very_long_texts(spark, kind):
    """No pattern recurses or goes back and forth over a text of a million signs."""
    df = spark.createDataFrame([(f"x{LONG[kind]} fix it y",)], "t string")
    columns = [text.symbols("t"), text.stripped("t"), text.json_object("t"), F.size(text.fenced_blocks("t")), text.predicted_code("t"), text.clean_url("t"), text.host_of("t"), curate.word_count("t"), curate.mentions("t"), F.size(embed.tokens("t"))]
    row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    assert row.c8 is True and row.c1.endswith("y")
    if kind == "dotted":
        assert len(row.c0) == 1 and len(row.c0[0]) == 1 + 1_400_000 - 1


def test_flattened_answers(spark):
    """As many rows as the shortest list has; only distances may be left out."""
    meta = "struct<name:string,file:string,start_line:int,end_line:int>"
    schema = f"ids array<array<string>>, documents array<array<string>>, metadatas array<array<{meta}>>, distances array<array<double>>"
    m = ("n", None, 1, 2)
    rows = [([["a", "b", "c"]], [["x", None, "z"]], [[m, m, m]], [[0.25]]), ([["d", "e"]], [["x", "y"]], [[m, m]], None), ([["f"]], None, [[m]], [[0.0]]), ([["g"]], [["x"]], [[]], [[0.0]]), ([[]], [[]], [[]], [[]]), (None, None, None, None)]
    got = retrieve.flatten_result(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.id, r.sim, r.content, r.file, r.lines) for r in got) == [("a", 0.75, "x", "", [1, 2]), ("d", 1.0, "x", "", [1, 2]), ("e", 1.0, "y", "", [1, 2])]


def chunks(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, file string, start_line int, end_line int, document string")


def test_retrieval_rules(spark):
    c = chunks(spark, [("1", "feed_all", "a", 1, 2, "feed all"), ("2", "b", "a", 3, 4, "bread and butter"), ("3", "c", "a", 5, 6, "bread")])
    v = embed.sparse_vectors(c, "id", "document")
    q = spark.createDataFrame([(1, "where is feed_all bread"), (2, "bread"), (3, "¿?")], "question_id long, question string")
    naive = sorted((r.question_id, r["rank"], r.id) for r in retrieve.naive(q, c, v).collect())
    assert naive == [(1, 1, "1"), (2, 1, "3"), (2, 2, "2")]  # exact hits replace vector hits; no tokens, no hits
    e = spark.createDataFrame([("1", "2", 0), ("1", "missing", 0), ("2", "3", 0)], "src string, dst string, seq long")
    rows = sorted((r.question_id, r["rank"], r.id, r.type, r.score) for r in retrieve.graph_augmented(q, c, v, e).collect())
    assert rows[:2] == [(1, 1, "1", "seed", 1.0), (1, 2, "2", "neighbor", 0.2)]  # what is no function chunk drops out
    assert {r[2:4] for r in rows if r[0] == 2} == {("3", "seed"), ("2", "seed"), ("1", "neighbor")}


def test_at_most_eight(spark):
    seeds = spark.createDataFrame([(0, f"s{i}", 0.9, i + 1) for i in range(5)], "question_id long, id string, sim double, rank int")
    near = spark.createDataFrame([(0, f"n{i:02}") for i in range(20)] + [(0, "s1")], "question_id long, id string")
    rows = sorted(retrieve.fuse(seeds, near).collect(), key=lambda r: r["rank"])
    assert [r.id for r in rows] == ["s0", "s1", "s2", "s3", "s4", "n00", "n01", "n02"]


def test_flatten_result(spark):
    schema = "ids array<array<string>>, documents array<array<string>>, metadatas array<array<struct<name:string,file:string,start_line:int,end_line:int>>>, distances array<array<double>>"
    full = spark.createDataFrame([([["a", "b"]], [["x", None]], [[("n", "f", 1, 2), None]], [[0.1, 0.5]]), ([[]], [[]], [[]], [[]])], schema)
    rows = retrieve.flatten_result(full).collect()
    assert [(r.id, r.name, r.lines, round(r.sim, 9), r.content) for r in rows] == [("a", "n", [1, 2], 0.9, "x"), ("b", "", [0, 0], 0.5, "")]


def greedy(lengths):
    left, out = 12_000, []
    for n in lengths:
        if left <= 0:
            break
        out.append(min(n, 3_000, left))
        left -= out[-1]
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0, 1, 2_999, 3_000, 3_001, 9_000]), min_size=1, max_size=9))
def test_budget(spark, lengths):
    df = spark.createDataFrame([(0, i, "x" * n) for i, n in enumerate(lengths)], "question_id long, rank int, content string")
    assert [len(r.taken) for r in sorted(text.within_budget(df).collect(), key=lambda r: r["rank"])] == greedy(lengths)


@pytest.mark.parametrize(
    "raw, want",
    [('ok ```json\n{"a": 1}\n``` end', '{"a": 1}'), ('say {"a": {"b": 2}} so', '{"a": {"b": 2}}'), ("none", None), ("{broken", None), ("{'a': 1}", None)],
)
def test_json_object(spark, raw, want):
    assert one(spark, text.json_object(F.lit(raw)))[0] == want


def test_parsed_answers(spark):
    r = one(spark, text.parse_review(F.lit('{"overall_score": 7, "issues": [{"severity": "low", "line": null}]}')).alias("a"), text.parse_review(F.lit("no")).alias("b"), text.parse_debug(F.lit('{"confidence": "huge"}')).alias("c"), text.parse_tests(F.lit('{"cases": [{"type": "t", "name": "n"}]}')).alias("d"))
    assert r.a.overall_score == 7 and r.a.issues[0].line is None and r.a.summary == ""
    assert (r.b.overall_score, r.b.summary) == (50, "no") and r.c.confidence == "low" and r.d.test_count == 1


def test_frames(spark):
    df = spark.createDataFrame([("event: a\ndata: {}\n\nevent: b\ndata: bad{\n\nevent: c\nda",)], "t string")
    assert [(r.event, r.data) for r in text.frames(df, "t").collect()] == [("a", "{}")]


@pytest.mark.parametrize("url, want", [("https://github.com/a/b/", "https://github.com/a/b"), ("https://other.org/a/b", None), ("github.com/a/b", None), ("https://github.com/a", None)])
def test_clean_url(spark, url, want):
    assert one(spark, text.clean_url(F.lit(url)))[0] == want


@pytest.mark.parametrize("n", [1, 2, 20, 120])
def test_ranks(spark, n):
    df = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") % 17).alias("v"))
    got = metrics.at_ranks(df, "v", ["g"], ("f", metrics.floor_rank(0.95)), ("i", metrics.index_rank(0.95))).first()
    values = sorted(i % 17 for i in range(n))
    assert got.f == values[max(0, int(n * 0.95) - 1)] and got.i == values[min(n - 1, int(n * 0.95))]


def test_compare_refuses(spark):
    a = spark.createDataFrame([("h", 1.0)], "test_hash string, score double")
    assert metrics.compared(a, a.withColumn("score", F.lit(1.5)), ["score"]).first().delta_score == 0.5
    with pytest.raises(Exception, match="differ"):
        metrics.compared(a, a.withColumn("test_hash", F.lit("k")), ["score"]).collect()


def commit(**kw):
    base = {"lang": "Python", "message": "one two three four five six seven fix", "old_contents": "a = 1\n", "new_contents": "a = 2\n", "url": "u"}
    return base | kw


@pytest.mark.parametrize(
    "row, want",
    [
        (commit(), None),
        (commit(lang="go", message="x"), "language"),
        (commit(lang=None), "language"),
        (commit(message="one two three four five six fix"), "message_quality"),
        (commit(old_contents="x" * 3_500), "file_size"),
        (commit(old_contents="#" + "x" * 3_498), None),
        (commit(old_contents="a = 2\n"), "actual_change"),
        (commit(message="one two three four five six seven prefixes"), "bugfix_signal"),
        (commit(old_contents="".join(f"{i}\n" for i in range(50)), new_contents="".join(f"-{i}\n" for i in range(50))), None),
        (commit(old_contents="".join(f"{i}\n" for i in range(51)), new_contents="".join(f"-{i}\n" for i in range(50))), "diff_size"),
        (commit(new_contents="def ("), "syntax_valid"),
        (commit(old_contents=None), None),
    ],
)
def test_reject_reasons(spark, row, want):
    from quillstone import schemas

    df = spark.createDataFrame([tuple(row[k] for k in ("lang", "message", "old_contents", "new_contents", "url"))], schemas.COMMITS)
    assert df.select(curate.reject_reason(syntax=True)).first()[0] == want


def test_scan_and_split(spark):
    rows = spark.range(100).select("id", (F.col("id") * 7 % 100).alias("pos"), F.when(F.col("id") % 3 > 0, "no").alias("reject_reason"))
    seen = sorted(curate.first_accepted(rows, accept=10).collect(), key=lambda r: r.seen)
    assert seen[-1].accepted == 10 and seen[-1].reject_reason is None and [r.seen for r in seen] == list(range(1, len(seen) + 1))
    assert max(r.seen for r in curate.first_accepted(rows, accept=99, scan=20).collect()) == 20
    places = curate.split_places(spark).collect()
    assert sorted(r.place for r in places) == list(range(2_000)) and {s: sum(r.split == s for r in places) for s in curate.SPLITS} == curate.SPLITS
    expected = list(range(2_000))
    random.Random(42).shuffle(expected)
    assert [r.place for r in sorted((r for r in places if r.split == "train"), key=lambda r: r.slot)] == expected[:1_500]


def test_scored_code_is_stripped_of_all_white_space(spark):
    row = spark.createDataFrame([("```\n x = 1\n```\n", "\tx = 1\n ```\nmore")], "a string, b string").select(text.reference_code("a").alias("a"), text.predicted_code("b").alias("b")).first()
    assert tuple(row) == ("x = 1", "x = 1")


def test_late_filters_see_only_what_is_left(spark):
    from quillstone.operators import curate

    long = "\n".join(str(i) for i in range(500))
    rows = [("python", "fix the bug in the long loop of all", "a", "b"), ("go", "fix the bug in the long loop of all", long, ""), ("python", "fix the bug in the long loop of all", long[:3000], "")]
    df = spark.createDataFrame(rows, "lang string, message string, old_contents string, new_contents string")
    assert [r.reason for r in df.select(curate.reject_reason().alias("reason")).collect()] == [None, "language", "diff_size"]


def test_counts_are_made_a_few_texts_at_a_time(monkeypatch):
    """A batch of many texts leaves in slices, with what each text counts alone; a word's bucket may be forgotten in between."""
    monkeypatch.setattr(embed, "_SLICE", 3)
    monkeypatch.setattr(embed, "_KNOWN", 2)
    texts = ["a b a", "B!", "c d e f a", "a b", "x_1", "é a", "b b b b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    out = list(embed._count(iter([batch])))
    assert [x.num_rows for x in out] == [3, 3, 1]
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest(), 16) % 384
    for row, text in zip([r for x in out for r in x.to_pylist()], texts, strict=True):
        want = Counter(map(bucket, re.findall("[a-z_0-9]+", text.lower())))
        assert dict(zip(row["buckets"], row["counts"], strict=True)) == want and row["buckets"] == sorted(want)


def test_repeated_queries_are_not_broadcast(spark):
    """Estimates know neither the width of packs nor how often queries are repeated: with small tables all three searches still shuffle."""
    from quillstone.llm import topk as llm_topk
    from quillstone.operators import topk

    v = spark.createDataFrame([(i, [0, i % 3], [0.6, 0.8], [float(i), 1.0]) for i in range(1, 30)], "id long, buckets array<int>, weights array<double>, v array<double>")
    found = [topk.sparse_top_k(v, v, 2), topk.dense_top_k(v, v, "id", "v", 2), llm_topk.top_k(v, v, "id", "v")]
    for df in found:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
        assert df.count() > 0
