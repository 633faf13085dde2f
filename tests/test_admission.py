"""Admission, corpus scores, digests and capped indexes against plain Python."""

import hashlib
import json
import math
import random
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import metrics
from quillstone.operators import admission, curate, graph, retrieve, store


def test_decisions(spark):
    r, start, rows = random.Random(4), datetime(2024, 1, 1, 10, 59, 30, tzinfo=UTC), []
    for i in range(1_600):
        rows.append((i, r.choice("ab"), r.choice(["ingest", "query", "code", "health"]), start + timedelta(seconds=r.randint(0, 180))))
    rows.append((1_600, None, "code", start))
    rows.append((1_601, "a", None, start))
    got = {x.seq: x for x in admission.decided(spark.createDataFrame(rows, "seq long, client string, route string, ts timestamp")).collect()}
    seen = Counter()
    for seq, client, route, ts in sorted(rows, key=lambda x: (x[3], x[0])):
        limit, seconds = admission.LIMITS.get(route, (None, 1))
        at = int(ts.timestamp()) // seconds * seconds
        seen[client, route, at] += 1
        served = limit is None or seen[client, route, at] <= limit
        assert got[seq].served == served
        assert got[seq].retry_after == (None if served else at + seconds - int(ts.timestamp()))
    refused = {(x.client, x.route): x.refused for x in admission.refusals(spark.createDataFrame(list(got.values()))).collect()}
    assert refused["a", "code"] > 0 and refused["a", "ingest"] > 0 and refused["a", "health"] == 0 == refused[None, "code"]


def by_hand(pairs, keywords):
    hit, own, ref, weighted, weights, nc, nr = Counter(), Counter(), Counter(), 0.0, 0.0, 0, 0
    for c, r in pairs:
        c, r = (c or "").split(), (r or "").split()
        nc, nr = nc + len(c), nr + len(r)
        for n in range(1, 5):
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (c, r))
            hit[n] += sum(min(k, b[g]) for g, k in a.items())
            own[n] += sum(a.values())
            ref[n] += sum(b.values())
            if n == 1:
                w = lambda g: 1.0 if g[0] in keywords else 0.2
                weighted += sum(min(k, b[g]) * w(g) for g, k in a.items())
                weights += sum(k * w(g) for g, k in b.items())
    if not hit[1]:
        return 0.0, 0.0
    brevity = 1.0 if nc > nr else math.exp(1 - nr / nc)
    mean = lambda up, down: math.exp(sum(math.log((u or 0.1) / max(d, 1)) for u, d in zip(up, down, strict=True)) / 4)
    hits = [hit[n] for n in range(1, 5)]
    return brevity * mean(hits, [own[n] for n in range(1, 5)]), brevity * mean([weighted, *hits[1:]], [weights, *(ref[n] for n in range(2, 5))])


@pytest.mark.parametrize("seed", range(4))
def test_corpus_scores(spark, seed):
    r = random.Random(seed)
    line = lambda n: " ".join(r.choice(["def", "return", "x", "y", "z", "if", "("]) for _ in range(n))
    pairs = [(line(r.randint(0, 12)), line(r.randint(0, 12))) for _ in range(25)] + [(None, "x"), ("y", None), ("", "")]
    row = metrics.corpus_bleu(spark.createDataFrame(pairs, "candidate string, reference string").repartition(3)).first()
    assert (row.n, row.bleu, row.weighted) == (28, *(pytest.approx(x) for x in by_hand(pairs, {"def", "return", "if"})))


def test_scores_without_matches(spark):
    for pairs in ([("a", "b")], [(None, None)], []):
        row = metrics.corpus_bleu(spark.createDataFrame(pairs, "candidate string, reference string")).first()
        assert (row.bleu, row.weighted) == (0.0, 0.0)


def test_digests_do_not_depend_on_partitions(spark):
    rows = [("train", i, 3 * i, f"line {i}") for i in range(2_345)] + [("test", 0, 1, None)]
    df = spark.createDataFrame(rows, "split string, slot long, place long, line string")
    told = [curate.dataset_manifest(df.repartition(n), dataset="d", configuration="c", scanned=9_999, provenance={"commit": "abc"}, filters={"syntax_valid_python": True}).first().manifest for n in (1, 8)]
    assert told[0] == told[1]
    m = json.loads(told[0])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaves = [sha(f"line {i}") for i in range(2_345)]
    assert m["splits"]["train"] == {"path": "train.jsonl", "samples": 2_345, "sha256": sha("".join(sha("".join(leaves[i : i + 1_000])) for i in range(0, 2_345, 1_000)))}
    assert m["splits"]["test"]["sha256"] == sha(sha(sha(""))) and m["filters"]["syntax_valid_python"] and m["provenance"]["commit"] == "abc" and m["source_access"]["accepted_samples"] == 2_346
    other = curate.dataset_manifest(df.withColumn("place", F.col("place") + 1), dataset="d", configuration="c", scanned=9_999).first().manifest
    assert json.loads(other)["split_indices_sha256"] != m["split_indices_sha256"] and json.loads(other)["splits"] == m["splits"]


def test_a_hub_sends_few_rows(spark):
    """A node of 100,000 edges has 50 in the index, cut before they are shuffled; a name of 100,000 chunks has 5."""
    edge = spark.range(100_000).select(F.lit(-1).cast("long").alias("src"), "id", F.col("id").alias("seq")).withColumnRenamed("id", "dst")
    near = graph.adjacency(edge)
    row = near.where("seed = -1").collect()
    assert [r.ids for r in row] == [list(range(50))] and "WindowGroupLimit" in near._jdf.queryExecution().toString()
    seeds = spark.createDataFrame([(1, -1), (2, 7)], "question_id long, id long")
    assert sorted(map(tuple, graph.neighbours(seeds, near).collect())) == sorted(map(tuple, graph.neighbours(seeds, edge).collect())) == sorted([*((1, i) for i in range(50)), (2, -1)])
    chunks = spark.range(100_000).select(F.col("id"), F.when(F.col("id") % 7 < 9, "load_all").otherwise("x").alias("name"))
    asked = spark.createDataFrame([(1, "what is `load_all`?")], "question_id long, question string")
    index = retrieve.name_index(chunks)
    assert [r.id for r in retrieve.symbol_hits(asked, index).orderBy("id").collect()] == list(range(5)) == [r.id for r in retrieve.symbol_hits(asked, chunks).orderBy("id").collect()]
    assert "WindowGroupLimit" in index._jdf.queryExecution().toString()


def test_places_by_ranges(spark):
    """Places in each group as a window over the whole group gives them, though a group is cut into ranges; digests of lines serve as well as lines."""
    df = spark.range(5_000).select(F.when(F.col("id") % 97 > 3, "train").when(F.col("id") % 97 > 0, "test").alias("split"), (F.col("id") * 7919 % 5_003).alias("place"), F.concat(F.lit("line "), "id").alias("line"))
    got = store.numbered(df, "split", "place", "slot", parts=16)
    assert got.count() == 5_000
    want = df.withColumn("slot", F.row_number().over(Window.partitionBy("split").orderBy("place")) - 1)
    assert sorted(map(repr, got.select("split", "place", "slot").collect())) == sorted(map(repr, want.select("split", "place", "slot").collect()))
    named = got.where("split is not null")
    told = [curate.dataset_manifest(x, dataset="d", configuration="c", scanned=1).first().manifest for x in (named, named.select("split", "slot", "place", curate.line_digest("line").alias("sha256")))]
    assert told[0] == told[1]
