"""The vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import topk, vector_index


def clustered(spark, n=3_000, width=24, seed=4):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(40, width)) * 2
    rows = middle[r.integers(0, 40, n)] + r.normal(size=(n, width))
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>").repartition(4)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = clustered(spark)
    return rows, vector_index.build(rows, str(tmp_path_factory.mktemp("index") / "i"), "id", "v", sample=1_500)


def test_recall_and_work(spark, index):
    rows, built = index
    asked = rows.where("id % 10 = 0")
    exact = topk.dense_top_k(asked, rows, "id", "v", 10)
    got = built.search(asked, "id", "v", 10)
    share = vector_index.recall(got, exact).agg((F.sum("hit") / F.sum("wanted")).alias("r"), F.count("*").alias("n")).first()
    scored = built.scored(asked, "id", "v").agg(F.avg("scored").alias("x")).first().x
    assert share.n == 300 and share.r >= 0.95 and scored < 0.3 * 3_000
    assert built.lists().agg(F.sum("d_rows")).first()[0] == 3_000


def test_all_lists_are_exact(spark, index):
    rows, built = index
    asked = rows.where("id % 50 = 0")
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.sim) for r in df.collect())
    assert key(built.search(asked, "id", "v", 5, probe=built.settings.lists)) == key(topk.dense_top_k(asked, rows, "id", "v", 5))


def test_what_is_found_is_scored_exactly(spark, index):
    rows, built = index
    v = {r.id: np.array(r.v) for r in rows.collect()}
    for r in built.search(rows.where("id < 20"), "id", "v", 3, probe=2).collect():
        a, b = v[r.query_id], v[r.id]
        assert r.sim == pytest.approx(max(0.0, a @ b / np.sqrt((a @ a) * (b @ b))), abs=1e-8)


def test_only_probed_lists_are_read(spark, index):
    _, built = index
    one = built.lists().where("list = 3")
    assert {f.split("list=")[1].split("/")[0] for f in one.inputFiles()} >= {"3"}
    assert "PartitionFilters: [isnotnull(list" in one._jdf.queryExecution().toString()


def test_odd_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.1]), (4, [1.0, 0.1]), (5, [float("nan"), 1.0])], "id long, v array<double>")
    built = vector_index.build(rows, str(tmp_path / "i"), "id", "v", lists=2)
    got = built.search(rows.where("id in (1, 2)"), "id", "v", 2, probe=2).collect()
    assert [(r.id, r.sim > 0.9) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1] == [(4, True), (4, True)]
    assert {r.sim for r in got if r.query_id == 2} == {0.0}
    none = vector_index.build(rows.limit(0), str(tmp_path / "e"), "id", "v")
    assert none.search(rows, "id", "v", 2).count() == 0
