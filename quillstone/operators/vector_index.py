"""Approximate vector search: an inverted file whose lists hold the rows near a centroid.

Centroids are fitted by spherical k-means on a bounded sample. Every row is stored, packed in
blocks, in the list of its nearest centroid, and a list is a partition of the table. A search
looks at the lists of the `probe` centroids nearest to a query and scores their rows exactly, so
that what it returns is right, and only what lies in other lists can be missed. How many lists
are enough is measured when the index is built, on queries from the sample.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .topk import BATCH, BLOCK, PLACES, _products, _unit, meet_dense, packed_dense, ranked


@dataclass
class Settings:
    """What an index was built with; `probe` reached `recall` on the sample's queries."""

    id_type: str
    width: int
    lists: int
    probe: int
    recall: float


def spherical_means(rows: np.ndarray, n: int, *, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """`n` unit centroids of unit rows; a centroid that loses its rows takes the row that fits worst."""
    rng = np.random.Generator(np.random.PCG64(seed))
    means = rows[rng.choice(len(rows), n, replace=False)]
    for _ in range(rounds):
        near = rows @ means.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=n) == 0)
        sums[empty] = rows[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        means = np.where(length > 0, sums / np.where(length > 0, length, 1.0), means)
    return means


def enough_probes(rows: np.ndarray, means: np.ndarray, k: int, target: float, queries: int = 256) -> tuple[int, float]:
    """The fewest lists whose rows hold `target` of the k nearest of sampled queries, and the share that they hold."""
    asked = rows[:queries]
    sims = asked @ rows.T
    np.fill_diagonal(sims[:, : len(asked)], -np.inf)
    k = min(k, len(rows) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.zeros((len(asked), 0), dtype=int)
    place = np.argsort(np.argsort(-(asked @ means.T), axis=1, kind="stable"), axis=1, kind="stable")  # a list's place in a query's order
    own = (rows @ means.T).argmax(axis=1)
    needed = np.take_along_axis(place, own[best], axis=1).ravel()
    share = np.array([(needed < p).mean() if needed.size else 1.0 for p in range(1, len(means) + 1)])
    probe = int(np.argmax(share >= target)) + 1
    return probe, float(share[probe - 1])


def build(rows: DataFrame, path: str, id_col: str, vector_col: str, *, lists: int | None = None, most_lists: int = 4096, sample: int = 20_000, k: int = 10, target: float = 0.98, seed: int = 7) -> VectorIndex:
    """Writes an index of all rows.

    At most about `sample` rows, taken by a hash of their ids, fit the centroids; there are
    as many as the square root of the rows, `most_lists` at most, unless `lists` is given. Null
    and zero vectors are stored too and are like nothing. Rows of an id that repeats stay rows.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    n = own.count()
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    taken = own.where(F.col("v").isNotNull() & (place < min(1 << 30, sample * (1 << 30) // max(1, n)))).orderBy(place, "id").toPandas()  # about `sample` rows
    units = _unit(taken["v"]) if len(taken) else np.zeros((0, 0))
    units = units[(units != 0).any(axis=1)]
    lists = max(1, min(lists or round(n**0.5), most_lists, len(units)))
    means = spherical_means(units, lists, seed=seed) if len(units) else np.zeros((1, units.shape[1]))
    probe, recall = enough_probes(units, means, k, target) if len(units) else (1, 1.0)
    told = Settings(dict(own.dtypes)["id"], means.shape[1], len(means), probe, recall)

    shared = spark.sparkContext.broadcast(means)  # at most `most_lists` rows
    dealt = own.withColumn("list", _nearest(shared)("v"))
    # a list of many blocks is written by many tasks
    slices = F.greatest(F.lit(1), F.lit(n) / F.lit(lists * 4 * BLOCK)).cast("int")
    dealt = dealt.repartition(F.col("list"), F.pmod(F.xxhash64("id"), slices)).sortWithinPartitions("list")
    packed_dense(dealt, BLOCK, "d", "list").withColumn("d_rows", F.size("d_ids")).write.partitionBy("list").parquet(f"{path}/lists")
    centroids = [(i, row.tobytes()) for i, row in enumerate(means)]
    spark.createDataFrame(centroids, "list int, centroid binary").coalesce(1).write.parquet(f"{path}/centroids")
    spark.createDataFrame([(json.dumps(asdict(told)),)], "settings string").coalesce(1).write.parquet(f"{path}/settings")  # last: an index without it is not whole
    return VectorIndex(spark, path)


def _nearest(shared):
    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        means = shared.value
        for vectors in batches:
            unit = _unit(vectors)
            own = _products(unit, means).argmax(axis=1)
            yield pd.Series(own.astype(np.int32))

    return nearest


class VectorIndex:
    """A stored index; `search` gives the nearest rows of its lists, `scored` how many rows it looks at."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.settings = Settings(**json.loads(spark.read.schema("settings string").parquet(f"{path}/settings").first().settings))
        rows = spark.read.schema("list int, centroid binary").parquet(f"{path}/centroids").orderBy("list").collect()
        self.means = np.array([np.frombuffer(r.centroid) for r in rows]).reshape(len(rows), self.settings.width)

    def lists(self) -> DataFrame:
        s = self.settings
        return self.spark.read.schema(f"d_ids array<{s.id_type}>, d_flat binary, d_rows int, list int").parquet(f"{self.path}/lists")

    def probes(self, queries: DataFrame, id_col: str, vector_col: str, probe: int | None = None) -> DataFrame:
        """(id, v, list): the lists that a query looks at."""
        probe = min(probe or self.settings.probe, self.settings.lists)
        shared = self.spark.sparkContext.broadcast(self.means)

        @F.pandas_udf("array<int>")
        def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            means = shared.value
            for vectors in batches:
                unit = _unit(vectors)
                sims = _products(unit, means)
                yield pd.Series(list(np.argsort(-sims, axis=1, kind="stable")[:, :probe].astype(np.int32)))

        asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
        return asked.withColumn("list", F.explode(near("v")))

    def search(self, queries: DataFrame, id_col: str, vector_col: str, k: int, *, probe: int | None = None) -> DataFrame:
        """(query_id, id, sim, rank): the k nearest rows of the probed lists but the query itself, scored exactly.

        Queries of a list meet its blocks in batches; a list that many queries probe is shared
        by several batches. Lists that no query probes are not read.
        """
        kinds = dict(queries.dtypes)
        asked = self.probes(queries, id_col, vector_col, probe)
        asked = packed_dense(asked.repartition(F.col("list"), F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("list"), BATCH, "q", "list")
        met = meet_dense(asked.join(self.lists(), "list"), k, kinds[id_col], self.settings.id_type)
        return ranked(met, k, "query_id", F.desc("sim"), F.asc("id"))

    def scored(self, queries: DataFrame, id_col: str, vector_col: str, *, probe: int | None = None) -> DataFrame:
        """(query_id, scored): how many rows a search of each query scores."""
        sizes = self.lists().groupBy("list").agg(F.sum("d_rows").alias("n"))
        return self.probes(queries, id_col, vector_col, probe).select("id", "list").join(sizes, "list").groupBy(F.col("id").alias("query_id")).agg(F.sum("n").alias("scored"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, wanted, hit): of each query's exact rows, how many were found; a row as near as the last exact one counts."""
    last = exact.groupBy("query_id").agg(F.min("sim").alias("_least"), F.count("*").alias("wanted"))
    good = found.join(last, "query_id").where(F.round("sim", PLACES) >= F.col("_least")).groupBy("query_id").agg(F.count("*").alias("hit"))
    return last.join(good, "query_id", "left").select("query_id", "wanted", F.coalesce("hit", F.lit(0)).alias("hit"))
