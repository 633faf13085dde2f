"""Vector top-k: batches of queries meet blocks of rows, tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import embed

#: Scores are compared after rounding, so the order of a sum cannot change a rank.
PLACES = 9


def ranked(rows: DataFrame, k: int, by: str, *order: Column) -> DataFrame:
    """The first k rows of each `by`, with their rank; keeps k rows a key before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


#: Rows of a block and queries of a batch; as dense doubles, 6 MB and 1.5 MB.
BLOCK, BATCH = 2_048, 512


def _packed(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """A partition's vectors, `size` at a time, as few wide rows: {name}_ids, {name}_sizes, {name}_flat."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                ids, buckets, weights = batch.slice(at, size).columns
                entry = np.empty(len(buckets.flatten()), dtype=_ENTRY)
                entry["bucket"], entry["weight"] = buckets.flatten(), weights.flatten()
                sizes = np.asarray(buckets.value_lengths(), dtype=np.int32)
                one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([one, pa.array([sizes.tobytes()], pa.binary()), pa.array([entry.tobytes()], pa.binary())], [f"{name}_ids", f"{name}_sizes", f"{name}_flat"])

    return vectors.select("id", "buckets", "weights").mapInArrow(pack, f"{name}_ids array<{dict(vectors.dtypes)['id']}>, {name}_sizes binary, {name}_flat binary")


_ENTRY = np.dtype([("bucket", np.int32), ("weight", np.float64)])


def _dense(sizes: bytes | pa.Buffer, flat: bytes | pa.Buffer) -> np.ndarray:
    n, entry = np.frombuffer(sizes, dtype=np.int32), np.frombuffer(flat, dtype=_ENTRY)
    out = np.zeros((len(n), embed.DIMENSIONS))
    out[np.repeat(np.arange(len(n)), n), entry["bucket"]] = entry["weight"]
    return out


def _meet(k: int):
    """Each query's k best rows of a block, by similarity, then id. Packs are read where the batch holds them, without a copy."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(name).type.value_type for name in ("q_ids", "d_ids")]
            for i in range(batch.num_rows):
                asked, ids = (batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in ("q_ids", "d_ids"))
                left, right = (_dense(*(batch.column(f"{name}_{x}")[i].as_buffer() for x in ("sizes", "flat"))) for name in "qd")
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                sims = np.round(left @ right[order].T, PLACES)
                best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                top = np.take_along_axis(sims, best, axis=1)
                q, at = np.nonzero(top > 0)
                yield pa.RecordBatch.from_arrays([pa.array(asked[q], kinds[0]), pa.array(ids[best[q, at]], kinds[1]), pa.array(top[q, at])], ["question_id", "id", "sim"])

    return meet


def sparse_top_k(questions: DataFrame, documents: DataFrame, k: int, *, tiles: int | None = None) -> DataFrame:
    """(question_id, id, sim, rank) over vectors of questions and documents, packed or by entry.

    Documents without a common bucket have similarity 0 and are not returned. Documents travel
    once, packed in blocks that are dealt to tiles; each batch of questions goes to every tile.
    What leaves a meeting is k rows a question at most, so the shuffle before the last cut does
    not grow with questions times documents.

    Neither side is broadcast: estimates know neither the width of packs nor how often they are repeated.
    """
    questions, documents = embed.packed(questions), embed.packed(documents)
    tiles = tiles or max(2, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _packed(documents, BLOCK, "d").withColumn("tile", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(tiles)).cast("int"))
    asked = _packed(questions, BATCH, "q").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    met = asked.hint("merge").join(rows, "tile").drop("tile").mapInArrow(_meet(k), f"question_id {dict(questions.dtypes)['id']}, id {dict(documents.dtypes)['id']}, sim double")
    return ranked(met, k, "question_id", F.desc("sim"), F.asc("id"))


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of unit length; a vector that is null, not finite or zero becomes zeros, and is like nothing."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    flat = np.array([np.zeros(width) if v is None else v for v in vectors], dtype=np.float64).reshape(len(vectors), width)
    length = np.sqrt((flat * flat).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return np.where(good[:, None], flat, 0.0) / np.where(good, length, 1.0)[:, None]


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products; a side without a single vector has no width, and its products are 0."""
    return left @ right.T if left.shape[1] and right.shape[1] else np.zeros((len(left), len(right)))


def packed_dense(rows: DataFrame, size: int, name: str, *keys: str) -> DataFrame:
    """Vectors (id, v) of a partition, `size` at a time, as few wide rows: `keys`, {name}_ids and {name}_flat.

    Rows of a pack have the same keys, so a partition should hold those together.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, group in batch.groupby(list(keys), sort=False) if keys else [((), batch)]:
                for at in range(0, len(group), size):
                    part = group.iloc[at : at + size]
                    own = {k: [x] for k, x in zip(keys, key, strict=True)}
                    yield pd.DataFrame(own | {f"{name}_ids": [part["id"].to_list()], f"{name}_flat": [_unit(part["v"]).tobytes()]})

    kinds = dict(rows.dtypes)
    return rows.select(*keys, "id", "v").mapInPandas(pack, "".join(f"{k} {kinds[k]}, " for k in keys) + f"{name}_ids array<{kinds['id']}>, {name}_flat binary")


def meet_dense(pairs: DataFrame, k: int, query_type: str, id_type: str) -> DataFrame:
    """(query_id, id, sim) of pairs of packs (q_, d_): each query's k best rows of a block but itself, by similarity, then id."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                asked, ids = np.asarray(r.q_ids), np.asarray(r.d_ids)
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                left, right = (np.frombuffer(x).reshape(n, -1) for x, n in ((r.q_flat, len(asked)), (r.d_flat, len(ids))))
                sims = np.maximum(np.round(_products(left, right[order]), PLACES), 0.0)
                sims[asked[:, None] == ids[None, :]] = -1.0
                best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                top = np.take_along_axis(sims, best, axis=1)
                q, at = np.nonzero(top >= 0)
                yield pd.DataFrame({"query_id": asked[q], "id": ids[best[q, at]], "sim": top[q, at]})

    return pairs.select("q_ids", "q_flat", "d_ids", "d_flat").mapInPandas(meet, f"query_id {query_type}, id {id_type}, sim double")


def dense_top_k(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int, *, where: Column | None = None, tiles: int | None = None) -> DataFrame:
    """(query_id, id, sim, rank): cosine similarity of each query with every other row, not below 0.

    Rows travel once, packed in blocks that are dealt to tiles; each batch of queries goes to
    every tile and meets a block in one product of matrices. k rows a query leave a meeting.
    """
    rows = rows if where is None else rows.where(where)
    tiles = tiles or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    blocks = packed_dense(own(rows), BLOCK, "d").withColumn("tile", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(tiles)).cast("int"))
    asked = packed_dense(own(queries), BATCH, "q").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    met = meet_dense(asked.hint("merge").join(blocks, "tile"), k, dict(queries.dtypes)[id_col], dict(rows.dtypes)[id_col])
    return ranked(met, k, "query_id", F.desc("sim"), F.asc("id"))
