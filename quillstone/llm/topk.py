"""Exact top-k by inner product with block-at-a-time pruning.

Rows are cut into document-range blocks. A block has its rows as a forward index (a dense
integer matrix) and, for each component, its largest and smallest value. For a query, the sum
over components of q * largest (q * smallest where q is negative) bounds every score in the
block. Blocks are taken in order of that bound and scored until the next bound is below the
k-th score so far; on equality they are scored too, as ties go to smaller ids.

Blocks travel packed, many to a group, and groups are dealt to tiles; each batch of queries
goes to every tile and meets that tile's groups there. It does so twice. The first time, each
query scores only the block with the largest bound of each group; the k-th best of these scores
over the whole table is the floor under which no block of any group is scored the second time.
What leaves a meeting is k rows a query at most, and none below the floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Exact in doubles below this.
_EXACT = 1 << 53
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component, as doubles; rows that take no part are left out."""
    clean = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    own = rows.where(F.col(id_col).isNotNull() & clean).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double") * F.lit(float(scale))).alias("raw"))
    # doubles from 2^53 on are whole numbers
    return own.select("id", F.transform("raw", lambda y: F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)).alias("v"))


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


_WIDE = "ids binary, width long, data binary, floors binary"


def _packed(size: int):
    """Rows of a partition, `size` at a time, as one wide row; `floor` is a query's, if it has one."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        vectors: list = []
        floors: list[int] = []

        def row(n: int) -> tuple:
            width = max(map(len, vectors[:n]))
            out = (np.array(ids[:n], dtype=np.int64).tobytes(), width, _matrix(vectors[:n], width).tobytes(), np.array(floors[:n], dtype=np.int64).tobytes())
            del ids[:n], vectors[:n], floors[:n]
            return out

        for batch in batches:
            ids += batch.id.tolist()
            vectors += batch.v.tolist()
            floors += batch["floor"].tolist() if "floor" in batch else [_LOW] * len(batch)
            rows = []
            while len(ids) >= size:
                rows.append(row(size))
            if rows:
                yield pd.DataFrame(rows, columns=["ids", "width", "data", "floors"])
        if ids:
            yield pd.DataFrame([row(len(ids))], columns=["ids", "width", "data", "floors"])

    return pack


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers of any size."""
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def best_in_group(*group, **options) -> list[tuple[int, int, int]]:
    """(query, id, score) as `counted` gives them."""
    return counted(*group, **options)[0]


def counted(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int, floors: np.ndarray | None = None, *, first: bool = False) -> tuple[list[tuple[int, int, int]], int, int]:
    """(query, id, score): each query's k best rows of a group but itself, by pruned blocks, and how many
    blocks were scored of how many there are. None is below a query's floor; `first` scores one block only."""
    width = max(queries.shape[1], rows.shape[1], 1)
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    floors = np.full(len(qids), _LOW, dtype=np.int64) if floors is None else floors
    q, r = queries.astype(float), rows.astype(float)
    cuts = list(range(0, len(rows), block))
    high = np.stack([r[c : c + block].max(axis=0) for c in cuts])
    low = np.stack([r[c : c + block].min(axis=0) for c in cuts])
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    most = float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * width
    if most < _EXACT:  # then products of doubles are whole numbers
        queries, rows = q, r
    else:  # rounded doubles are made larger than any rounding; scores are whole numbers, of any size where they must be
        bounds += (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T) * (width * 4e-16) + 1
        queries, rows = (queries.astype(np.int64), rows.astype(np.int64)) if most < 1 << 62 else (_whole(queries), _whole(rows))
    found, scored = [], 0
    for n, (qid, query, floor) in enumerate(zip(qids.tolist(), queries, floors.tolist(), strict=True)):
        top_ids, top = np.empty(0, dtype=np.int64), np.empty(0, dtype=rows.dtype)
        for b in np.argsort(-bounds[n], kind="stable")[: 1 if first else None]:
            if floor > _LOW and bounds[n, b] < floor or len(top) >= k and bounds[n, b] < top[k - 1]:
                break
            scored += 1
            at = cuts[b]
            score, own = rows[at : at + block] @ query, ids[at : at + block]
            ok = own != qid
            if len(top) >= k:
                ok &= (score >= top[k - 1]).astype(bool)
            if floor > _LOW:
                ok &= (score >= floor).astype(bool)
            if ok.any():
                top_ids, top = np.r_[top_ids, own[ok]], np.r_[top, score[ok]]
                order = np.array(sorted(range(len(top)), key=lambda i: (-top[i], top_ids[i]))[:k]) if top.dtype == object else np.lexsort((top_ids, -top))[:k]
                top_ids, top = top_ids[order], top[order]
        found += [(qid, int(i), min(max(int(s), _LOW), _HIGH)) for i, s in zip(top_ids, top, strict=True)]
    return found, scored, len(cuts) * len(qids)


def _meet(k: int, block: int, *, first: bool, report: bool = False):
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                qids, ids = np.frombuffer(r.qids, dtype=np.int64), np.frombuffer(r.ids, dtype=np.int64)
                queries = np.frombuffer(r.qdata).reshape(len(qids), r.qwidth)
                rows = np.frombuffer(r.data).reshape(len(ids), r.width)
                found, scored, blocks = counted(qids, queries, ids, rows, k, block, np.frombuffer(r.qfloors, dtype=np.int64), first=first)
                yield pd.DataFrame([(scored, blocks)], columns=["scored", "blocks"]) if report else pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return meet


def _ready(candidates: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, scale: float, block: int, group: int, batch: int) -> DataFrame:
    """Queries with their floors, next to every group of rows."""
    spark = candidates.sparkSession
    rows = quantised(candidates, id_col, vector_col, scale)
    asked = quantised(queries, id_col, vector_col, scale)
    # alike vectors side by side keep a block's bounds tight: by strongest component, then id, so equal vectors spread too
    strongest = F.array_position(F.transform("v", F.abs), F.array_max(F.transform("v", F.abs)))
    rows = rows.withColumn("near", F.when(F.size("v") > 0, strongest).otherwise(F.lit(0).cast("long"))).withColumn("sign", F.try_element_at("v", F.greatest("near", F.lit(1)).cast("int")))
    width = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = rows.repartitionByRange(width, "near", "sign", "id").sortWithinPartitions("near", "sign", "id").select("id", "v").mapInPandas(_packed(group), _WIDE)
    groups = staged(groups.withColumn("tile", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(width)).cast("int")), "groups")

    def beside(asked: DataFrame) -> DataFrame:
        packed = asked.repartition(width, "id").mapInPandas(_packed(batch), _WIDE)
        packed = packed.select(F.col("ids").alias("qids"), F.col("width").alias("qwidth"), F.col("data").alias("qdata"), F.col("floors").alias("qfloors"))
        packed = packed.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        # estimates know neither the wide rows nor how often they are repeated, and would broadcast them
        return packed.hint("merge").join(groups, "tile").select("qids", "qwidth", "qdata", "qfloors", "ids", "width", "data")

    first = beside(asked).mapInPandas(_meet(k, block, first=True), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    return beside(staged(asked.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(_LOW))), "asked"))


def pruning(candidates: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, scale: float = 256.0, block: int = 64, group: int = 4096, batch: int = 512) -> DataFrame:
    """One row: how many blocks the second pass of `top_k` scores (scored), of all that each query could (blocks)."""
    met = _ready(candidates, queries, id_col, vector_col, k, scale, block, group, batch)
    return met.mapInPandas(_meet(k, block, first=False, report=True), "scored long, blocks long").agg(F.sum("scored").alias("scored"), F.sum("blocks").alias("blocks"))


def top_k(candidates: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, scale: float = 256.0, block: int = 64, group: int = 4096, batch: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates but its own row.

    Vectors that are null, or hold a null or non-finite component, take no part, nor do rows
    with a null id; an empty vector scores 0 everywhere. Vectors of unequal length meet as if
    the shorter ended in zeros. A score beyond a long is given as the nearest long; among such
    scores the smaller id comes first. Rows that repeat an id each count; a
    query never meets rows with its id. Ties go to the smaller id. With no queries or no
    candidates the result is empty. Other columns are not read.
    """
    met = _ready(candidates, queries, id_col, vector_col, k, scale, block, group, batch)
    met = met.mapInPandas(_meet(k, block, first=False), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
