"""Batch retrieval: symbol seeds or vector seeds, one-hop expansion, fused scores, first eight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import embed, text
from ..sources.scratch import kept
from . import graph
from .topk import ranked, sparse_top_k

#: Fixed values.
SEEDS, FINAL = 5, 8
W_VECTOR, W_GRAPH, G_SEED, G_NEIGHBOUR = 0.6, 0.4, 1.0, 0.5


def name_index(chunks: DataFrame, k: int = SEEDS) -> DataFrame:
    """(name, ids): the first k chunks of each name, by id; a name that many chunks have sends k rows a task."""
    first = chunks.where("name is not null").select("name", "id").withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("n") <= k)
    return first.groupBy("name").agg(F.collect_list("id").alias("ids"))


def symbol_hits(questions: DataFrame, chunks: DataFrame, k: int = SEEDS) -> DataFrame:
    """(question_id, id, sim): chunks named in a question; similarity 1, by id, at most k.

    A question meets the first k chunks of a name, not all of them; `chunks` may be a
    `name_index`, which has made that cut.
    """
    asked = questions.select("question_id", F.explode(text.symbols("question")).alias("name"))
    index = chunks if "ids" in chunks.columns else name_index(chunks, k)
    hits = asked.join(index, "name").select("question_id", F.explode("ids").alias("id")).distinct()
    return ranked(hits.withColumn("sim", F.lit(1.0)), k, "question_id", F.asc("id")).select("question_id", "id", "sim")


def vector_hits(questions: DataFrame, vectors: DataFrame, k: int = SEEDS) -> DataFrame:
    """(question_id, id, sim) of the k most similar chunks with a common bucket."""
    asked = embed.vectors(questions, "question_id", "question")
    return sparse_top_k(asked, vectors, k).select("question_id", "id", "sim")


def seeds(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = SEEDS) -> DataFrame:
    """(question_id, id, sim, rank): a question's symbol hits, or its vector hits where it has none; `chunks` may be a `name_index`."""
    exact = kept(symbol_hits(questions, chunks, k), "exact")
    near = vector_hits(questions.join(exact.select("question_id"), "question_id", "left_anti"), vectors, k)
    order = Window.partitionBy("question_id").orderBy(F.desc("sim"), "id")
    return exact.union(near).withColumn("rank", F.row_number().over(order))


def seed_score(sim: str | Column) -> Column:
    return W_VECTOR * (F.col(sim) if isinstance(sim, str) else sim) + F.lit(W_GRAPH * G_SEED)


def neighbour_score() -> Column:
    return F.lit(W_VECTOR * 0.0 + W_GRAPH * G_NEIGHBOUR)


def fuse(seed: DataFrame, near: DataFrame, k: int = FINAL) -> DataFrame:
    """(question_id, id, type, score, rank): seeds, then neighbours that are no seeds, by score, first k.

    Equal scores keep seeds before neighbours, seeds in their order, neighbours by id.
    """
    s = seed.select("question_id", "id", F.lit("seed").alias("type"), seed_score("sim").alias("score"), F.lit(0).alias("after"), "rank")
    n = near.join(seed.select("question_id", "id"), ["question_id", "id"], "left_anti").select("question_id", "id", F.lit("neighbor").alias("type"), neighbour_score().alias("score"), F.lit(1).alias("after"), F.lit(0).alias("rank"))
    return ranked(s.union(n).withColumnRenamed("rank", "own"), k, "question_id", F.desc("score"), F.asc("after"), F.asc("own"), F.asc("id")).drop("after", "own")


def described(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (question_id, rank, id, type, score) with what is known of their chunks.

    Hits are few and written first, so that a plan knows it and chunks need no shuffle to meet them.
    """
    hits = kept(hits, "hits")
    about = chunks.select("id", "name", "file", F.array("start_line", "end_line").alias("lines"), F.col("document").alias("content"))
    return hits.join(about, "id").select("question_id", "rank", "id", "name", "file", "lines", "type", F.round("score", 4).alias("score"), "content")


def public_view(rows: DataFrame) -> DataFrame:
    return rows.drop("content", "id")


def naive(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = SEEDS, names: DataFrame | None = None) -> DataFrame:
    """Seeds as they are; the score is the similarity. `names` is a stored `name_index` of the chunks."""
    found = kept(seeds(questions, chunks if names is None else names, vectors, k), "seeds")
    return described(found.select("question_id", "rank", "id", F.lit("seed").alias("type"), F.col("sim").alias("score")), chunks)


def graph_augmented(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Seeds and their neighbours among `chunks`; a neighbour that is no function chunk drops out.

    `edges` may be a stored `graph.adjacency`, and `names` a stored `name_index` of the chunks.
    """
    return expanded(seeds(questions, chunks if names is None else names, vectors), chunks, edges)


def expanded(found: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Seeds that are known, with their neighbours among `chunks`; `edges` may be all, or those at the seeds."""
    near = graph.neighbours(found, edges).join(chunks.select("id"), "id", "left_semi").select("question_id", "id")
    return described(fuse(found, near), chunks)


def flatten_result(result: DataFrame) -> DataFrame:
    """Parallel arrays of one vector-store answer as rows, as many as the shortest list has.

    Distances that are not there at all count as 0; documents or metadata that are not there
    count as empty lists. What is missing inside a row gets a default.
    """
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.array())
    ids = first("ids")
    distances = F.when(F.col("distances").isNull(), F.array_repeat(F.lit(0.0), F.size(ids))).otherwise(first("distances"))
    shortest = F.least(*map(F.size, (ids, first("documents"), first("metadatas"), distances)))
    zipped = result.select(F.slice(F.arrays_zip(ids.alias("id"), first("documents").alias("document"), first("metadatas").alias("meta"), distances.alias("distance")), F.lit(1), shortest).alias("z"))
    rows = zipped.select(F.inline("z"))
    return rows.select(
        "id",
        F.coalesce("meta.name", F.lit("")).alias("name"),
        F.coalesce("meta.file", F.lit("")).alias("file"),
        F.array(F.coalesce("meta.start_line", F.lit(0)), F.coalesce("meta.end_line", F.lit(0))).alias("lines"),
        embed.similarity("distance").alias("sim"),
        F.coalesce("document", F.lit("")).alias("content"),
    )
