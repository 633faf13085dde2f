"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, lines, minhash, packing, toxicity
from quillstone.llm.common import discard, staged, table


def _free(docs: DataFrame, name: str) -> str:
    """A name like `name` that no column of `docs` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _own(docs: DataFrame) -> list[Column]:
    """The columns of `docs`, whatever signs their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores under 0.5.

    Null and empty texts have nothing to score but the model's start, and stay while that is
    under 0.5. Rows with a null id stay or go by their text, repeated rows together; an empty
    table stays empty. Columns of any name pass.
    """
    score = _free(docs, "score")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, result=score).where(F.col(score) < 0.5).select(*_own(docs))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur across sites are cut from every document that has other lines; a text that was cut has its length set anew.

    Null and empty texts, and documents of shared lines only, stay as they are. Rows with a null
    id are cut like others, repeated rows alike; an empty table stays empty.
    """
    removed = _free(docs, "removed")
    out = lines.without_boilerplate(docs, lines_col=_free(docs, "lines"), removed_col=removed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*_own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of similarity 0.8 or more over five words, stays: the one with the smallest id.

    Null and empty texts are like nothing and stay, as do rows without an id, which no other row
    could be told to stand for. Rows that repeat an id stay or go together. An empty table
    stays empty.
    """
    gone = _free(docs, "gone")
    ids = minhash.near_duplicates(docs, percent=80, bands=36, rows=6).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti").select(*_own(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts hold no window and stay. Ids are not read, so rows with a null id and
    repeated rows are judged by their texts; an empty table or benchmark changes nothing.
    """
    result = _free(docs, "found")
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), result=result)
    return found.where(F.size(F.col(result)["spans"]) == 0).select(*_own(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens (see `packing.pack`): a null or empty text is the end id alone, repeated rows are documents of their own."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Toxicity scores, shingle similarity and packing have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None
