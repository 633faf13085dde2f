"""Labelled rows for the two classifiers: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str | Column, by: int = 5) -> Column:
    """crc32 of the id's text, modulo `by`; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.encode(c.cast("string"), "UTF-8")), F.lit(by))


def is_held_out(id_col: str | Column) -> Column:
    """True where a row's label must not be learned; a row without an id has no label."""
    return F.coalesce(remainder(id_col) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, *, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label, weight) of at most about `max_rows` labelled rows of each class that are not held out.

    Rows are taken by a hash of their ids, so that a class keeps its make-up, and weighted so
    that the classes keep their shares. Labels that repeat an id count once, the largest wins;
    labels other than 0 and 1 are passed over.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~is_held_out("_id"))
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    n = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}  # two rows
    share = {c: min(1.0, max_rows / max(1, n.get(c, 0))) for c in (0, 1)}
    place = F.pmod(F.xxhash64("_id", F.lit(20240101)), F.lit(1 << 30))
    chosen = known.where(place < F.when(F.col("_label") == 1, F.lit(int(share[1] * (1 << 30)))).otherwise(F.lit(int(share[0] * (1 << 30)))))
    chosen = F.broadcast(chosen.limit(2 * max_rows + 2000))  # two integers a row: bounded by max_rows
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    weight = F.when(F.col("_label") == 1, F.lit(1.0 / share[1])).otherwise(F.lit(1.0 / share[0]))
    return text.join(chosen, "_id").groupBy("_id", "_label").agg(F.max("_text").alias("_text")).select(F.col("_id").alias("id"), F.coalesce("_text", F.lit("")).alias("text"), F.col("_label").alias("label"), weight.alias("weight"))
