"""Hash embedding: md5 buckets of tokens, L2-normalised, kept sparse."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: length of a vector.
DIMENSIONS = 384
_TOKEN = re.compile("[a-z_0-9]+")


def tokens(text: str | Column) -> Column:
    """Runs of ASCII letters, digits and underscores, lower-cased; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z_0-9]+)"), F.lit(1))


def bucket(word: str | Column) -> Column:
    """The md5 of a word as a number, modulo 384.

    384 is 2^7 * 3, so 2^48 and 2^96 both leave 256: the digest's 32, 48 and 48 bits fold to
    one small sum, without arithmetic beyond a long.
    """
    digest = F.md5(F.encode(word, "UTF-8"))
    part = [F.conv(F.substring(digest, at, n), 16, 10).cast("long") for at, n in ((1, 8), (9, 12), (21, 12))]
    return ((F.lit(256) * (part[0] + part[1]) + part[2]) % DIMENSIONS).cast("int")


#: Texts whose counts are held at a time, and words whose buckets are; a batch may have many more.
_SLICE, _KNOWN = 500, 50_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's buckets in order and how many of its tokens fall into each; a word's bucket is looked up once known."""
    known: dict[str, int] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, _SLICE):
            part = batch.slice(start, _SLICE)
            buckets, counts, ends = [], [], [0]
            for text in part.column(1):
                found = []
                for word in _TOKEN.findall(text.as_py().lower()):
                    if (b := known.get(word)) is None:
                        if len(known) >= _KNOWN:
                            known.clear()
                        b = int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()) % DIMENSIONS
                        if len(word) <= 100:
                            known[word] = b
                    found.append(b)
                n = np.bincount(np.array(found, dtype=np.int64), minlength=1)
                at = np.flatnonzero(n)
                buckets.append(at.astype(np.int32))
                counts.append(n[at])
                ends.append(ends[-1] + len(at))
            listed = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (buckets, counts)]
            yield pa.RecordBatch.from_arrays([part.column(0), *listed], ["id", "buckets", "counts"])


def _counted(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, buckets, counts) of each text with tokens, counted where it is read, a few texts at a time.

    Array functions alone can do it, but hash every token anew and took ten times as long.
    """
    with_tokens = rows.where(F.rlike(F.lower(text_col), F.lit("[a-z_0-9]")))
    return with_tokens.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_count, f"id {dict(rows.dtypes)[id_col]}, buckets array<int>, counts array<long>")


def token_counts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bucket, n): how many of a row's tokens fall into each bucket."""
    return _counted(rows, id_col, text_col).select("id", F.explode(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("counts").alias("n"))).alias("c")).select("id", "c.bucket", "c.n")


def vectors(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, buckets, weights) with unit length, a row for each text that has tokens; made without a shuffle."""
    own = _counted(rows, id_col, text_col)
    length = F.sqrt(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n * n).cast("double"))
    # repeated, as a lambda would work the length out anew for each entry
    return own.select("id", "buckets", F.zip_with("counts", F.array_repeat(length, F.size("counts")), lambda n, x: n / x).alias("weights"))


def entries(rows: DataFrame) -> DataFrame:
    """(id, bucket, weight) of vectors as `vectors` gives them."""
    return rows.select("id", F.explode(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("weights").alias("weight"))).alias("e")).select("id", "e.bucket", "e.weight")


def sparse_vectors(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bucket, weight) with unit length for each id; a text without tokens has no rows."""
    return entries(vectors(rows, id_col, text_col))


def packed(vectors: DataFrame) -> DataFrame:
    """Vectors as `vectors` gives them; those given by entry are gathered, a row for each id."""
    if "buckets" in vectors.columns:
        return vectors
    rows = vectors.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("bucket", "weight"))).alias("e"))
    return rows.select("id", F.col("e.bucket").alias("buckets"), F.col("e.weight").alias("weights"))


def norms(vectors: DataFrame) -> DataFrame:
    return packed(vectors).select("id", F.sqrt(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w)).alias("norm"))


def densify(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, vector): arrays of doubles, zero where a sparse vector has no entry."""
    m = F.array_repeat(F.map_from_arrays("buckets", "weights"), dimensions)  # once, not for each place
    at = F.zip_with(F.sequence(F.lit(0), F.lit(dimensions - 1)), m, lambda i, x: F.coalesce(F.try_element_at(x, i), F.lit(0.0)))
    return packed(vectors).select("id", at.alias("vector"))


def dot(x: str | Column, y: str | Column) -> Column:
    """Inner product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: str | Column) -> Column:
    return F.sqrt(dot(x, x))


def similarity(distance: str | Column) -> Column:
    """Of a cosine distance: 1 - d, not below 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - (F.col(distance) if isinstance(distance, str) else distance))
