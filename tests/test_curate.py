"""Curation: the bounded shuffle, the scan that must find enough."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import curate


def shuffled_by_hand(rows, seed, part, size):
    draw, buffer, out = np.random.Generator(np.random.PCG64([seed, part])), [], []
    for r in rows:
        if len(buffer) < size:
            buffer.append(r)
        else:
            j = int(draw.random() * size)
            out.append(buffer[j])
            buffer[j] = r
    return out + [buffer[j] for j in draw.permutation(len(buffer))]


@pytest.mark.parametrize("n, size", [(1, 10), (10, 10), (500, 10), (500, 1), (3_000, 700)])
def test_buffered_order(spark, n, size):
    """One partition, as a plain buffer gives it, whatever the batches are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = curate.buffered(spark.range(n).coalesce(1), size=size).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.pos for r in got] == list(range(n))
    by_hand = shuffled_by_hand(range(n), curate.SEED, 0, size)
    assert [r.id for r in got] == by_hand and sorted(by_hand) == list(range(n))
    assert all(r.id <= r.pos + size for r in got)


def test_buffered_is_replayed(spark):
    rows = spark.range(5_000).repartition(4).withColumn("t", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")))
    key = lambda df: sorted((r.pos, r.id, r.t) for r in df.collect())
    a, b, c = (key(curate.buffered(rows, size=100, seed=s)) for s in (1, 1, 2))
    assert a == b != c and sorted(x[1] for x in a) == list(range(5_000))
    assert [x[1] for x in a] != sorted(x[1] for x in a)
    assert curate.buffered(rows.limit(0)).collect() == []


def test_too_few_accepted_rows(spark):
    judged = spark.range(50).select(F.col("id").alias("pos"), F.when(F.col("id") % 5 > 0, "bad").alias("reject_reason"))
    assert curate.first_accepted(judged, accept=10, strict=True).count() == 46
    with pytest.raises(curate.TooFew, match="10 of 50"):
        curate.first_accepted(judged, accept=11, strict=True)
    assert curate.first_accepted(judged, accept=11).count() == 50
