"""Request admission: which requests a limit of so many in a window lets through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of each kind of route, the requests of one client that are served, and the seconds in which.
LIMITS = {"ingest": (100, 3_600), "query": (30, 60), "code": (20, 60)}


def _of(route: Column, at: int) -> Column:
    out = F.lit(None).cast("long")
    for name, limit in LIMITS.items():
        out = F.when(route == name, F.lit(limit[at]).cast("long")).otherwise(out)
    return out


def decided(requests: DataFrame, client: str = "client", route: str = "route", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """`requests` with `started`, `place`, `served` and `retry_after`.

    A client's requests to a route are counted in windows of the route's length that begin at
    multiples of it; the first so many of a window, by time, then `seq`, are served. A refused
    request may be tried again when its window is over, in `retry_after` seconds. Routes without
    a limit serve all. Counting goes window by window, so a client of any number of requests
    is as many groups as it has windows.
    """
    limit, seconds = _of(F.col(route), 0), _of(F.col(route), 1)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    started = F.when(seconds.isNotNull(), F.floor(at / (seconds * 1_000_000)) * seconds)
    rows = requests.withColumn("started", started)
    order = Window.partitionBy(client, route, "started").orderBy(ts, seq)
    rows = rows.withColumn("place", F.when(F.col("started").isNotNull(), F.row_number().over(order)))
    served = F.col("place").isNull() | (F.col("place") <= limit)
    left = F.ceil((F.col("started") + seconds) - at / 1_000_000).cast("long")
    return rows.withColumn("served", served).withColumn("retry_after", F.when(~served, left))


def refusals(rows: DataFrame, client: str = "client", route: str = "route") -> DataFrame:
    """(client, route, requests, refused) of decided requests."""
    return rows.groupBy(client, route).agg(F.count("*").alias("requests"), F.count_if(~F.col("served")).alias("refused"))
