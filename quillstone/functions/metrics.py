"""Retrieval and generation metrics as aggregates."""

from __future__ import annotations

import keyword
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96
#: Words that weigh 1 where others weigh PLAIN; the longest n-gram; what a length without a match counts.
KEYWORDS, PLAIN, LONGEST, NONE = tuple(keyword.kwlist), 0.2, 4, 0.1


def percent(hit: str | Column, places: int = 1) -> Column:
    """Share of hits in percent."""
    return F.round(100.0 * F.avg((F.col(hit) if isinstance(hit, str) else hit).cast("double")), places)


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval in percent, within 0 and 100, to one place."""
    n_, z = n.cast("double"), F.lit(Z)
    p = hits.cast("double") / n_
    low = 1 + z * z / n_
    mid = (p + z * z / (2.0 * n_)) / low
    half = z * F.sqrt((p * (1 - p) + z * z / (4.0 * n_)) / n_) / low
    bound = lambda x: F.round(100.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 1)
    return bound(mid - half), bound(mid + half)


def wilson_text(hits: Column, n: Column) -> Column:
    low, high = wilson(hits, n)
    return F.concat(F.format_string("%.1f", low), F.lit("-"), F.format_string("%.1f", high))


def at_ranks(rows: DataFrame, value: str, by: list[str], *ranks: tuple[str, Column]) -> DataFrame:
    """The values at given ranks of each group; a rank is an expression of the group's size `n`.

    Values are counted first, so what a group sorts is its distinct values, not its rows.
    """
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by).orderBy(value)
    placed = counted.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    hit = lambda rank: (F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank)
    return placed.groupBy(*by).agg(*[F.max(F.when(hit(r), F.col(value))).alias(name) for name, r in ranks])


def floor_rank(p: float) -> Column:
    """The place max(1, floor(n * p))."""
    return F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(p)))


def index_rank(p: float) -> Column:
    """The place floor(n * p) + 1."""
    return F.floor(F.col("n") * F.lit(p)) + 1


def edge_summary(rows: DataFrame) -> DataFrame:
    """One row over edge-eval rows (see schemas.EDGE_EVAL): recall, intervals, latencies."""
    n, out = F.count("*"), []
    for mode in ("naive", "graph"):
        hits = F.sum(f"{mode}_hit_at_8")
        out += [percent(f"{mode}_hit_at_8").alias(f"{mode}_recall_at_8"), wilson_text(hits, n).alias(f"{mode}_interval"), F.percentile(f"{mode}_latency_ms", 0.5).cast("int").alias(f"{mode}_p50_ms")]
    summary = rows.agg(n.alias("n"), F.sort_array(F.collect_set("repo")).alias("repos"), *out)
    for mode in ("naive", "graph"):
        summary = summary.join(at_ranks(rows.withColumn("_one", F.lit(1)), f"{mode}_latency_ms", ["_one"], (f"{mode}_p95_ms", floor_rank(0.95))).drop("_one"))
    return summary.withColumn("delta", F.round(F.col("graph_recall_at_8") - F.col("naive_recall_at_8"), 1))


def stable_sample(edges: DataFrame, by: str, src: str, dst: str, k: int = 40) -> DataFrame:
    """The first k edges of each group by the SHA-256 of "group:src:dst"."""
    key = F.sha2(F.concat_ws(":", by, src, dst), 256)
    return edges.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("_key", src, dst))).where(F.col("_n") <= k).drop("_key", "_n")


def ngram_counts(rows: DataFrame, id_col: str, tokens_col: str, n: int) -> DataFrame:
    grams = F.when(F.size(tokens_col) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens_col) - n + 1), lambda i: F.array_join(F.slice(tokens_col, i, n), " ")))
    return rows.select(F.col(id_col).alias("id"), F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("c"))


def bleu(rows: DataFrame, id_col: str = "id", candidate: str = "candidate", reference: str = "reference", longest: int = 4) -> DataFrame:
    """(id, bleu): clipped n-gram precision up to `longest`, with add-one smoothing above unigrams, and a brevity penalty."""
    split = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda t: t != "")
    rows = rows.select(F.col(id_col).alias("id"), split(candidate).alias("c"), split(reference).alias("r")).withColumn("nc", F.size("c")).withColumn("nr", F.size("r"))
    logs = F.lit(0.0)
    for n in range(1, longest + 1):
        own, other = ngram_counts(rows, "id", "c", n), ngram_counts(rows, "id", "r", n).withColumnRenamed("c", "limit")
        hit = own.join(other, ["id", "gram"], "left").groupBy("id").agg(F.sum(F.least("c", F.coalesce("limit", F.lit(0)))).alias(f"h{n}"), F.sum("c").alias(f"t{n}"))
        rows = rows.join(hit, "id", "left")
        up = 0.0 if n == 1 else 1.0
        share = (F.coalesce(f"h{n}", F.lit(0)) + up) / F.nullif(F.coalesce(f"t{n}", F.lit(0)) + F.lit(up), F.lit(0.0))
        logs = logs + F.when(share > 0, F.ln(share)) / longest
    brevity = F.when(F.col("nc") >= F.col("nr"), F.lit(1.0)).otherwise(F.exp(1 - F.col("nr") / F.nullif(F.col("nc"), F.lit(0))))
    return rows.select("id", F.coalesce(brevity * F.exp(logs), F.lit(0.0)).alias("bleu"))


_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
_COUNTED = "matches array<long>, candidates array<long>, references array<long>, weighted double, weights double, nc long, nr long"


def _counted(pairs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Of each pair of texts: clipped n-gram matches and n-grams of either, by length; matched and all weights of the reference's words."""
    for candidates, references, keywords in pairs:
        out = []
        for candidate, reference, known in zip(candidates, references, keywords, strict=True):
            c, r = (_WORD.findall(x or "") for x in (candidate, reference))
            own = [Counter(zip(*(w[i:] for i in range(n)), strict=False)) for w in (c, r) for n in range(1, LONGEST + 1)]
            own_c, own_r = own[:LONGEST], own[LONGEST:]
            known = set(() if known is None else known)
            weight = lambda counts: sum(n * (1.0 if w[0] in known else PLAIN) for w, n in counts.items())  # noqa: E731, B023
            out.append(([(x & y).total() for x, y in zip(own_c, own_r, strict=True)], [x.total() for x in own_c], [y.total() for y in own_r], weight(own_c[0] & own_r[0]), weight(own_r[0]), len(c), len(r)))
        yield pd.DataFrame(out, columns=["matches", "candidates", "references", "weighted", "weights", "nc", "nr"])


def corpus_bleu(rows: DataFrame, candidate: str = "candidate", reference: str = "reference", keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """One row: rows, `bleu` and `weighted` of a whole corpus.

    `bleu`: clipped n-gram matches of all rows over all n-grams of candidates, the geometric
    mean of four lengths, times one brevity penalty by total lengths. `weighted` measures
    recall: the same matches over the n-grams of references, single words by weight, 1 for a
    keyword and 0.2 for another. A length without a match counts 0.1 of one; without a single
    word in common both are 0. N-grams are counted inside rows and only sums are shuffled.
    """
    told = rows.select(F.pandas_udf(_counted, _COUNTED)(candidate, reference, F.array(*map(F.lit, keywords))).alias("x"))
    at = lambda c, i: F.sum(F.col("x")[c][i])
    sums = told.agg(
        F.count("*").alias("n"), F.sum("x.nc").alias("nc"), F.sum("x.nr").alias("nr"), F.sum("x.weighted").alias("hit_weight"), F.sum("x.weights").alias("all_weight"),
        *[at(c, i).alias(f"{c}{i}") for c in ("matches", "candidates", "references") for i in range(LONGEST)],
    )

    def score(hits: list[Column], totals: list[Column]) -> Column:
        logs = [F.ln(F.when(h > 0, h.cast("double")).otherwise(NONE) / F.greatest(F.coalesce(t, F.lit(0)), F.lit(1)).cast("double")) / LONGEST for h, t in zip(hits, totals, strict=True)]
        brevity = F.when(F.col("nc") > F.col("nr"), 1.0).when(F.col("nc") > 0, F.exp(1 - F.col("nr") / F.col("nc"))).otherwise(0.0)
        mean = F.exp(sum(logs[1:], logs[0]))
        return F.when(F.coalesce(F.col("matches0"), F.lit(0)) > 0, brevity * mean).otherwise(0.0)

    hits = [F.col(f"matches{i}") for i in range(LONGEST)]
    weighted = score([F.col("hit_weight"), *hits[1:]], [F.col("all_weight"), *(F.col(f"references{i}") for i in range(1, LONGEST))])
    return sums.select("n", score(hits, [F.col(f"candidates{i}") for i in range(LONGEST)]).alias("bleu"), weighted.alias("weighted"))


def code_bleu(ngram: Column, weighted: Column | None = None, syntax: Column | None = None, dataflow: Column | None = None) -> Column:
    """A quarter of each part; parts that are missing count as the n-gram part."""
    parts = [ngram, *(ngram if x is None else F.coalesce(x, ngram) for x in (weighted, syntax, dataflow))]
    total = parts[0] * 0.25
    for p in parts[1:]:
        total = total + p * 0.25
    return total


def generation_failures(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """One row: samples, and those for which a model gave no answer."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(answer).isNull()).alias("errors"))


def stream_totals(events: DataFrame, by: str = "stream", ts: str = "ts", event: str = "event") -> DataFrame:
    """Of each answer stream: how many tokens it gave and how many milliseconds it took from its first event to its last."""
    took = F.floor((F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1000)
    return events.groupBy(by).agg(F.count_if(F.col(event) == "token").alias("total_tokens"), took.alias("total_latency_ms"))


def pass_at_1(rows: DataFrame, passed: str = "passed") -> DataFrame:
    return rows.agg(F.count("*").alias("n"), percent(passed, 2).alias("pass_at_1"))


def delta(a: str | Column, b: str | Column, places: int = 2) -> Column:
    """a - b, null if either is."""
    get = lambda x: F.col(x) if isinstance(x, str) else x
    return F.round(get(a) - get(b), places)


def compared(base: DataFrame, tuned: DataFrame, metrics: list[str], hash_col: str = "test_hash") -> DataFrame:
    """Two one-row results side by side; fails where their test sets differ."""
    b = base.select(F.col(hash_col).alias("base_hash"), *[F.col(m).alias(f"base_{m}") for m in metrics])
    t = tuned.select(F.col(hash_col).alias("tuned_hash"), *[F.col(m).alias(f"tuned_{m}") for m in metrics])
    both = b.join(t)
    same = F.when(F.col("base_hash") == F.col("tuned_hash"), F.col("base_hash")).otherwise(F.raise_error(F.lit("the test sets differ")).cast("string"))
    return both.select(same.alias(hash_col), *[c for m in metrics for c in (F.col(f"base_{m}"), F.col(f"tuned_{m}"), delta(f"tuned_{m}", f"base_{m}").alias(f"delta_{m}"))])
