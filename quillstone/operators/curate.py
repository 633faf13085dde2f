"""Curation of commits: a first-fail chain of filters, an early stop, a seeded split, a manifest."""

from __future__ import annotations

import ast
import difflib
import hashlib
import json
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import kept

#: Fixed values.
BUG_WORDS = ("fix", "bug", "error", "exception", "null", "none", "crash", "fail", "incorrect", "wrong", "issue", "patch", "resolve", "broken", "invalid", "missing", "handle")
MIN_WORDS, MAX_CHARS, MAX_DIFF_LINES = 8, 3_500, 100
BUFFER = 10_000
ACCEPT, SCAN, SEED, SPLITS = 2_000, 750_000, 42, {"train": 1_500, "validation": 250, "test": 250}


@F.pandas_udf(T.IntegerType())
def diff_changed_lines(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Lines that a unified diff adds or takes away."""
    for a, b in pairs:
        out = []
        for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
            changed = difflib.unified_diff(x.splitlines(keepends=True), y.splitlines(keepends=True))
            out.append(sum(line[0] in "+-" and line[:3] not in ("+++", "---") for line in changed))
        yield pd.Series(out, dtype="int32")


@F.pandas_udf(T.BooleanType())
def python_parses(code: pd.Series) -> pd.Series:
    def parses(text: str) -> bool:
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return code.fillna("").map(parses).astype(bool)


def word_count(text: str | Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(r"(\S+)"), F.lit(1)))


def mentions(text: str | Column, words: tuple[str, ...] = BUG_WORDS) -> Column:
    """Whether one of the words stands in a text, by itself, in any case."""
    pattern = rf"(?i)(^|[^A-Za-z0-9_])({'|'.join(words)})($|[^A-Za-z0-9_])"
    return F.rlike(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(pattern))


def reject_reason(*, lang: str = "lang", message: str = "message", old: str = "old_contents", new: str = "new_contents", language: str = "python", words: tuple[str, ...] = BUG_WORDS, min_words: int = MIN_WORDS, max_chars: int = MAX_CHARS, diff: bool = True, syntax: bool = False) -> Column:
    """The first filter that a row fails, or null.

    The last two run in Python on every row, so rows that fail before them are handed over empty.
    """
    short = lambda c: F.length(F.coalesce(c, F.lit(""))) < max_chars
    reason = (
        F.when(F.lower(F.coalesce(lang, F.lit(""))) != language, "language")
        .when(word_count(message) < min_words, "message_quality")
        .when(~(short(old) & short(new)), "file_size")
        .when(F.col(old).eqNullSafe(F.col(new)), "actual_change")
        .when(~mentions(message, words), "bugfix_signal")
    )
    left = lambda c: F.when(cheap.isNull(), F.col(c))
    cheap = reason
    if diff:
        reason = reason.when(diff_changed_lines(left(old), left(new)) > MAX_DIFF_LINES, "diff_size")
    if syntax:
        reason = reason.when(~(python_parses(left(old)) & python_parses(left(new))), "syntax_valid")
    return reason


def shuffled(rows: DataFrame, key: str | Column, seed: int = SEED) -> DataFrame:
    """`rows` with `pos`, a number that orders them as a seeded hash of `key` does."""
    key = F.col(key) if isinstance(key, str) else key
    return rows.withColumn("pos", F.xxhash64(F.lit(seed), key))


def buffered(rows: DataFrame, *, seed: int = SEED, size: int = BUFFER, order: str = "pos") -> DataFrame:
    """`rows` as a shuffle with a bounded buffer emits them, with `order`, a number of the place.

    Each partition, and each batch of a stream, is read once: the buffer fills with `size` rows,
    then each row that comes takes the slot of one drawn by a seeded generator, which is emitted;
    what is left is emitted in drawn order. A row comes out at most `size` places before its own, and
    nothing else is held but the Arrow batch at hand. The same partitions give the same order
    again, so a task that is run anew emits what it did. `order` holds the partition's number
    times 2^33, plus a count.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        draw, held, n = np.random.Generator(np.random.PCG64([seed, part])), None, 0

        def out(table: pa.Table, places: list[int]) -> Iterator[pa.RecordBatch]:
            nonlocal n
            pos = pa.array(np.arange(n, n + len(places), dtype=np.int64) + (part << 33))
            n += len(places)
            yield from table.take(pa.array(places, pa.int64())).append_column(order, pos).combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            slots, come = list(range(table.num_rows - batch.num_rows)), []
            drawn = iter((draw.random(max(0, table.num_rows - size)) * size).astype(np.int64).tolist())  # one number a row, however rows are batched
            for i in range(len(slots), table.num_rows):
                if len(slots) < size:
                    slots.append(i)
                else:
                    j = next(drawn)
                    come.append(slots[j])
                    slots[j] = i
            yield from out(table, come)
            held = table.take(pa.array(slots, pa.int64())).combine_chunks()
        if held is not None:
            yield from out(held, draw.permutation(held.num_rows).tolist())

    return rows.mapInArrow(emit, T.StructType([*rows.schema.fields, T.StructField(order, T.LongType())]))


class TooFew(ValueError):
    """A scan ended before it had enough accepted rows."""


def first_accepted(judged: DataFrame, accept: int = ACCEPT, scan: int = SCAN, order: str = "pos", reason: str = "reject_reason", *, strict: bool = False) -> DataFrame:
    """The rows that a scan in `order` sees before it has `accept` accepted rows or `scan` rows, with `seen` and `accepted` so far.

    `order` holds a number for each row. Rows are judged once, as a written table; only number
    and flag of at most `scan` rows are put in order to find where the scan ends, and whole rows
    are then cut by the number. With `strict`, fewer than `accept` accepted rows are an error.
    """
    judged = kept(judged, "judged")
    ok = F.col(reason).isNull().cast("long")
    head = judged.select(order, ok.alias("ok")).orderBy(order).limit(scan)
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = head.withColumn("seen", F.row_number().over(w).cast("long")).withColumn("accepted", F.sum("ok").over(w))
    if strict:
        told = head.agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"), F.count("*").alias("n")).first()
        if told.ok < accept:
            raise TooFew(f"{told.ok} of {told.n} scanned rows were accepted, {accept} are needed")
    return judged.join(placed.where(F.col("accepted") - F.col("ok") < accept).drop("ok"), order)


def rejections(scanned: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return scanned.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def split_rows(sizes: dict[str, int] = SPLITS, seed: int = SEED) -> list[tuple[int, str, int]]:
    """(place, split, slot): a seeded permutation of all places, cut into the splits."""
    places = list(range(sum(sizes.values())))
    random.Random(seed).shuffle(places)
    rows, at = [], 0
    for name, n in sizes.items():
        rows += [(p, name, i) for i, p in enumerate(places[at : at + n])]
        at += n
    return rows


def split_places(spark: SparkSession, sizes: dict[str, int] = SPLITS, seed: int = SEED) -> DataFrame:
    return spark.createDataFrame(split_rows(sizes, seed), "place long, split string, slot int")


def split(accepted: DataFrame, sizes: dict[str, int] = SPLITS, seed: int = SEED, place: str = "accepted") -> DataFrame:
    """`accepted` (numbered from 1 in `place`) with split and slot; the permutation has a fixed size and is broadcast."""
    places = F.broadcast(split_places(accepted.sparkSession, sizes, seed))
    return accepted.join(places, F.col(place) - 1 == places["place"]).drop("place")


def manifest(files: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: SHA-256 of each output file (path, content) and the row counts by split."""
    hashes = files.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.element_at(F.split("path", "/"), -1), F.sha2("content", 256))))).alias("sha256"))
    return hashes.join(counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "n")))).alias("rows")))


def line_digest(line: str) -> Column:
    return F.sha2(F.encode(F.coalesce(line, F.lit("")), "UTF-8"), 256)


def digests(rows: DataFrame, by: str, index: str, line: str, *, block: int = 1_000) -> DataFrame:
    """(by, n, sha256): one digest of each group's lines in order of `index`, which counts from 0 without gaps.

    Digests of lines are joined block by block, by index, and digested again, at least twice
    and until one is left. No task holds more than a block, and how rows are dealt to
    partitions or files changes nothing. A column `sha256` holds lines' digests already.
    """
    own = F.col("sha256") if line == "sha256" else line_digest(line)
    level = rows.select(by, F.col(index).cast("long").alias("i"), own.alias("d"), F.lit(1).cast("long").alias("n"))
    last = rows.agg(F.coalesce(F.max(F.col(index).cast("long")), F.lit(0)).alias("i")).first().i
    rounds = 0
    while rounds < 2 or last > 0:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]), "")
        level = level.groupBy(by, F.floor(F.col("i") / block).alias("at")).agg(F.sha2(F.encode(joined, "UTF-8"), 256).alias("d"), F.sum("n").alias("n")).select(by, F.col("at").alias("i"), "d", "n")
        last, rounds = last // block, rounds + 1
    return level.select(by, "n", F.col("d").alias("sha256"))


def dataset_manifest(samples: DataFrame, *, dataset: str, configuration: str, scanned: int, seed: int = SEED, provenance: dict[str, str] | None = None, filters: dict[str, object] | None = None, scan: int = SCAN, buffer: int = BUFFER) -> DataFrame:
    """One row, `manifest`: JSON about a written dataset from its samples (split, slot, place, line), or `sha256`, a line's digest, for `line`.

    Each split's lines are counted and digested in order of their slots; so are the places that
    the splits took of the accepted rows. The rest says where the rows came from and what they
    passed. Keys are sorted and nothing depends on partitions, so equal data gives equal JSON.
    """
    spark = samples.sparkSession
    own = digests(samples, "split", "slot", "sha256" if "sha256" in samples.columns else "line").orderBy("split").collect()  # a row a split
    places = digests(samples.withColumn("line", F.col("place").cast("string")), "split", "slot", "line").orderBy("split").collect()
    whole = "".join(f"{r.split}:{r.sha256};" for r in places)
    told = {
        "provenance": {"engine": "quillstone", "spark": spark.version} | (provenance or {}),
        "dataset": dataset,
        "configuration": configuration,
        "random_seed": seed,
        "filters": {"max_file_chars": MAX_CHARS, "max_diff_lines": MAX_DIFF_LINES, "min_message_words": MIN_WORDS, "bugfix_keyword_filter": True, "syntax_valid_python": False} | (filters or {}),
        "source_access": {"mode": "streaming", "source_rows_scanned": scanned, "source_scan_limit": scan, "accepted_samples": sum(r.n for r in own), "shuffle_seed": seed, "shuffle_buffer_size": buffer},
        "splits": {r.split: {"path": f"{r.split}.jsonl", "samples": r.n, "sha256": r.sha256} for r in own},
        "split_indices_sha256": hashlib.sha256(whole.encode()).hexdigest(),
    }
    return spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "manifest string")
