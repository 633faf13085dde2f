"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are runs of `window` words (a shorter item is one window). A window is the
sequence of its shingles (up to three words each), ordered by rarity: how many documents hold
the shingle, counted over all of them. For containment of a whole window the necessary prefix
is one shingle, the rarest; a document without it cannot hold the window. Documents meet
windows on that shingle only; the shingle's place in the window gives the one position where
the window could begin, the document's length bounds it, and the words there are then compared.

The benchmark's side travels to the documents' tasks, in parts of at most `max_windows`
windows; an item with more is split over parts. A larger benchmark takes a further pass for each
further part: what the pass finds is written, by the texts' digests, before the next part is
read, so tasks and driver hold one part at a time. The passes' spans are merged for each text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: A word is a run of digits, letters and whatever lies beyond ASCII; in UTF-8 all of that is bytes from 128 on.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHINGLE = 3


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class _Vocabulary(dict):
    """Numbers of benchmark words; -1 for any other."""

    def __missing__(self, word: bytes) -> int:
        return -1


def _keys(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """One number for each `width`-word shingle; -1 where a word is not the benchmark's."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.int64)
    known = np.ones(n, dtype=bool)
    for i in range(width):
        part = codes[i : i + n]
        known &= part >= 0
        out = out * base + part
    out[~known] = -1
    return out


@dataclass
class Index:
    vocabulary: dict[bytes, int]
    base: int
    shingles: dict[int, np.ndarray]  # by shingle width: sorted keys
    numbers: dict[int, np.ndarray]  # their numbers, over all widths
    windows: dict[int, dict[tuple[int, int], dict[bytes, tuple[int, ...]]]]  # by prefix shingle, its offset and the window's length: items by the window's words

    def codes(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def parts(self) -> tuple:
        return self.vocabulary, self.base, self.shingles, self.numbers, self.windows

    def ready(self) -> Index:
        self._known = _Vocabulary(self.vocabulary)
        return self

    def found(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, shingle numbers) of the index's shingles in a document."""
        for width, keys in self.shingles.items():
            own = _keys(codes, width, self.base)
            at = np.flatnonzero(own >= 0)
            if len(at) and len(keys):
                place = np.searchsorted(keys, own[at])
                hit = keys[np.minimum(place, len(keys) - 1)] == own[at]
                yield at[hit], self.numbers[width][place[hit]]

    def spans(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Verified occurrences as (begin, end) in words, and the items they belong to."""
        spans, items, n = [], set(), len(codes)
        for positions, numbers in self.found(codes):
            for p, s in zip(positions.tolist(), numbers.tolist(), strict=True):
                for (offset, length), held in self.windows.get(s, {}).items():
                    begin = p - offset
                    if begin >= 0 and begin + length <= n and (owners := held.get(codes[begin : begin + length].tobytes())) is not None:
                        spans.append((begin, begin + length))
                        items.update(owners)
        return spans, items


def _segments(rows: Iterator, window: int, max_windows: int) -> Iterator[tuple[int, list[bytes]]]:
    """(item, words): items, those of more than `max_windows` windows in pieces that share no window."""
    for r in rows:
        words = words_of(r.text)
        for at in range(0, max(1, len(words) - window + 1) if words else 0, max_windows):
            yield r.id, words[at : at + max_windows + window - 1]


def _parts(rows: Iterator, window: int, max_windows: int, max_chars: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Segments by parts that keep both bounds, but for a single segment."""
    part, windows, chars = [], 0, 0
    for item, words in _segments(rows, window, max_windows):
        n, c = max(1, len(words) - window + 1), sum(map(len, words))
        if part and (windows + n > max_windows or chars + c > max_chars):
            yield part
            part, windows, chars = [], 0, 0
        part.append((item, words))
        windows, chars = windows + n, chars + c
    if part:
        yield part


def _windows(items: list[tuple[int, list[bytes]]], window: int) -> dict[tuple[bytes, ...], set[int]]:
    out: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
    for item, words in items:
        for i in range(max(1, len(words) - window + 1) if words else 0):
            out[tuple(words[i : i + window])].add(item)
    return out


def _index(items: list[tuple[int, list[bytes]]], window: int) -> tuple[Index, dict]:
    """An index of all shingles of the windows, to be counted; see `_prefixed`."""
    windows = _windows(items, window)
    vocabulary = {w: i for i, w in enumerate(sorted({w for key in windows for w in key}))}
    base = len(vocabulary) + 1
    if base**SHINGLE >= 1 << 63:
        raise ValueError("too many words in a part of the benchmark: lower max_windows")
    coded = {tuple(vocabulary[w] for w in key): tuple(sorted(owners)) for key, owners in windows.items()}
    shingles: dict[int, np.ndarray] = {}
    numbers: dict[int, np.ndarray] = {}
    at = 0
    for width in range(1, SHINGLE + 1):
        keys = [_keys(np.array(c, dtype=np.int64), width, base) for c in coded if min(SHINGLE, len(c)) == width]
        if keys:
            shingles[width] = np.unique(np.concatenate(keys))
            numbers[width] = np.arange(at, at + len(shingles[width]))
            at += len(shingles[width])
    return Index(vocabulary, base, shingles, numbers, {}), coded


def _prefixed(index: Index, coded: dict, frequency: dict[int, int]) -> Index:
    """Keeps of each window its rarest shingle, ties to the first, and drops the other shingles."""
    windows: dict[int, dict] = {}
    for c, owners in coded.items():
        words = np.array(c, dtype=np.int64)
        width = min(SHINGLE, len(c))
        own = index.numbers[width][np.searchsorted(index.shingles[width], _keys(words, width, index.base))]
        offset = min(range(len(own)), key=lambda i: (frequency.get(int(own[i]), 0), i))
        if frequency.get(int(own[offset]), 0):  # else no document holds it
            windows.setdefault(int(own[offset]), {}).setdefault((offset, len(c)), {})[words.tobytes()] = owners
    wanted = {w: np.isin(n, list(windows)) for w, n in index.numbers.items()}
    shingles = {w: index.shingles[w][m] for w, m in wanted.items() if m.any()}
    return Index(index.vocabulary, index.base, shingles, {w: index.numbers[w][m] for w, m in wanted.items() if m.any()}, windows)


def _counts(shared):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(*shared.value).ready()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            for text in batch.text:
                codes = index.codes(words_of(text))
                for _, numbers in index.found(codes):
                    for s in np.unique(numbers).tolist():
                        seen[s] += 1
        if seen:
            yield pd.DataFrame({"shingle": list(seen.keys()), "docs": list(seen.values())})

    return count


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


FOUND = "n_words long, spans array<struct<begin:int,end:int>>, item_ids array<long>"


def _search(shared):
    @F.pandas_udf(FOUND)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(*shared.value).ready()
        for batch in texts:
            out = []
            for text in batch:
                codes = index.codes(words_of(text))
                spans, items = index.spans(codes)
                out.append((len(codes), [{"begin": a, "end": b} for a, b in _merged(spans)], sorted(items)))
            yield pd.DataFrame(out, columns=["n_words", "spans", "item_ids"])

    return search


HITS = "digest string, spans array<struct<begin:int,end:int>>, item_ids array<long>"


def _hits(shared):
    """What a pass finds, for texts in which it finds something."""

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(*shared.value).ready()
        for batch in batches:
            out = []
            for digest, text in zip(batch.digest, batch.text, strict=True):
                spans, items = index.spans(index.codes(words_of(text)))
                if spans:
                    out.append((digest, [{"begin": a, "end": b} for a, b in _merged(spans)], sorted(items)))
            yield pd.DataFrame(out, columns=["digest", "spans", "item_ids"])

    return hits


def _join_passes(last: pd.DataFrame, spans: pd.Series, item_ids: pd.Series) -> pd.DataFrame:
    out = []
    for n, *own, more_spans, more_ids in zip(last.n_words, last.spans, last.item_ids, spans, item_ids, strict=True):
        found = [(s["begin"], s["end"]) for part in (own[0], more_spans) if part is not None for s in part]
        ids = {int(i) for part in (own[1], more_ids) if part is not None for i in part}
        out.append((n, [{"begin": a, "end": b} for a, b in _merged(found)], sorted(ids)))
    return pd.DataFrame(out, columns=["n_words", "spans", "item_ids"])


def _flat(hits: DataFrame) -> DataFrame:
    """One row for each text: equal texts and several passes come together."""
    return hits.groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("_spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("_ids"))


def item_digest(item_ids: pd.Series) -> pd.Series:
    return item_ids.map(lambda ids: hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest())


def find_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", *, item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_windows: int = 200_000, max_chars: int = 50_000_000, result: str = "_found") -> DataFrame:
    """`docs` with a struct column `result`: n_words, spans (merged, in words), item_ids.

    Every row of `docs` is kept as it is, with all its columns, repeated rows and nulls too; a
    null text has no words; a column that has the name `result` is replaced. Items with null
    ids or without words never occur. Items that repeat an id count as one. An empty benchmark
    or an empty table finds nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).where("id is not null and text is not null")
    texts = docs.select(F.col(text_col).alias("text"))
    digest = F.sha1(F.encode(F.col(text_col), "UTF-8"))
    found, last = [], Index({}, 1, {}, {}, {}).parts()
    for part in _parts(items.toLocalIterator(), window, max_windows, max_chars):
        if last[0]:  # the part before was not the last
            shared = spark.sparkContext.broadcast(last)
            found.append(staged(docs.select(digest.alias("digest"), F.col(text_col).alias("text")).mapInPandas(_hits(shared), HITS), "hits"))
            shared.destroy()
        index, coded = _index(part, window)
        shared = spark.sparkContext.broadcast(index.parts())
        seen = texts.mapInPandas(_counts(shared), "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs"))
        frequency = {r.shingle: r.docs for r in seen.toLocalIterator()}  # at most the part's shingles
        shared.destroy()
        last = _prefixed(index, coded, frequency).parts()
    search = _search(spark.sparkContext.broadcast(last))(F.col(text_col))
    if not found:
        return docs.withColumn(result, search)
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    # named so that no column of docs is touched
    own = [c for c in docs.columns if c != result]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), digest.alias("digest"), search.alias("last"))
    rows = rows.join(staged(_flat(hits), "hits"), "digest", "left")
    return rows.select("row.*", F.pandas_udf(_join_passes, FOUND)("last", "_spans", "_ids").alias(result))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans and item_ids."""
    digest = F.pandas_udf(item_digest, "string")
    found = find_items(docs.select("doc_id", "text"), benchmark, **options)
    hit = F.aggregate("_found.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_found.item_ids").cast("long").alias("n_items"),
        digest("_found.item_ids").alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.col("_found.spans").alias("spans"),
        F.col("_found.item_ids").alias("item_ids"),
    )
