"""Source divergence audit: how far the sources of a language are from each other, term by term.

Every group (a language's source) and every language gives each kept term a smoothed share, in
whole billionths. Two groups differ in a term by f = floor((p - q)^2 / (p + q)); their distance
is the sum over all kept terms. It is added up in two parts, both in whole numbers:

If no group used any term, each kept term would add f of the two groups' shares for a count of
zero. What changes against that:

* Heavy terms, which many groups use, lie in dense tiles: shares of a block of groups by a block
  of terms, compared in numpy with those of another block of groups.
* Light terms have short postings. What one group's postings change is told by how many of them
  have which share; what changes where both groups have a posting comes from the pairs inside a
  term's postings, of which there are at most `heavy` * (`heavy` - 1) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged

SCALE = 1_000_000_000
_OTHER = bytes(c for c in range(128) if not chr(c).isalpha())
#: Signs outside terms become spaces, A-Z small letters; bytes of signs beyond ASCII stay.
_FOLD = bytes.maketrans(_OTHER + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_OTHER) + b"abcdefghijklmnopqrstuvwxyz")

COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and of signs beyond ASCII in UTF-8, with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _folded(texts: pa.Array) -> pa.Array:
    """Texts with signs outside terms as spaces and A-Z as small letters: all of them at once, as no length changes."""
    texts = pa.concat_arrays([texts, pa.array([], pa.binary())])  # from the start of its buffers
    _, ends, data = texts.buffers()
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, ends, pa.py_buffer((data or pa.py_buffer(b"")).to_pybytes().translate(_FOLD))])


def _counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """`_counted` of some texts."""
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    width = max(len(sources.dictionary), 1)
    own = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
    groups, group = np.unique(own, return_inverse=True)
    lists = pc.split_pattern(_folded(text), " ")
    words, doc = lists.flatten(), pc.list_parent_indices(lists)
    said = pc.greater(pc.binary_length(words), 0)
    known = words.filter(said).dictionary_encode()
    size = max(len(known.dictionary), 1)
    doc, code = doc.filter(said).to_numpy().astype(np.int64), known.indices.to_numpy()
    # a number for each group and term: once for each occurrence, then once for each text (with counts, `unique` sorts, which is faster)
    key, n = np.unique(group[doc] * size + code, return_counts=True)
    once, _ = np.unique(doc * size + code, return_counts=True)
    docs = np.unique(group[once // size] * size + once % size, return_counts=True)[1]
    of = groups[np.concatenate([key // size, np.arange(len(groups))])]
    none = np.zeros(len(groups), dtype=np.int64)
    columns = [langs.dictionary.take(pa.array(of // width)), sources.dictionary.take(pa.array(of % width))]
    columns += [pa.concat_arrays([known.dictionary.take(pa.array(key % size)), pa.nulls(len(groups), pa.binary())])]
    columns = [x.cast(pa.string()) for x in columns] + [pa.array(np.concatenate([x, none])) for x in (n, docs)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch], held: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Occurrences of a term in a group, and texts of it that hold the term; a row without a term for each group.

    Texts are counted together up to `held` bytes, a longer one alone.
    """
    waiting: list[list[pa.Array]] = []
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        whole = _counts(*(pa.concat_arrays(x) for x in zip(*waiting, strict=True)))
        waiting.clear()
        for low in range(0, whole.num_rows, 20_000):
            yield whole.slice(low, 20_000)

    for batch in batches:
        columns = [batch.column(i).cast(pa.binary()) for i in range(3)]
        low = 0
        for i, n in enumerate(pc.binary_length(columns[2]).to_pylist()):
            if size and size + n > held:
                if i > low:
                    waiting.append([c.slice(low, i - low) for c in columns])
                yield from rows()
                low, size = i, 0
            size += n
        waiting.append([c.slice(low) for c in columns])
    if waiting:
        yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs); term is null in the row that each group has besides."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return own.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str | Column, room: str) -> Column:
    """1 + floor(10^9 (n + 2) / room), exactly; a `room` of 0 has no terms to share in."""
    n = F.col(n) if isinstance(n, str) else n
    top = (n + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return (F.lit(1) + F.call_function("div", top, F.nullif(F.col(room), F.lit(0)).cast("decimal(19,0)"))).cast("long")


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """`difference` of whole numbers up to 10^9 + 1: the square is below 2^63."""
    d = p - q
    return d * d // (p + q)


PAIRS = "lang string, g int, h int, value long"


def _tile(block: int, width: int):
    """What one block of heavy terms changes between the groups of two blocks; the first block adds the rest but light pairs."""

    def tile(key, shares: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        lang, a, b, part = key
        groups = groups.sort_values("g")
        number, zero = groups["g"].to_numpy(), groups["zero"].to_numpy(dtype=np.int64)
        rows = {g: i for i, g in enumerate(number.tolist())}
        names, term = np.unique(shares["term"].to_numpy(dtype=object), return_inverse=True) if len(shares) else ([], np.zeros(0, dtype=np.int64))
        row = np.array([rows[g] for g in shares["g"].tolist()], dtype=np.int64)
        left, right = np.flatnonzero(number // block == a), np.flatnonzero(number // block == b)
        value = np.zeros((len(left), len(right)), dtype=np.int64)
        for low in range(0, len(names), width):
            size = min(width, len(names) - low)
            dense = np.repeat(zero[:, None], size, axis=1)
            here = (term >= low) & (term < low + size)
            dense[row[here], term[here] - low] = shares["p"].to_numpy(dtype=np.int64)[here]
            for i, g in enumerate(left):
                value[i] += _f(dense[g], dense[right]).sum(axis=1) - size * _f(zero[g], zero[right])
        if part == 0:
            for i, g in enumerate(left):
                value[i] += groups["terms"].iloc[g] * _f(zero[g], zero[right])
                value[i] += _alone(groups["shares"].iloc[g], groups["times"].iloc[g], zero[g], zero[right])
            for j, h in enumerate(right):
                value[:, j] += _alone(groups["shares"].iloc[h], groups["times"].iloc[h], zero[h], zero[left])
        i, j = np.nonzero(number[left][:, None] < number[right])
        return pd.DataFrame({"lang": lang, "g": number[left][i], "h": number[right][j], "value": value[i, j]}).astype({"g": "int32", "h": "int32"})

    return tile


def _alone(shares, times, zero: int, others: np.ndarray) -> np.ndarray:
    """What a group's light postings change against groups that have none."""
    if shares is None or not len(shares):
        return np.zeros(len(others), dtype=np.int64)
    p, n = np.asarray(shares, dtype=np.int64), np.asarray(times, dtype=np.int64)
    return np.array([(n * _f(p, q)).sum() for q in others], dtype=np.int64) - n.sum() * _f(zero, others)


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What changes where two groups both have a posting of a light term, added up in a batch."""
    for batch in batches:
        sizes = batch.postings.map(len).to_numpy()
        flat = [x for row in batch.postings for x in row]
        if not flat:
            continue
        langs, lang = np.unique(batch.lang.to_numpy(dtype=object), return_inverse=True)
        g, p, zero = (np.array([x[c] for x in flat], dtype=np.int64) for c in ("g", "p", "zero"))
        owner, lang = np.repeat(np.arange(len(batch)), sizes), np.repeat(lang, sizes)
        found = []
        for step in range(1, int(sizes.max())):
            x = np.flatnonzero(owner[:-step] == owner[step:])
            y = x + step
            value = _f(p[x], p[y]) - _f(p[x], zero[y]) - _f(zero[x], p[y]) + _f(zero[x], zero[y])
            found.append(pd.DataFrame({"lang": lang[x], "g": np.minimum(g[x], g[y]), "h": np.maximum(g[x], g[y]), "value": value}))
        if found:
            out = pd.concat(found).groupby(["lang", "g", "h"], as_index=False)["value"].sum()
            yield out.assign(lang=langs[out["lang"]]).astype({"g": "int32", "h": "int32"})


def audit(docs: DataFrame, *, min_docs: int = 10, top: int = 10, heavy: int = 8, block: int = 256, width: int = 256) -> DataFrame:
    """lang, source, part, item, value, rank: what sets each group apart.

    Part `pair` holds every other source of the language by its distance, part `term` the `top`
    terms that the group uses more than its language. A language keeps the terms of at least
    `min_docs` of its documents; terms of more than `heavy` groups go to tiles of `block` groups
    and `width` terms. Null texts, languages and sources read as ''; a group without terms keeps
    its rows; repeated rows count as often as they occur; equal values are in the order of their
    items in UTF-8. Ids and other columns are not read. An empty table gives no rows.
    """
    counts = staged(term_counts(docs), "term-counts")
    known = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("all_n"), F.count("*").alias("spread")).where(F.col("d") >= min_docs)
    postings = staged(counts.where("term IS NOT NULL").join(known, ["lang", "term"]).select("lang", "source", "term", "n", "all_n", "spread"), "postings")

    # a kept term is told once, by the first of its sources; sizes are those of languages and groups
    kept = postings.groupBy("lang", "term").agg(F.first("all_n").alias("all_n"), F.first("spread").alias("spread"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"), F.count_if(F.col("spread") > heavy).alias("dense"))
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = counts.where("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select(
        "lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("g"),
        (F.coalesce("own_n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("room"), (F.coalesce("lang_n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("lang_room"),
        F.coalesce("v", F.lit(0)).alias("terms"), F.coalesce("dense", F.lit(0)).alias("dense"),
    )
    groups = groups.withColumn("zero", F.coalesce(share(F.lit(0), "room"), F.lit(1)))  # without terms no share is asked for
    groups = groups.withColumn("blocks", F.floor(F.max("g").over(Window.partitionBy("lang")) / block).cast("int") + 1)
    groups = groups.withColumn("parts", F.ceil(F.col("dense") / width).cast("int"))
    groups = staged(groups, "groups")
    shares = staged(postings.join(groups.select("lang", "source", "g", "room", "lang_room", "zero", "blocks", "parts"), ["lang", "source"]).withColumn("p", share("n", "room")), "shares")

    pairs = _distances(shares, groups, heavy, block, width)
    item = groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    pairs = pairs.join(groups.select("lang", "source", "g"), ["lang", "g"]).join(item, ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    said = shares.withColumn("q", share("all_n", "lang_room")).where("p > q")
    said = said.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, said)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


def _distances(shares: DataFrame, groups: DataFrame, heavy: int, block: int, width: int) -> DataFrame:
    """(lang, g, h, value) for any two groups of a language, both ways round."""
    light = shares.where(F.col("spread") <= heavy)
    told = light.groupBy("lang", "g", "p").agg(F.count("*").alias("times")).groupBy("lang", "g").agg(F.collect_list(F.struct("p", "times")).alias("told"))

    def tiles(df: DataFrame, part: Column) -> DataFrame:
        """A row for each tile of its block of groups: with itself and with every other block."""
        own = F.floor(F.col("g") / block).cast("int")
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return df.withColumn("part", part).withColumn("a", F.least(own, "other")).withColumn("b", F.greatest(own, "other"))

    dense = tiles(shares.where(F.col("spread") > heavy).select("lang", "term", "g", "p", "blocks", "parts"), F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
    sides = groups.join(told, ["lang", "g"], "left").select("lang", "g", "zero", "terms", "blocks", "parts", F.col("told.p").alias("shares"), F.col("told.times").alias("times"))
    sides = tiles(sides, F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0)))))
    key = ["lang", "a", "b", "part"]
    heavy_sums = dense.groupBy(*key).cogroup(sides.groupBy(*key)).applyInPandas(_tile(block, width), PAIRS)
    postings = light.where("spread > 1").groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "zero")).alias("postings"))
    sums = heavy_sums.union(postings.select("lang", "postings").mapInPandas(_together, PAIRS)).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    sums = staged(sums, "distances")
    return sums.union(sums.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
