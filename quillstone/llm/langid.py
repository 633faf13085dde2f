"""Language identification by compression.

Each language has a raw-content zstandard dictionary: excerpts of its sampled texts. A text is
cut into chunks, each is compressed with every dictionary, and the language whose chunks come to
the fewest bytes is chosen: what its dictionary holds need not be spelled out. A choice whose
margin over the next language is narrow is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import remainder

#: What a text gets that has no letter, or when no language was learned.
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]  # those with more learned rows first, so that a tie goes to them
    dictionaries: list[bytes]  # of each language


def is_held_out(id_col: str = "doc_id"):
    """True where a row's language must not be learned; a row without an id is neither learned nor held out."""
    return F.coalesce(remainder(id_col, 3) == 1, F.lit(False))


def fit(docs: DataFrame, *, max_rows: int = 8192, excerpt: int = 64, max_languages: int = 1000) -> Model:
    """Dictionaries from at most about `max_rows` rows of each language, `excerpt` characters of each.

    Rows are taken by a hash of their ids, and a row's excerpt starts at a place that the hash
    says, so that all parts of texts are seen. A language without a learned row is unknown; more
    than `max_languages` are an error, as each has a dictionary of its own on every task.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~is_held_out("id"))
    rows = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(rows) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    if not rows:
        return Model([], [])
    languages = sorted(rows, key=lambda x: (-rows[x], x))
    place = F.pmod(F.xxhash64("id", F.lit(20240102)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1 << 30, max_rows * (1 << 30) // rows[lang]))])
    start = F.pmod(F.xxhash64("id", F.lit(20240103)), F.greatest(F.length("text") - excerpt, F.lit(0)) + 1)
    chosen = known.where(place < share[F.col("lang")]).select("id", "lang", F.col("text").substr((start + 1).cast("int"), F.lit(excerpt)).alias("text"))
    taken: dict[str, list[str]] = {lang: [] for lang in languages}
    for r in sorted(chosen.collect(), key=lambda r: (r.id, r.text)):  # about max_rows * excerpt characters a language
        taken[r.lang].append(r.text)
    return Model(languages, ["\n".join(texts).encode() for texts in taken.values()])


class Sizes:
    """Bytes that a text comes to with each language's dictionary."""

    def __init__(self, model: Model, level: int, chunk: int):
        self.chunk = chunk
        self.coders = []
        for raw in model.dictionaries:
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if raw else None
            if known:
                known.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def of(self, text: str) -> np.ndarray:
        raw = text.encode()
        chunks = [raw[i : i + self.chunk] for i in range(0, len(raw), self.chunk)]
        return np.array([sum(len(compress(c)) for c in chunks) for compress in self.coders])


def _predict(shared, level: int, chunk: int, min_margin: float):
    @F.pandas_udf("lang string, score double, margin double, rejected boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        sizes = Sizes(model, level, chunk)
        for batch in texts:
            out = []
            for text in batch:
                if not model.languages or not text or not any(map(str.isalpha, text)):
                    out.append((UNDETERMINED, 0.0, 0.0, True))
                    continue
                n = sizes.of(text)
                best = int(n.argmin())
                rest = np.delete(n, best)
                margin = float((rest.min() - n[best]) / rest.min()) if len(rest) else 1.0
                score = 1 / (1 + np.exp2(np.maximum(n[best] - rest, -60)).sum())
                out.append((model.languages[best], float(score), margin, margin < min_margin))
            yield pd.DataFrame(out, columns=["lang", "score", "margin", "rejected"])

    return predict


def predicted(docs: DataFrame, model: Model, text_col: str = "text", result: str = "_language", *, level: int = 9, chunk: int = 4096, min_margin: float = 0.005) -> DataFrame:
    """`docs` with a struct of lang, score, margin and rejected for each whole text.

    `margin` is the share of bytes that the chosen language saves against the next; below
    `min_margin` the choice is rejected, and the next one up may well be right. `score` is the
    chosen language's share when every byte more halves a language's weight. Null texts and
    texts without a letter are undetermined and rejected, with a score of 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(result, _predict(shared, level, chunk, min_margin)(F.col(text_col)))


def identify(docs: DataFrame, *, level: int = 9, chunk: int = 4096, min_margin: float = 0.005, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected for every row; repeated rows stay repeated.

    lang_pred is the smallest language even where it is rejected; of equal sizes, the language
    with more learned rows. Language, source and id are not inputs of a prediction, and other
    columns are not read. With no language to learn from, every text is `und`.
    """
    model = fit(docs, **options)
    own = predicted(docs.select("doc_id", "text"), model, level=level, chunk=chunk, min_margin=min_margin)
    return own.select("doc_id", is_held_out().alias("held_out"), F.col("_language.lang").alias("lang_pred"), "_language.score", "_language.margin", "_language.rejected")
