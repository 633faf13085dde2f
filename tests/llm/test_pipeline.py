"""The pipeline against the brute-force versions of its stages, each on what the stage before kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import packing

from .test_operators import cleaned, contamination, groups, prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def expected(rows, items):
    """Ids and texts that should be packed."""
    rows = [(i, t, s) for i, t, _, s, _ in rows if "grumlot" not in (t or "").replace("-", "")]  # the one word that labels mark
    rows = [(i, text, s) for (i, _, _, text), (_, _, s) in zip(cleaned(rows, 6), rows, strict=True)]
    kept = {i for i, _, _, k in groups([(i, t) for i, t, _ in rows], percent=80) if k}
    rows = [(i, t) for i, t, _ in rows if i in kept]
    return {i: t for (i, t), c in zip(rows, contamination([t for _, t in rows], items), strict=True) if not c[4]}


def tables(spark, path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_run(spark, tmp_path):
    items = [(i, prose(9_000 + i, 25)) for i in range(3)]
    docs, marks = [], []
    for i in range(90):
        bad = i % 4 == 0
        text = f"{prose(i, 30)} {'grumlot' if bad else 'plain'} {prose(i + 1_000, 20)}"
        text += "\nread more on our site" if i % 3 == 0 else ""
        docs.append((i, text, "en", f"s{i % 9}", len(text)))
        marks.append((i, 1, int(bad)))
    docs += [(200, docs[1][1], "en", "s1", 1), (201, docs[1][1] + " one", "en", "s2", 1), (202, f"x {items[1][1]} y", "en", "s3", 1), (203, None, "en", "s4", 0), (204, "", "en", None, 0), (205, f"{prose(7, 9)} gr-umlot {prose(8, 9)}", "en", "s5", 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    tables(spark, str(tmp_path), docs, labels, items)
    want = expected(docs, items)
    assert 203 in want and 204 in want and 1 in want and not {0, 200, 201, 202, 205} & set(want)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(want)
    encoder = packing.Encoder(packing.tokenizer_path())
    for i, text in want.items():
        n = len(np.frombuffer(encoder.encode(text or ""), "<u4")) + 1
        assert sum(r.length for r in pieces if r.doc_id == i) == n


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(20), small)
        assert out.columns == docs.columns, name
        assert dict(out.dtypes) == dict(docs.dtypes), name


def test_empty_documents(spark, tmp_path):
    tables(spark, str(tmp_path), [], spark.createDataFrame([], "doc_id long, quality int, toxic int"), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_from_four_fifths(spark):
    """Pairs with a similarity from 0.8 to below 0.85 are near-duplicates for the stage; a pair below 0.8 is not."""
    rows = []
    for i, last in enumerate([9, 10, 11, 12]):  # of 100 shingles; similarities 0.83, 0.82, 0.80 and 0.79
        words = prose(i, 104).split()
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join([*words[:-last], *(f"n{k}" for k in range(last))]))]
    kept = {i for i, _, _, k in groups(rows, percent=80) if k}
    assert kept == {0, 10, 20, 30, 31} and all(k for *_, k in groups(rows))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()} == kept


def test_boilerplate_longer_than_the_text_is_cut(spark):
    """A shared passage is cut from pages that are shorter than it; pages that are nothing else stay whole."""
    passage = prose(5, 60)
    rows = [(i, f"{prose(100 + i, 5)}\n{passage}\n", f"s{i}") for i in range(6)] + [(10 + i, f"{passage}\n\n", f"t{i}") for i in range(2)]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_boilerplate(spark, df, "").collect()}
    want = {i: t.replace(f"{passage}\n", "") if i < 10 else t for i, t, _ in rows}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_odd_names_null_ids_and_long_texts(spark, small):
    """Columns whose names hold dots or clash with the operators' own, rows without an id, and a very long text pass every stage but the last."""
    rows = [(1, f"{prose(1, 40)}", "a", 1), (2, f"{prose(1, 40)} more", "b", 2), (None, prose(1, 40), "c", 3), (None, None, None, 4), (3, prose(3, 60_000), "d", 5), (3, prose(3, 60_000), "d", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int")
    for name in ("gone", "kept", "score", "removed", "found", "lines", "id"):
        df = df.withColumn(name, F.lit(f"x-{name}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, small)
        assert out.columns == df.columns, name
        want = [1, 3, 4, 5, 5] if name == "near_duplicates" else [1, 2, 3, 4, 5, 5]
        assert sorted(r["a.b"] for r in out.collect()) == want, name
    assert corpus_pipeline.pack_sequences(spark, df, small).count() > 6

