"""Language identification: held-out accuracy, choices against plain compression, odd rows."""

import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from quillstone.llm import langid

DOCS = "doc_id long, text string, lang string"
SOUNDS = {"aa": ["tion", "the", "and", "ing", "er"], "bb": ["aux", "eau", "que", "ier", "le"], "cc": ["ung", "keit", "sch", "ver", "die"]}


def text(lang, seed, n=40):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(n=300):
    return [(i, text(lang, i, 5 + i % 60), lang) for i in range(n) for lang in [list(SOUNDS)[i % 7 % 3]]]


def test_held_out_documents(spark):
    rows = corpus()
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x"))).collect()}
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(i, lang) for i, _, lang in rows if got[i].held_out]
    assert held and all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 and not got[i].rejected for i, lang in held)


def test_sizes_are_those_of_plain_compression():
    model = langid.Model(["aa", "bb"], [text("aa", 1, 500).encode(), text("bb", 2, 500).encode()])
    long = text("bb", 3, 3000)
    for t in (text("aa", 5), long, "x"):
        raw = t.encode()
        want = []
        for own in model.dictionaries:
            coder = zstandard.ZstdCompressor(level=9, dict_data=(d := zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)), write_content_size=False, write_dict_id=False)
            d.precompute_compress(level=9)
            want.append(sum(len(coder.compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096)))
        assert langid.Sizes(model, 9, 4096).of(t).tolist() == want


def test_the_whole_text_counts(spark):
    """A short opening in one language does not outweigh what follows in another."""
    rows = [*corpus(), (9001, text("aa", 1, 30) + " " + text("cc", 2, 4000), None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[9001].lang_pred == "cc"


def test_narrow_margins_are_rejected(spark):
    rows = [*corpus(), (9001, text("aa", 7, 60) + " " + text("bb", 8, 60), None), (9002, "z", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOCS), min_margin=0.2).collect()}
    assert got[9001].rejected and got[9001].lang_pred in SOUNDS and got[9002].rejected
    assert got[9002].lang_pred == "aa"  # equal sizes: more rows were learned


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = corpus()
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    clean, spoilt = (sorted(map(tuple, langid.identify(spark.createDataFrame(x, DOCS)).collect())) for x in (rows, wrong))
    assert clean == spoilt


@pytest.mark.parametrize("rows", [[], [(1, "one text", None)], [(2, "held out", "en")]])
def test_nothing_to_learn(spark, rows):
    got = langid.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(rows)


def test_nulls_and_texts_without_letters(spark):
    odd = [(1000, None, None), (1001, "", "aa"), (1002, "12 ... !", "bb"), (None, text("bb", 3), "bb"), (None, text("bb", 3), "bb"), (1003, text("cc", 4, 60_000), None), (1004, "É", None)]
    got = langid.identify(spark.createDataFrame([*corpus(), *odd], DOCS)).collect()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "cc" and by[1004].lang_pred in SOUNDS
    assert [(r.lang_pred, r.held_out) for r in got if r.doc_id is None] == [("bb", False)] * 2


def test_one_language(spark):
    got = langid.identify(spark.createDataFrame([(i, f"only one {i}", "en") for i in range(12)], DOCS)).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in got} == {("en", 1.0, False)}


def test_supplied_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
