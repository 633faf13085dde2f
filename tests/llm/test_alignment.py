"""Cross-tokenizer alignment against its definition, pair by pair."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import alignment
from quillstone.llm.packing import tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_level_bytes(A)


def tokens(tokenizers, text):
    """(id, first byte, byte after the last) of both tokenizers, from the libraries alone."""
    a, b, a_bytes = tokenizers
    if not text:
        return [], []
    out = []
    pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
    sides = [(i, a_bytes[i]) for i in a.encode(f" {text}", add_special_tokens=False).ids], [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i, p in pieces]
    for side in sides:
        at, spans = 0, []
        for i, raw in side:
            spans.append((i, at, at + len(raw)))
            at += len(raw)
        if b"".join(raw for _, raw in side) != f" {text}".encode():
            return [], []
        out.append(spans)
    return tuple(out)


def expected(tokenizers, texts):
    rows, count = [], Counter()
    for text in texts:
        a, b = tokens(tokenizers, text)
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        count.update(links)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        parts, low = [], 0
        for cut in cuts:
            parts.append("|".join(",".join(str(i) for i, _, e in side if low < e <= cut) for side in (a, b)))
            low = cut
        rows.append((len(a), len(b), len(cuts), links, ";".join(parts)))
    top = Counter()
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return [(n_a, n_b, n_g, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for n_a, n_b, n_g, links, g in rows]


def texts():
    r = random.Random(3)
    signs = ["the", "thing", "ouéaieux", "été", " ", "  ", "\n", "\t", "日本", "🙂", "é", "<|endoftext|>", "<s>", "<0x41>", "12345", "...", "▁", " ", "\x00", "ß"]
    out = ["".join(r.choice(signs) + r.choice(["", " "]) for _ in range(r.randint(1, 25))) for _ in range(120)]
    return [*out, None, "", " ", "  ", "\n", "a", "a", "plain words of an ordinary text", " edge ", "x" * 400, " ".join(["thing ouéaieux"] * 60), " " * 300 + "x"]


def result(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


@pytest.mark.parametrize("common", [1 << 20, 40, 0])
def test_numbers(spark, tokenizers, common):
    """With all pairs common, some, or none of them: the numbers stay the same."""
    all_texts = texts()
    df = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").repartition(3)
    df = df.select("*", F.lit(1).alias("row_id"), F.lit(2).alias("n_a"), F.lit("x").alias("links"))
    got = alignment.align(df, common_pairs=common).orderBy("doc_id").collect()
    assert result(got) == expected(tokenizers, all_texts)
    assert any(r.n_groups == 0 for r in got) and any(0 < r.n_best < r.n_links for r in got)


def test_supplied_documents(spark, small, tokenizers):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()), key=lambda r: len(r[1]))[:60]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert result(sorted(got, key=lambda r: [i for i, _ in rows].index(r.doc_id))) == expected(tokenizers, [t for _, t in rows])


def test_repeated_null_and_no_ids(spark, tokenizers):
    df = spark.createDataFrame([(1, "one text"), (1, "one text"), (None, "another"), (None, None)], "doc_id long, text string")
    got = alignment.align(df).collect()
    want = expected(tokenizers, ["one text", "one text", "another", None])
    assert sorted(result(got)) == sorted(want) and sorted(str(r.doc_id) for r in got) == ["1", "1", "None", "None"]
    assert alignment.align(df.limit(0)).collect() == []


def test_group_texts(spark, tokenizers):
    rows = alignment.groups(spark.createDataFrame([(1, "some words été"), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert hashlib.sha256(rows[0].groups.encode()).hexdigest() == rows[0].groups_sha256 and rows[1].groups == rows[1].groups_sha256 == ""


def test_windows_do_not_matter(monkeypatch):
    r = np.random.default_rng(5)
    a_len, b_len = np.arange(1, 6), np.arange(1, 4)
    a = r.integers(0, 5, 3000)
    total = int(a_len[a].sum())
    b = []
    while (left := total - sum(b_len[b])) > 0:
        b.append(int(min(left, r.integers(1, 4))) - 1)
    b = np.array(b)
    whole = alignment.aligned(a, b, a_len, b_len)
    monkeypatch.setattr(alignment, "WINDOW", 7)
    for x, y in zip(whole, alignment.aligned(a, b, a_len, b_len), strict=True):
        assert np.array_equal(x, y)
    assert whole[0].tolist() == sorted({*np.cumsum(a_len[a]).tolist(), *np.cumsum(b_len[b]).tolist()})


def test_a_very_long_text(spark):
    text = "the thing ouéaieux " * 100_000 + " " * 5_000 + "end"
    (row,) = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.n_a > 500_000 and row.n_links >= max(row.n_a, row.n_b)
