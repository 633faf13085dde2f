"""The operators against brute force, on small fixtures with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, licences, lines, minhash, packing, quality, toolcalls, topk, toxicity, training, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, sources=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", (sources or {}).get(k, f"s{k % 7}"), len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


# 1 and 9


def labelled(spark, bad, n=240):
    r = random.Random(5)
    texts, labels = [], []
    for i in range(n):
        words = prose(i, 30).split()
        y = i % 3 == 0
        if y:
            words.insert(r.randint(0, 29), bad(i))
        texts.append(" ".join(words))
        labels.append((i, int(y), int(y)))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_obfuscated_words(spark):
    plain, labels = labelled(spark, lambda i: ("zorgon", "vilzit")[i % 2])
    forms = ["z0rg0n", "z o r g o n", "zorrrgon", "z.o.r.g.o.n", "v1lz1t", "vi|zit", "VILZIT!!", "v-i-l-z-i-t"]
    extra = docs(spark, [f"{prose(900 + i, 12)} {f} {prose(950 + i, 12)}" for i, f in enumerate(forms)] + [prose(1000, 30), None, "", "..."], [1000 + i for i in range(len(forms) + 4)])
    rows = {r.doc_id: r for r in toxicity.classify(plain.union(extra).withColumn("score", F.lit("own")), labels).collect()}
    assert [rows[1000 + i].predicted for i in range(len(forms))] == [1] * len(forms)
    assert [rows[1000 + len(forms) + i].predicted for i in range(4)] == [0] * 4
    held = [r for r in rows.values() if r.doc_id < 240 and r.held_out]
    assert held and all(r.predicted == (r.doc_id % 3 == 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())


def channel(taught):
    """A decoder under the 4-grams of `taught`, said often."""
    (tally,) = toxicity._tally(iter([pd.DataFrame({"text": [f"{taught} " * 300]})]))
    full = np.zeros(toxicity.SYMBOLS**toxicity.ORDER)
    full[tally.gram] = tally.n
    full = full.reshape(-1, toxicity.SYMBOLS) + 0.01
    return toxicity.Channel(np.log(full / full.sum(axis=1, keepdims=True)).ravel())


@pytest.mark.parametrize("token, word", [("57upid", "stupid"), ("$7upid", "stupid"), ("!diot", "idiot"), ("s#it", "shit"), ("idio+", "idiot"), ("4$$hole", "asshole"), ("@$$", "ass"), ("stup!d!", "stupid"), ("id-1ot", "idiot")])
def test_what_the_channel_lists_is_decoded(token, word):
    assert word in toxicity.Restorer(channel("you stupid idiot and shit of an ass or asshole"))[token]


def test_short_runs_of_single_letters_are_decoded():
    known = toxicity.Restorer(channel("you stupid idiot and shit of an ass or asshole"))
    assert "ass" in toxicity.restored_words("you a s s of", known) and "ass" in toxicity.restored_words("you @ s s of", known)
    assert not toxicity.spaced_words(list("---"), [0, 1, 2], known.channel)
    assert not toxicity.suspicious("2024") and not toxicity.suspicious("***") and not toxicity.suspicious("plain")


@pytest.mark.parametrize("token, word", [("s" + "t" * 40 + "upid", "stupid"), ("5" + "t" * 20 + "u" * 20 + "p1d", "stupid"), ("you-are-such-an-1d10t-and-of-an-4$$hole", "idiot"), ("you-are-such-an-1d10t-and-of-an-4$$hole", "asshole"), ("you_" * 3_000 + "1d10t", "idiot"), ("x" + "0123456789" * 500 + "/57upid", "stupid"), ("y0u" * 2_000 + "1d10t", "idiot")])
def test_long_tokens_are_decoded(token, word):
    known = toxicity.Restorer(channel("you stupid idiot and shit of an ass or asshole"))
    assert any(word in w for w in known[token])


def likeliest(channel, observed):
    """The best text over all ways through the lattice, one by one."""
    best = (-np.inf, "")

    def walk(at, before, context, last, score, out):
        nonlocal best
        if at > len(observed):
            best = max(best, (score, out.strip()))
            return
        c = observed[at] if at < len(observed) else ""
        ways = list(channel.options(c, before, False)) if c else [(" ", 0.0)]
        looks = toxicity.LOOKALIKES.get(c, "")
        if looks and last and last in looks and not before.endswith(last):
            ways.append(("", channel.DROP_DOUBLE))
        for letter, cost in ways:
            k = toxicity._class_of(letter) if letter else toxicity._EDGE
            if not letter or k == toxicity._EDGE and context % toxicity.SYMBOLS == toxicity._EDGE:
                walk(at + 1, before[-1:] + c, context, last, score + cost, out)
            else:
                gram = context * toxicity.SYMBOLS + k
                walk(at + 1, before[-1:] + c, gram % toxicity.SYMBOLS**3, letter, score + cost + channel.logp[gram], out + letter)

    walk(0, "", 0, "", 0.0, "")
    return best[1]


@pytest.mark.parametrize("token", ["1d10t", "s t u p", "$7up1d", "iid1oot", "a$$-0f", "fu.c*k", "m0rrr0n", "@ss", "b0 t"])
def test_decoding_is_the_best_of_all_ways(token):
    taught = channel("you stupid idiot and shit of an ass or a moron fuck bot")
    assert taught.decode(token) == likeliest(taught, token)


def pieces(words, usual=""):
    bits = np.zeros(toxicity.SLOTS, dtype=bool)
    bits[[toxicity._slot(w) for w in usual.split()]] = True
    return toxicity.Pieces(words.split(), bits, channel("you worthless pathetic stupid garbage idiot and an ass " * 3 + "the of and"))


@pytest.mark.parametrize("text, words", [("you worthle ss man", "worthless"), ("so pathe tic.", "pathetic"), ("a stu pi d one", "stupid"), ("ga rb age", "garbage"), ("wor th less", "worthless"), ("w orthless", "worthless"), ("1d iot, stu pid!", "idiot stupid"), ("pathe tiiiic", "pathetic"), ("pathe", ""), ("stupid", ""), ("s t u p i d", ""), ("", "")])
def test_known_words_are_found_across_spaces(text, words):
    """Any number of pieces of any length; runs of single letters are decoded elsewhere."""
    known, tokens = pieces("worthless pathetic stupid garbage idiot"), text.split()
    found = known.words(tokens, [i for i, t in enumerate(tokens) if known.begins(t)])
    assert [toxicity.folded(w) for w in found] == [toxicity.folded(w) for w in words.split()]


def test_usual_words_are_not_pieces_by_themselves():
    known = pieces("idiot", usual="id iot")
    assert known.restored(["id", "iot"]) == "" and known.restored(["idi", "ot"]) == "idiot"


def test_pieces_are_all_windows_of_tokens():
    """The walk against every window, and over long runs that begin a word without end."""
    draw = random.Random(5)
    known = pieces("abcab abca bcabcc cabc")
    for _ in range(300):
        tokens = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 3))) for _ in range(12)]
        letters = [toxicity.folded(t) for t in tokens]
        for i in range(12):
            if letters[i] not in known.starts:
                continue
            want, whole = [], letters[i]
            for j in range(i + 1, 12):
                more = letters[j][1:] if letters[j][0] == whole[-1] else letters[j]
                if not more:
                    break
                whole += more
                if whole in known.whole:
                    want.append(j)
            assert list(known.ends(tokens, i)) == want
    long = ["a", "b"] * 50_000 + ["a"] * 100_000
    assert known.words(long, [i for i, t in enumerate(long) if known.begins(t)]) == []


def test_toxicity_scores_are_the_lexicon_s(spark):
    plain, labels = labelled(spark, lambda i: "zorgon")
    logp, lexicon = model = toxicity.fit(plain, labels)
    texts = [prose(5, 40), "z0rg0n z.o.r.g.o.n z o r g o n", "same same same", "", None, "x" * 300 + " " + "é" * 20, "a,b,c," * 100, "zorg on x zo rgo n"]
    across = toxicity.Pieces(lexicon.words(), np.unpackbits(lexicon.usual), toxicity.Channel(logp))
    assert across.words(texts[-1].split(), [0, 3]) == ["zorgon", "zorgon"]
    got = {r.doc_id: r._score for r in toxicity.scored(docs(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        words = toxicity.restored_words(t, toxicity.Restorer(toxicity.Channel(logp)))
        if i == len(texts) - 1:
            words.update(["zorgon", "zorgon"])
        terms = {}
        for w, n in words.items():
            for x in toxicity._beginnings(w):
                if x in lexicon.weights:
                    terms[x] = terms.get(x, 0) + n
        z = lexicon.bias + lexicon.length * np.log1p(sum(words.values())) + sum(lexicon.weights[x] * np.log1p(n) for x, n in terms.items())
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_quality_scores_are_averages_of_vectors(spark):
    plain, labels = labelled(spark, lambda i: "zorgon")
    model = quality.fit(plain, labels, buckets=1 << 12)
    texts = [prose(5, 40), "one one two", "", None, "word" * 5_000, " \n"]
    df = docs(spark, texts).withColumn("n", F.lit(1))
    got = {r.doc_id: (r._score, r.n) for r in quality.scored(df, model).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        ids = [f for w in words for f in quality.features(w, model.buckets, model.shortest, model.longest)]
        ids += quality.features(quality.REPEAT, model.buckets, 99, 98) * sum(a == b for a, b in zip(words, words[1:], strict=False))
        z = model.bias + (np.mean(model.weight[ids]) if ids else 0.0)
        assert got[i][0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6) and got[i][1] == 1


def test_words_cut_by_a_space_are_joined():
    known = toxicity.Restorer(channel("you stupid idiot and shit of an ass or asshole"))
    found = toxicity.restored_words("you stu pid id1 ot and of", known)
    assert found["stupid"] == 1 and found["idiot"] == 1 and found["you"] == 1 and "youstu" not in found and "andof" not in found


def test_channel_model_sums_to_one(spark):
    logp = toxicity.character_model(docs(spark, [prose(1, 400), None, "é ß 12"]))
    assert np.allclose(np.exp(logp.reshape(-1, toxicity.SYMBOLS)).sum(axis=1), 1, atol=1e-4)


def test_held_out_labels_are_not_learned(spark):
    plain, labels = labelled(spark, lambda i: "zorgon")
    flipped = labels.withColumn("toxic", F.when(training.is_held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = sorted((r.doc_id, r.score) for r in toxicity.classify(plain, labels).collect())
    assert a == sorted((r.doc_id, r.score) for r in toxicity.classify(plain, flipped).collect())


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_without_labels_or_rows(spark, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = module.classify(docs(spark, ["a b", None, ""], [1, None, 1]), none).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    assert module.classify(docs(spark, []), none).count() == 0


def test_quality_held_out_accuracy(spark, small):
    d, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.85 * len(rows)


# 2

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def contamination(texts, items):
    windows = {}
    for i, t in items:
        w = fold(t)
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = fold(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= ids
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("max_windows", [200_000, 40])
def test_decontamination(spark, max_windows):
    items = [(i, prose(100 + i, 8 + 3 * i)) for i in range(9)] + [(20, "Kort"), (21, ""), (22, None), (None, "abc abd"), (3, "the SAME words"), (7, prose(107, 29)), (30, "é ÉÀ é")]
    texts = [prose(i, 40) for i in range(6)] + [f"{prose(50, 5)} {items[4][1].upper()}, {items[4][1]}", f"x {items[8][1]}", "kort kort; KORT", None, "", "the--same WORDS", "é ÉÀ é", "é éà é", " ".join(items[5][1].split()[:9]), items[2][1] + "s"]
    ids = [*range(len(texts) - 1), 0]
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.report(docs(spark, texts, ids), b, max_windows=max_windows).drop("spans", "item_ids").collect()
    assert sorted(map(tuple, rows)) == sorted((i, *c) for i, c in zip(ids, contamination(texts, items), strict=True))


def test_decontamination_in_many_parts(spark):
    """Every pass has its own Python stage and one index; a very long item is split, and no window of it is lost."""
    item = [f"w{i}" for i in range(2_000)]
    b = spark.createDataFrame([(1, " ".join(item)), (2, "w5 w6 w7"), (3, prose(1, 30))], "item_id long, text string")
    texts = [" ".join(["x", *item[k : k + 10], "y"]) for k in (0, 395, 400, 799, 1_000, 1_990)] + [" ".join(item[390:415]), " ".join(item[7:16]), prose(1, 30), "w5 w6 w7", None]
    df = docs(spark, texts).withColumnRenamed("lang", "digest").withColumn("row", F.lit(7)).withColumn("_spans", F.lit(8))
    out = decontaminate.find_items(df, b, max_windows=400)
    assert out.columns == [*df.columns, "_found"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2 * 2  # the last pass and the merge, as first and as adaptive plan
    got = {r.doc_id: (r._found.n_words, sum(s.end - s.begin for s in r._found.spans), sorted(r._found.item_ids), r.row, r._spans) for r in out.collect()}
    items = [(1, " ".join(item)), (2, "w5 w6 w7"), (3, prose(1, 30))]
    for i, c in enumerate(contamination(texts, items)):
        assert got[i][:2] == c[:2] and len(got[i][2]) == c[2] and got[i][3:] == (7, 8)


def test_decontamination_with_an_item_of_many_words(spark):
    words = [f"{i:x}" for i in range(2_100_000)]
    item = spark.createDataFrame([(1, " ".join(words))], "id long, text string").first()
    at = 0
    for part in decontaminate._parts(iter([item]), 10, 200_000, 50_000_000):
        ((i, own),) = part
        assert i == 1 and own == [w.encode() for w in words[at : at + len(own)]] and len(set(own)) ** decontaminate.SHINGLE < 1 << 63
        at += len(own) - 9
    assert at + 9 == len(words)
    b = spark.createDataFrame([(1, " ".join(words[:9_000]))], "item_id long, text string")
    df = docs(spark, [" ".join(words[3_990:4_002]), "none of it"])
    assert sorted((r.doc_id, r.n_hit) for r in decontaminate.report(df, b, max_windows=4_000).collect()) == [(0, 12), (1, 0)]


def test_decontamination_of_empty_tables(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.report(docs(spark, ["a b"]), b).collect()] == [False]
    assert decontaminate.report(docs(spark, []), b).count() == 0


# 3


def test_top_k(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)], i % 3) for i in range(120)]
    rows += [(200 + i, rows[7][1], 0) for i in range(30)] + [(300, None, 0), (301, [1.0, None], 0), (302, [float("nan")] * 8, 0), (303, [float("inf")] * 8, 0), (304, [], 0), (305, [0.5, 0.5], 0), (None, [0.1] * 8, 0), (50, rows[7][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    asked = df.where("vec_id % 50 = 0")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df, asked, block=8, group=32, batch=3).collect())
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) and abs(x) < 1e20 for x in v)]
    want = []
    for i in sorted({i for i, _ in ok if i % 50 == 0}):
        pairs = [(-sum(a * b for a, b in zip(q, v, strict=False)), j) for k, q in ok if k == i for j, v in ok if j != i]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(pairs)[:5])]
    assert got == want


def test_top_k_skips_blocks_of_the_whole_table(spark):
    """Of clustered vectors, the floor of the first pass leaves most blocks of all groups unscored."""
    r = random.Random(1)
    rows = []
    for i in range(4_000):
        v = [0.0] * 16
        v[i % 16] = 1 + r.random() / 8
        rows.append((i, v))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 500 = 0")
    n = topk.pruning(df, asked, block=16, group=256).first()
    assert 0 < n.scored < 0.25 * n.blocks
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(df, asked, block=16, group=256).collect()}
    q = {i: np.floor(256 * np.array(v)) for i, v in rows}
    for i in range(0, 4_000, 500):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5]
        assert [got[i, n + 1] for n in range(5)] == [(j, -s) for s, j in best]


def test_top_k_of_huge_vectors(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 2.0]), (3, [1.0, 1.0]), (4, [1e12, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x.vec_id, x.score) for x in topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    high, low = (1 << 63) - 1, -(1 << 63)
    assert got == [(1, high), (3, high), (4, high), (2, low)]


def test_top_k_beyond_doubles():
    q, rows = np.array([[1 << 27, 3]], dtype=np.int64), np.array([[1 << 27, k] for k in range(40)], dtype=np.int64)
    found = topk.best_in_group(np.array([99]), q, np.arange(40), rows, 3, 4)
    assert found == [(99, k, (1 << 54) + 3 * k) for k in (39, 38, 37)]


def test_top_k_of_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0


# 4


@pytest.mark.parametrize(
    "text, ids, found",
    [
        ("Intro. Released under the MIT License.\nEnd", ["MitStatement"], ["MIT"]),
        ("LICENSED!! UNDER!! CC!! BY-NC!! 4.0.", ["CcByNc4Statement"], ["CC-BY-NC-4.0"]),
        ("Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["ApacheStatement", "ApacheCompliance", "ApacheCopy"], ["Apache-2.0"]),
        ("You may not use this file except in compliance with the License.\nLicensed under the Apache License, Version 2.0.", ["ApacheCompliance", "ApacheStatement"], ["Apache-2.0"]),
        ("Licensed under the Foo terms.", ["UNKNOWN"], ["Unknown"]),
        ("All rights reserved.\nAll rights reserved.", ["AllRights", "AllRights"], ["Proprietary"]),
        ("a licence to write", [], []),
        ("", [], []),
        (None, [], []),
    ],
)
def test_licences(spark, text, ids, found):
    row = licences.recognise(docs(spark, [text]).withColumn("licences", F.lit(1))).first()
    assert (row.identifiers, row.licences, row.text) == (ids, found, text)


MIT = """MIT License

Copyright (c) 2024 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Some Institute nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may
not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

You should have received a copy of the GNU General Public License
along with this program."""


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software."""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
CC0 = """To the extent possible under law, the author(s) have dedicated all
copyright and related and neighboring rights to this software to the
public domain worldwide."""


@pytest.mark.parametrize("comment", ["", "# ", " * ", "// "])
def test_wrapped_licences(spark, comment):
    bsd = ["BsdConditions", "BsdSource", "BsdBinary", "BsdEndorse", "BsdDisclaimer"]
    cases = [
        (MIT, ["MitGrant", "MitNotice", "AsIs"], ["MIT"]),
        (MIT.replace("\n", "\r\n"), ["MitGrant", "MitNotice", "AsIs"], ["MIT"]),
        (BSD, bsd, ["BSD-3-Clause"]),
        (BSD.replace("Some Institute", "the copyright holder"), bsd, ["BSD-3-Clause"]),
        (APACHE, ["ApacheStatement", "ApacheCompliance", "ApacheCopy"], ["Apache-2.0"]),
        (GPL, ["Gpl3OrLater"], ["GPL-3.0-or-later"]),
        (GPL.replace("version 3", "version 2"), ["Gpl2OrLater"], ["GPL-2.0-or-later"]),
        (GPL.replace("General", "Affero General"), ["Agpl3OrLater"], ["AGPL-3.0-or-later"]),
        (LGPL, ["Lgpl21OrLater"], ["LGPL-2.1-or-later"]),
        (ISC, ["IscGrant"], ["ISC"]),
        (UNLICENSE, ["UnlicenseGrant"], ["Unlicense"]),
        (EPL, ["Epl2Statement"], ["EPL-2.0"]),
        (MPL, ["Mpl2Statement"], ["MPL-2.0"]),
        (CC0, ["Cc0Dedication"], ["CC0-1.0"]),
        *((re.sub(r"(?<!\n)\n(?!\n)", " ", x), i, f) for x, i, f in ((MIT, ["MitGrant", "MitNotice", "AsIs"], ["MIT"]), (LGPL, ["Lgpl21OrLater"], ["LGPL-2.1-or-later"]), (CC0, ["Cc0Dedication"], ["CC0-1.0"]), (MPL, ["Mpl2Statement"], ["MPL-2.0"]))),
        ("This work is licensed\nunder the Foo terms.\nReleased under the MIT License.", ["UNKNOWN", "MitStatement"], ["MIT", "Unknown"]),
        ("A title\nReleased under the MIT License\nand more", ["MitStatement"], ["MIT"]),
        ("It is said\nto be licensed\n\nunder the sea", [], []),
    ]
    texts = ["\n".join(f"{comment}{x}" for x in t.split("\n")) for t, _, _ in cases]
    rows = sorted(licences.recognise(docs(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [(r.identifiers, r.licences) for r in rows] == [(i, f) for _, i, f in cases]


def test_licence_sentences_are_normalised(spark):
    df = spark.createDataFrame([(s,) for s in licences.SENTENCES], "s string")
    assert df.where(licences._normal(F.col("s")) != F.col("s")).count() == 0
    assert df.where(~F.col("s").rlike(licences.CUE)).count() == 0


# 5


def cleaned(rows, min_sites):
    bare = lambda line: line.strip(" \t\r\x0b\x0c")
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if bare(line) and s is not None:
                sites.setdefault(bare(line), set()).add(s)
    bad = {k for k, v in sites.items() if len(v) >= min_sites}
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        ls = t.split("\n")
        hit = [line for line in ls if bare(line) in bad]
        cut = any(bare(line) and bare(line) not in bad for line in ls)
        out.append((i, len(ls), len(hit) if cut else 0, "\n".join(x for x in ls if bare(x) not in bad) if cut else t))
    return out


@pytest.mark.parametrize("min_sites", [2, 6, 40])
def test_lines(spark, min_sites):
    rows = [(i, f"{prose(i, 8)}\nAccept all cookies\n\n{prose(i + 500, 9)}", f"site{i % 60}") for i in range(120)]
    rows += [(200 + i, "one copied text\nof two lines", f"site{i}") for i in range(45)]
    rows += [(300, None, "a"), (301, "", "a"), (302, " Accept all cookies \n" + prose(1, 20), None), (None, "Accept all cookies\n" + prose(2, 20), "b"), (5, rows[5][1], "site5"), (303, "Accept all cookies", "z")]
    rows += [(400 + i, f"near {prose(700 + i, 12)}\nseen at six" + "\t\r" * (i % 2), f"n{i}") for i in range(6)]
    rows += [(500, "Accept all cookies\r\n\tAccept all cookies\r\nx", "q"), (501, " \n\t\n", "q")]
    clashing = ", n_removed string, id int, seal int, at int, cut int, other int, `_id` int"
    df = spark.createDataFrame([(i, t, "en", s, 0, "own", 1, 2, 3, 4, 5, 6) for i, t, s in rows], DOCS + clashing)
    assert lines.without_boilerplate(df).select("id", "seal", "at", "cut", "other", "_id").distinct().collect() == [(1, 2, 3, 4, 5, 6)]
    got = lines.without_boilerplate(df, min_sites=min_sites).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cleaned(rows, min_sites)))


def test_lines_of_empty_table(spark):
    assert lines.without_boilerplate(docs(spark, [])).count() == 0


# 6


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [prose(i, 5 + 37 * (i % 9)) for i in range(60)] + [None, "", " x  y\n\n z ", "a <|endoftext|> b", "tab\tand space   é", "word " * 3_000, "don't 12 34.5 !!", "\n", "x" * 5_000]
    ids = [*range(len(texts) - 2), None, 3]
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]
    rows = packing.pack(docs(spark, texts, ids).repartition(3)).collect()
    encoder = packing.Encoder(packing.tokenizer_path())
    assert [np.frombuffer(encoder.encode(x or ""), "<u4").tolist() + [0] for x in texts] == want
    total = sorted((i if i is not None else -1, len(w)) for i, w in zip(ids, want, strict=True))
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert sorted((k[0] if k[0] is not None else -1, k[1]) for k in pieces) == total
    by_key = {(i, len(w)): w for i, w in zip(ids, want, strict=True)}
    for key, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(by_key[key][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == key[1]
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    assert packing.pack(docs(spark, [])).count() == 0


def sequences(rows):
    out = {}
    for r in rows:
        out.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in out.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0 or at == 1024
    return {k: sum(n for _, n in own) for k, own in out.items()}


def test_packing_of_long_white_space(spark):
    from tokenizers import Tokenizer

    t, texts = Tokenizer.from_file(packing.tokenizer_path()), [" " * 2_000_000, "\n" * 300_000 + "a", "a" + "\t " * 1_000 + "b c"]
    encoder = packing.Encoder(packing.tokenizer_path())
    for x in texts:
        assert np.frombuffer(encoder.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    rows = packing.pack(docs(spark, texts)).collect()
    assert sum(r.length for r in rows) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in texts)
    sequences(rows)


def test_packing_of_items_that_do_not_fit_together(spark):
    """Items of 600 to 999 ids never share a window whole; open windows stay bounded and nothing is padded."""
    r = random.Random(2)
    texts = [" ".join(["word"] * r.randint(600, 998)) for _ in range(400)]
    rows = packing.pack(docs(spark, texts).coalesce(1), held=20_000).collect()
    full = sequences(rows)
    total = sum(r.length for r in rows)
    assert total == sum(len(x.split()) + 1 for x in texts) and sum(full.values()) == total
    assert sum(n < 1024 for n in full.values()) <= 10


def test_levels_follow_the_rule():
    r, levels, counts = random.Random(9), packing.Levels(20), [0] * 21
    for _ in range(500):
        size = r.randint(1, 19)
        before = {h: n for h, n in enumerate(counts) if n and 0 < h <= 20 - size} | {0: 0}

        def squares(h, size=size):
            c = counts.copy()
            c[h] -= h > 0
            if h + size < 20:
                c[h + size] += 1
            return sum(x * x for x in c)

        best = min(squares(h) for h in before)
        full = levels.place(size, (size,))
        now = [len(x) for x in levels.open]
        assert sum(x * x for x in now) == best and (full is None or sum(p[0] for p in full) == 20)
        counts = now


# 7


def test_tool_calls(spark):
    calls = [
        (1, "a", 0, "add", '{"y": 2, "x": {"b":1,"a":[1, 2]}}', None),
        (1, "b", 2, "add", '{"x": 1, "z": 0}', ["a"]),
        (1, "c", 3, "gone", "{}", ["b"]),
        (2, "late", 1, "add", '{"x": 1}', ["early"]),
        (2, "early", 5, "add", "not json", []),
        (2, "last", 2, "add", '{"x": "s"}', ["late", "none"]),
        (3, "p", 1, "add", None, ["q"]),
        (3, "q", 2, "add", "[1]", ["p"]),
        (3, "r", 9, "add", '{"x": 1}', ["q"]),
        (None, "a", 0, "add", "{}", None),
        (1, "a", 7, "add", '{"x": 9}', None),
    ]
    results = [(1, "a", 1, "3"), (1, "b", 1, "soon"), (9, "a", 1, "whose"), (1, "a", 8, "again"), (2, "late", 3, None), (1, None, 4, "x")]
    tools = toolcalls.schemas(spark, {"add": {"x": ("BIGINT", True), "y": ("BIGINT", False)}})
    rows = toolcalls.link(spark.createDataFrame(calls, toolcalls.CALLS), spark.createDataFrame(results, toolcalls.RESULTS), tools).collect()
    got = {(r.conv_id, r.call_id): r for r in rows}
    assert len(rows) == 12
    status = {k: r.status for k, r in got.items()}
    assert status == {(1, "a"): "linked", (1, "b"): "early", (1, "c"): "unanswered", (2, "late"): "linked", (2, "early"): "unanswered", (2, "last"): "unanswered", (3, "p"): "unanswered", (3, "q"): "unanswered", (3, "r"): "unanswered", (9, "a"): "orphan", (None, "a"): "unnamed", (1, None): "unnamed"}
    place = {k: r.place for k, r in got.items()}
    assert place[1, "a"] < place[1, "b"] < place[1, "c"] and place[2, "early"] < place[2, "late"] < place[2, "last"]
    assert place[3, "p"] is place[3, "q"] is place[3, "r"] is None
    assert got[1, "a"].faults.startswith("type:x") and got[1, "b"].faults == "unknown:z" and got[1, "c"].faults == "no_such_tool"
    assert got[2, "early"].faults == "not_object" and got[2, "last"].faults == "type:x" and got[2, "late"].faults == ""
    assert got[1, "a"].record == '{"arguments":{"x":{"a":[1,2],"b":1},"y":2},"call_id":"a","content":"3","conv_id":1,"name":"add","place":0,"status":"linked"}'


def test_circles_end_whatever_the_turns_are(spark, monkeypatch):
    """Rounds are bounded by the bits of a chain's length and by calls that wait for several in a row, not by turns."""
    rounds, staged = [], toolcalls.staged
    monkeypatch.setattr(toolcalls, "staged", lambda df, name: rounds.append(name) or staged(df, name))
    big = 10**9
    calls = [(1, "a", 1, "t", "{}", ["b"]), (1, "b", big, "t", "{}", ["a"]), (1, "c", 5, "t", "{}", ["d"]), (1, "d", big + 7, "t", "{}", []), (1, "e", 2, "t", "{}", ["b", "c"]), (1, "f", 3, "t", "{}", ["f"])]
    got = {r.call_id: r.place for r in toolcalls.in_order(spark.createDataFrame(calls, toolcalls.CALLS)).collect()}
    assert got == {"a": None, "b": None, "c": big + 8, "d": big + 7, "e": None, "f": None}
    assert rounds.count("waiting") <= 3 and rounds.count("chains") <= 1 + (6).bit_length()


def test_tool_calls_in_messages(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[{"id":"k","name":"add","arguments":{"x":1}}]}'), (1, 2, "tool", '{"tool_call_id":"k","content":"ok"}'), (1, 3, "assistant", "done"), (1, 4, "tool", "{}"), (1, 5, None, None)]
    calls, results = toolcalls.messages_as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    tools = toolcalls.schemas(spark, {"add": {"x": ("BIGINT", True)}})
    (r,) = toolcalls.link(calls, results, tools).collect()
    assert (r.status, r.faults, r.call_turn, r.result_turn) == ("linked", "", 1, 2)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert toolcalls.link(*toolcalls.turns_as_events(none), tools).count() == 0


# 8


def groups(rows, percent=85, size=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def test_near_duplicates(spark):
    r, rows = random.Random(8), []
    for base in range(12):
        words = prose(base, 120).split()
        for copy in range(10):
            w = words.copy()
            for _ in range(copy % 5):  # copies of one base, some just over and some just under the limit of one another
                w[r.randrange(len(w))] = f"new{r.random()}"
            rows.append((100 * base + copy, " ".join(w)))
    rows += [(5_000 + i, "Short one") for i in range(3)] + [(5_100, "short  ONE"), (5_101, None), (5_102, ""), (5_103, " \n"), (5_104, "a b c d e"), (5_105, "A b\tc d e"), (5_106, "x " * 9_000)]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, kept long")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == groups(rows)


def test_near_duplicates_through_a_hub(spark):
    """Members near a common text, but not near one another, and with larger ids than it has."""
    r, words = random.Random(4), prose(77, 150).split()
    rows = []
    for i in range(40):
        w = words.copy()
        for k in r.sample(range(30), 2):
            w[5 * k] = f"z{r.random()}"
        rows.append((i, " ".join(w)))
    rows.append((999, " ".join(words)))
    want = groups(rows)
    assert len({c for _, _, c, _ in want}) == 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == want


@pytest.mark.parametrize("scattered", [False, True])
def test_near_duplicates_of_template_families(spark, monkeypatch, scattered):
    """Families whose members are mostly just under the limit of one another: few pairs are met, no link is lost."""
    r, met, confirmed = random.Random(6), [], minhash._confirmed

    def counted(pairs, sets, percent):
        met.append(pairs.count())
        return confirmed(pairs, sets, percent)

    monkeypatch.setattr(minhash, "_confirmed", counted)
    words, rows = prose(31, 150).split(), []
    for i in range(150):
        w = words.copy()
        for k in r.sample(range(30), 2) if scattered else ():
            w[5 * k] = f"s{r.random()}"
        if not scattered:
            w[40:48] = [f"f{r.random()}" for _ in range(8)]
        rows.append((i, " ".join(w)))
    rows.append((900, rows[3][1] + " end"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups(rows)
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == want
    assert len({c for _, _, c, _ in want}) == (150 if not scattered else len({c for _, _, c, _ in want}))
    assert sum(met) < 5 * len(rows)


def test_near_duplicates_with_odd_ids(spark):
    t = [prose(i, 20) for i in range(3)]
    df = spark.createDataFrame([(None, t[0]), (None, t[0]), (4, t[1]), (4, t[2]), (9, t[2]), (None, t[1]), (-5, t[1])], "doc_id long, text string")
    rows = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()]
    assert sorted(rows, key=repr) == sorted([(None, None, True)] * 2 + [(4, -5, False), (4, -5, False), (9, -5, False), (None, -5, False), (-5, -5, True)], key=repr)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signatures_agree_as_sets_do():
    probes, codes = minhash._probe_order(216), minhash.WordCodes()
    a, b = (minhash.shingle_set(t, codes, 1) for t in (" ".join(f"w{i}" for i in range(1_000)), " ".join(f"w{i}" for i in range(100, 1_100))))
    same = np.mean(minhash.signature(a, 216, probes) == minhash.signature(b, 216, probes))
    assert abs(same - 900 / 1_100) < 0.1


# 10


def test_archive_round_trip(spark):
    big = "<p>" + "é" * 700
    rows = [(1, "http://a/1", big), (7, "http://a/2", big), (3, None, big), (4, "http://b c\r\nX: y", "small"), (5, "u", "small"), (6, "u", None), (None, "u", "none"), (8, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50), (9, "u", ""), (9, "u", "\r\n\r\n")]
    got = warc.archived_pages(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int"))
    found = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=repr)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = h == big and i != 7
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert found == sorted(want, key=repr)


def test_archive_of_pages_with_long_urls(spark):
    rows = [(1, "http://a/" + "x" * 70_000, "one"), (2, "http://a/" + " " * 40_000, "two"), (3, "u", "three")]
    got = warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.target_uri) for r in got} == {(i, u.replace(" ", "%20")) for i, u, _ in rows}
    assert ids(record(1).replace(b"\r\n\r\n", b"\r\n", 1) + record(2)) == ["bad header line", "2"]


def record(n, body=b"hello"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = f"WARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return warc.VERSION + head.encode() + block + b"\r\n\r\n"


def ids(data):
    return [r if isinstance(r, str) else r.headers["warc-record-id"][10:-1] for _, _, r in warc.salvage(data)]


def gz(data):
    c = zlib.compressobj(wbits=31)
    return c.compress(data) + c.flush()


@pytest.mark.parametrize("pack, spot", [(bytes, 5), (gz, 40)])
def test_salvage(pack, spot):
    parts = [pack(record(i, bytes([65 + i]) * (50 + 30 * i))) for i in range(5)]
    whole = b"".join(parts)
    assert ids(whole) == ["0", "1", "2", "3", "4"]
    at = len(parts[0])
    for damaged in (
        whole[: at + 20] + whole[at + len(parts[1]) :],  # cut out
        whole[: at + spot] + b"\x00" + whole[at + spot + 1 :],
        whole[: at + len(parts[1]) - 8] + b"????" + whole[at + len(parts[1]) - 4 :],
        whole[:at] + b"junk\r\n" * 9 + whole[at + len(parts[1]) :],
    ):
        found = list(warc.salvage(damaged))
        assert [x for x in ids(damaged) if x in "01234"] == ["0", "2", "3", "4"]
        assert sum(n for _, n, _ in found) == len(damaged) and [p for p, _, _ in found] == sorted(p for p, _, _ in found)
        (gap,) = [f for f in found if isinstance(f[2], str)]
        assert gap[0] == at
    assert ids(whole[:-9])[-1] not in "01234" and list(warc.salvage(b"")) == []
    assert list(warc.salvage(b"nothing here")) == [(0, 12, "no version line")]


def test_salvage_inside_gzip_members():
    parts = [record(i, random.Random(i).randbytes(40_000)) for i in range(6)]
    hurt = [*parts[:2], parts[2][:30_000] + b"??" + parts[2][30_002:], *parts[3:]]
    one = gz(b"".join(hurt))
    whole = gz(parts[0]) + one + gz(parts[5])
    found = list(warc.salvage(whole))
    assert [i for i in ids(whole) if len(i) == 1] == list("0013455")
    (gap,) = [f for f in found if isinstance(f[2], str)]
    assert gap[:2] == (len(gz(parts[0])), len(one)) and f"{len(parts[0]) * 2} to {len(parts[0]) * 3}" in gap[2]
    one = gz(b"".join(parts))
    cut = one[: len(one) * 7 // 12]
    for broken in (cut, cut + b"\xff" * 400, cut + gz(parts[5])):
        got = list(warc.salvage(broken))
        assert [i for i in ids(broken) if len(i) == 1] == list("0125" if broken.endswith(gz(parts[5])) else "012")
        assert sum(n for _, n, _ in got) == len(broken) and [p for p, _, _ in got] == sorted(p for p, _, _ in got)
    plain = zlib.compressobj(0, wbits=31)
    stored = plain.compress(b"".join(p[:300] for p in [record(i) for i in range(5)])) + plain.flush()
    assert [i for i in ids(stored[:-8] + b"????????") if len(i) == 1] == list("01234")


def test_salvage_of_files(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1) + b"\xff" * 100 + record(2))
    (tmp_path / "b.warc.gz").write_bytes(gz(record(3)) + gz(record(4))[:-3])
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in rows if r.kind != "gap") == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    gaps = {r.file.rsplit("/", 1)[1]: (r.position, r.length, r.reason) for r in rows if r.kind == "gap"}
    assert gaps == {"a.warc": (len(record(1)), 100, "no version line"), "b.warc.gz": (len(gz(record(3))), len(gz(record(4))) - 3, "broken gzip member")}


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    """Files stay under the bound whatever the pages' sizes and order; a longer page has its own file."""
    assert warc.size_classes(2000, 64 << 20)[0] == (2000, (64 << 20) // 2000) and warc.size_classes(1, 10) == [(1, None)]
    sizes = [0, 10, 900, 30_000, 5_000, 300_000, 20, 250_000, 40_000, 8_000] * 4
    rows = [(i, f"http://a/{i}", "é" * (n // 2) + str(i)) for i, n in enumerate(sizes)] + [(900, None, None), (901, "u" * 9_000, "x" * 300_000), (902, "v", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_archives(pages, str(tmp_path / "small"), records_per_file=40, file_bytes=100_000)
    files = [f for f in (tmp_path / "small").rglob("*.txt") if f.stat().st_size]
    over = [f for f in files if f.stat().st_size > 100_000]
    assert all(f.read_bytes().count(b"WARC-Record-ID:") == 1 for f in over) and len(over) == 9
    got = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path / "small")).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        r = got[f"<urn:page:{i}>"]
        assert r.kind == ("revisit" if i == 901 else "response") and r.payload_bytes == len((html or "").encode())
    # of usual pages, all are of the first class: one write
    warc.write_archives(pages.where("page_id < 3"), str(tmp_path / "usual"))
    assert [p.name for p in (tmp_path / "usual").iterdir()] == ["records-0"]
    warc.write_archives(pages.where("page_id < 0"), str(tmp_path / "none"))
    assert [f for f in (tmp_path / "none").rglob("*.txt") if f.stat().st_size] == []
