"""The divergence audit against its definition."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import divergence

DOCS = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, min_docs=10, top=10):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        n[lang, source].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= min_docs]

        def shares(count):
            room = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // room for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(h, sum(f(p[s][t], p[h][t]) for t in kept)) for h in sources if h != s]
            said = [(t, f(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", said, top)):
                ordered = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ordered)]
    return sorted(out)


def corpus(n=600, sources=14):
    r = random.Random(8)
    words = ["Été", "thing", "the", "日本", "a1b", "x_y", "ÀB", "ß", "z" * 300] + ["w" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(60)]
    rows = []
    for i in range(n):
        s = int(sources * r.random() ** 2)
        own = words[: 9 + s * 4] if i % 3 else words
        rows.append((i, " ".join(r.choice(own) for _ in range(r.randint(0, 30))), r.choice(["en", "fr", None]), f"s{s}"))
    return [*rows, (1, None, "en", "empty"), (None, "", "de", None), (2, "thing 12 !", "de", "x"), rows[5], rows[5], (7, None, None, None)]


def result(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"heavy": 3, "block": 4, "width": 7}, {"heavy": 1, "block": 1}, {"heavy": 100}])
def test_audit(spark, options):
    """However terms are dealt to tiles and postings, the sums are the same."""
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(3).select("*", F.lit(1).alias("term"), F.lit("x").alias("g"), F.lit(0).alias("n"))
    got = result(divergence.audit(df, **options))
    assert got == expected(rows)
    assert {x[2] for x in got} == {"pair", "term"} and ("de", "", "pair", "x", 0, 1) in got


def test_nothing_and_one_group(spark):
    df = spark.createDataFrame([(1, "one two", "en", "a")], DOCS)
    assert divergence.audit(df).collect() == [] and divergence.audit(df.limit(0)).collect() == []
    rows = [(i, "one two two", "en", "ab"[i > 10]) for i in range(30)]
    assert result(divergence.audit(spark.createDataFrame(rows, DOCS))) == expected(rows)


def test_large_shares(spark):
    n, room = 7 * 10**12 + 3, 9 * 10**12 + 1
    (row,) = spark.createDataFrame([(n, room)], "n long, room long").select(divergence.share("n", "room").alias("p")).collect()
    assert row.p == 1 + 10**9 * (n + 2) // room


def test_terms():
    assert [t.decode() for t in divergence.terms("Don't été_X9Y 日本".encode())] == ["don", "t", "été", "x", "y", "日本"]


def test_no_sum_leaves_64_bits():
    assert divergence._f(np.array([10**9 + 1]), np.array([1]))[0] == 10**18 // (10**9 + 2)


def test_counting_takes_no_step_of_python_a_term():
    """However texts are cut into batches and parts the counts are the same, for less time than a loop over each text's terms."""
    r = random.Random(3)
    words = ["w" + "abcdefghij"[i % 10] * (1 + i // 10 % 9) + "klmnopqrst"[i // 90] for i in range(900)] + ["Été", "日本", "DON'T", "x_9y", "\x00\x0b"]
    rows = [(r.choice(["en", "", "fr"]), f"s{i % 7}", " ".join(r.choices(words, k=r.choice([0, 1, 400])))) for i in range(6_000)]
    docs = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["lang", "source", "text"])

    def counted(step, held):
        found, size = defaultdict(Counter), 0
        for batch in divergence._counted((docs.slice(i, step) for i in range(0, len(rows), step)), held):
            for lang, source, term, n, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found[lang, source, term].update(n=n, docs=k)
        return found

    known = {}
    started = time.process_time()
    for lang, source, text in rows:
        known.setdefault((lang, source, None), [0, 0])
        for term, n in Counter(divergence.terms(text.encode())).items():
            if (seen := known.get((lang, source, term))) is None:
                known[lang, source, term] = [n, 1]
            else:
                seen[0] += n
                seen[1] += 1
    loop = time.process_time() - started
    want = {(lang, source, term and term.decode()): Counter(n=n, docs=k) for (lang, source, term), (n, k) in known.items()}
    assert all(counted(step, held) == want for step, held in ((6_000, 8 << 20), (700, 100_000), (50, 1)))
    started = time.process_time()
    assert sum(b.num_rows for b in divergence._counted(iter([docs]))) == len(want)
    assert time.process_time() - started < 0.8 * loop
    assert list(divergence._counted(iter([]))) == []
