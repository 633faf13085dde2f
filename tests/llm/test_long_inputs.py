"""Operators over very long texts and chains: nothing recurses, and costs grow with the length, not its square."""

import time

import pytest
from pyspark.sql import functions as F

from quillstone.llm import licences, lines, packing, toolcalls

from .test_operators import docs, prose

SIGN_RUNS = {"spaces": " " * 1_000_000, "signs": "*=" * 500_000, "stops": "." * 300_000, "exclaims": "?! " * 200_000, "feeds": "\n# " * 300_000, "dotted": "ab.c_d." * 150_000}


@pytest.mark.parametrize("kind", SIGN_RUNS)
def test_licences_in_long_runs_of_signs(spark, kind):
    run = SIGN_RUNS[kind]
    texts = [f"released{run}under the mit license", f"words {run}\nReleased under the MIT License.\n{run}", f"licensed under {run}"]
    rows = licences.recognise(docs(spark, texts)).orderBy("doc_id").collect()
    assert rows[1].licences == ["MIT"]


def test_licences_behind_long_banners(spark):
    banner = "/" * 60
    texts = [f"{banner} Licensed under the MIT license.\n{banner}", f"/*{'*' * 70}\n * SPDX-License-Identifier: GPL-2.0-only\n */", "# SPDX-License-Identifier: Apache-2.0", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation."]
    rows = licences.recognise(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.licences for r in rows] == [["MIT"], ["GPL-2.0-only"], ["Apache-2.0"], ["GPL-2.0-only"]]


def test_lines_of_a_long_text(spark):
    """40,000 boilerplate lines: the text is rebuilt in a pass."""
    shared = [prose(i, 3) for i in range(40_000)]
    texts = ["\n".join([*shared[: 10_000 * (1 + i % 2)], f"own {i}", "", *shared[20_000:]]) for i in range(8)]
    df = docs(spark, texts, sources={i: f"s{i}" for i in range(8)})
    began = time.time()
    got = {r.doc_id: r.text for r in lines.without_boilerplate(df).collect()}
    took = time.time() - began
    assert all(t == f"own {i}\n" or set(t.split("\n")) <= {f"own {i}", "", *shared[10_000:20_000]} for i, t in got.items())
    assert took < 60


@pytest.mark.parametrize("partitions", [1, 8])
def test_most_items_stay_where_the_rule_puts_them(spark, partitions):
    texts = [prose(i, 20 + (i * 37) % 400) for i in range(1_600)]
    rows = packing.pack(docs(spark, texts).repartition(partitions)).collect()
    whole = {}
    for r in rows:
        if r.way != "full":
            whole.setdefault(r.doc_id, []).append(r.way)
    share = sum(w == ["rule"] for w in whole.values()) / len(whole)
    assert share > 0.5
    sizes = {}
    for r in rows:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert all(n & (n - 1) == 0 for n in sizes.values())  # nothing is padded


def test_a_chain_of_two_thousand_calls(spark):
    n = 2_000
    calls = [(1, str(i), i, "ask", "{}", [str(i + 1)]) for i in range(n)] + [(2, "a", 5, "ask", "{}", ["b"]), (2, "b", 4, "ask", "{}", ["a"]), (2, "c", 3, "ask", "{}", ["b"]), (2, "d", 2, "ask", "{}", ["e", "f"]), (2, "e", 7, "ask", "{}", None), (2, "f", 9, "ask", "{}", ["e"]), (2, "g", 1, "ask", "{}", ["d"]), (2, "h", 1, "ask", "{}", ["g", "c"])]
    got = {(r.conv_id, r.call_id): r.place for r in toolcalls.in_order(spark.createDataFrame(calls, toolcalls.CALLS)).collect()}
    assert len(got) == n + 8
    assert all(got[1, str(i)] == n - 1 + (n - 1 - i) for i in range(n))
    assert {k: got[2, k] for k in "abcdefgh"} == {"a": None, "b": None, "c": None, "d": 10, "e": 7, "f": 9, "g": 11, "h": None}


def test_places_of_random_needs(spark):
    """Against places by hand, over graphs with chains, forks and circles."""
    import random

    calls, want = [], {}
    for conv in range(40):
        r = random.Random(conv)
        n = r.randint(1, 14)
        turns = [r.randint(0, 30) for _ in range(n)]
        after = [[str(x) for x in {r.randrange(n + 2) for _ in range(r.choice([0, 1, 1, 1, 2]))}] for _ in range(n)]
        calls += [(conv, str(i), turns[i], "ask", "{}", after[i] or None) for i in range(n)]
        needs = {i: [int(x) for x in after[i] if int(x) < n] for i in range(n)}
        place = {}
        for _ in range(n + 1):
            for i in range(n):
                if i not in place and all(x in place for x in needs[i]):
                    place[i] = max([turns[i], *(place[x] + 1 for x in needs[i])])
        ordered = all(turns[x] < turns[i] for i in range(n) for x in needs[i])
        want |= {(conv, str(i)): turns[i] if ordered else place.get(i) for i in range(n)}
    got = {(r.conv_id, r.call_id): r.place for r in toolcalls.in_order(spark.createDataFrame(calls, toolcalls.CALLS)).collect()}
    assert got == want and any(v is None for v in want.values())
