import json

import pytest

from quillstone.operators import graph, parse
from quillstone.plans import catalogue
from quillstone.sources import files


def units(code, path="m.py"):
    return {u.name: u for u in parse.parse_source(path, code.encode())[0]}


def test_functions_and_docstrings():
    u = units('def a(x):\n    """Doc."""\n    return x\n\ndef b():\n    return a(len([]))\n')
    assert list(u) == ["a", "b"] and u["a"].docstring == "Doc." and u["b"].calls == ["a", "len"]
    assert (u["b"].start_line, u["b"].end_line) == (5, 6)


def test_class_and_methods():
    u = units('class C:\n    "About."\n    def m(self): pass\n    def n(self): return self.m()\n\ndef use(): return C().n()\n')
    assert list(u) == ["C", "C.m", "C.n", "use"]
    assert u["C"].type == "class" and u["C"].calls == [] and u["C"].docstring == "About." and u["C.n"].calls == ["m"] and u["use"].calls == ["n", "C"]


def test_rules_of_extraction():
    found, imports = parse.parse_python(catalogue.PYTHON_SAMPLE)
    u = {x.name: x for x in found}
    assert set(u) == {"first", "Box", "Box.put", "Box.inner", "Lid", "Lid.close", "second"}
    assert imports == ["import os", "from a import b"]
    assert u["first"].calls == ["second", "join", "b"] and u["Box.put"].calls == ["helper", "inner"] and u["Lid.close"].calls == ["done", "put", "first"]


@pytest.mark.parametrize("literal, want", [('r"""Raw."""', 'r"""Raw.'), ("'One.'", "One."), ('"""  In.  """', "In.")])
def test_docstring_quotes(literal, want):
    assert units(f"def f():\n    {literal}\n")["f"].docstring == want


def test_empty_and_broken():
    assert units("") == {}
    assert list(units("def f(:\n    g()\n\nclass K:\n    def m(self):\n        h()\n")) == ["f", "K", "K.m"]
    assert parse.parse_source("m.txt", b"def f(): pass") == ([], [])
    assert "f" in units("def f():\n    return 1\n", "M.PY")


def test_script():
    found, imports = parse.parse_script(catalogue.SCRIPT_SAMPLE)
    u = {x.name: x for x in found}
    assert set(u) == {"load", "parse", "Store", "Store.constructor", "Store.get", "twice"}
    assert imports == ['import { x } from "./x";', "const LIMIT = 3;"]
    assert u["load"].calls == ["parse", "then", "fetch"] or set(u["load"].calls) == {"parse", "then", "fetch"}
    assert "Map" not in u["Store.constructor"].calls and "make" in u["Store.constructor"].calls
    assert u["load"].docstring == "Loads." and u["twice"].calls == ["double"]


def test_units_table(spark):
    df = parse.parse_units(catalogue._samples(spark), "r")
    rows = df.collect()
    assert all(r.id.startswith(f"r::{r.file}::") and r.id.endswith(f"::{r.start_line}") for r in rows)
    f = {r.file: r for r in parse.file_summaries(df).collect()}
    assert f["a.py"].id == "r::FILE::a.py" and f["a.py"].source.startswith("File: a.py\nContains: first, Box, ") and (f["a.py"].start_line, f["a.py"].end_line) == (1, 0)
    assert "empty.py" not in f


def test_discovery(tmp_path):
    for p in ("a.py", "pkg/__init__.py", "pkg/_p.py", "tests/t.py", ".dot/h.py", "gen/out.js", "gen/keep.js", "n.txt", "deep/node_modules/x.js", "logs/x.py", "UP.PY", ".dot.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x\n")
    (tmp_path / "big.py").write_bytes(b"x" * (1 << 20))
    (tmp_path / "bigger.py").write_bytes(b"x" * ((1 << 20) + 1))
    (tmp_path / ".gitignore").write_text("# note\ngen/*\n!gen/keep.js\n/logs/\n")
    found = files.discover(str(tmp_path))
    assert [r for _, r, _ in found] == [".dot.py", "a.py", "big.py", "gen/keep.js", "pkg/__init__.py", "pkg/_p.py"] or {r for _, r, _ in found} == {".dot.py", "a.py", "big.py", "gen/keep.js", "pkg/__init__.py", "pkg/_p.py"}
    assert len(files.discover(str(tmp_path), max_files=2)) == 2
    with pytest.raises(files.TooLarge):
        files.check_size(found, max_kb=1)


def g(spark, rows):
    return spark.createDataFrame([(i, n, "f.py", "function", 1, 2, c, k) for k, (i, n, c) in enumerate(rows)], "id string, name string, file string, type string, start_line int, end_line int, calls array<string>, seq long")


def test_graph(spark):
    e = graph.edges(g(spark, [("1", "a", ["b", "b", "a", "gone"]), ("2", "b", ["c"]), ("3", "c", []), ("4", "b", [])]))
    assert sorted((r.src, r.dst) for r in e.collect()) == [("1", "4"), ("2", "3")]  # the last unit of a name wins
    seeds = spark.createDataFrame([(0, "1"), (1, "3")], "question_id long, id string")
    assert sorted(map(tuple, graph.neighbours(seeds, e).select("question_id", "id").collect())) == [(0, "4"), (1, "2")]


def test_degree_cap(spark):
    rows = [("hub", "hub", [f"c{i}" for i in range(60)])] + [(f"c{i}", f"c{i}", []) for i in range(60)] + [(f"k{i}", f"k{i}", ["hub"]) for i in range(60)]
    e = graph.edges(g(spark, rows))
    seed = spark.createDataFrame([(0, "hub")], "question_id long, id string")
    near = [r.id for r in graph.neighbours(seed, e).collect()]
    assert sum(x[0] == "c" for x in near) == 50 and sum(x[0] == "k" for x in near) == 50


def test_node_link_round_trip(spark):
    u = g(spark, [("1", "x", ["y"]), ("2", "y", [])])
    row = graph.to_node_link(graph.nodes(u), graph.edges(u))
    assert json.loads(row.first().graph)["links"] == [{"source": "1", "target": "2"}]
    n, e = graph.from_node_link(row)
    assert sorted(r.id for r in n.collect()) == ["1", "2"] and [(r.src, r.dst) for r in e.collect()] == [("1", "2")]


def test_node_link_pieces(spark, monkeypatch):
    """Pieces in order are the one document, and give the graph back; no piece holds more than it may."""
    monkeypatch.setattr(graph, "PIECE", 4)
    u = g(spark, [(f"{i:02}", f"n{i}", [f"n{i - 1}", f"n{i // 2}"]) for i in range(30)] + [("q", 'a "b",', [])])
    nodes, edges = graph.nodes(u), graph.edges(u)
    pieces = graph.node_link_pieces(nodes, edges)
    rows = sorted(pieces.collect())
    assert "".join(r.piece for r in rows) == graph.to_node_link(nodes, edges).first().graph
    assert len(rows) > 10 and max(r.piece.count("{") for r in rows[1:]) <= 4
    n, e = graph.from_node_link_pieces(pieces)
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect()))
    assert [(r.src, r.dst) for r in e.orderBy("seq").collect()] == sorted((r.src, r.dst) for r in edges.collect())
    empty = graph.node_link_pieces(nodes.where("false"), edges.where("false"))
    assert json.loads("".join(r.piece for r in sorted(empty.collect()))) == {"directed": True, "multigraph": False, "graph": {}, "nodes": [], "links": []}


def test_edges_at_some_units(spark):
    """The edges that begin or end at given units are those of the whole graph."""
    u = g(spark, [(str(i), f"n{i % 17}", [f"n{(i * 7 + j) % 17}" for j in range(4)]) for i in range(40)])
    at = spark.createDataFrame([("3",), ("39",), ("39",), ("gone",)], "id string")
    some = {"3", "39"}
    want = sorted(tuple(r) for r in graph.edges(u).collect() if {r.src, r.dst} & some)
    assert want and sorted(map(tuple, graph.edges(u, at=at).collect())) == want
