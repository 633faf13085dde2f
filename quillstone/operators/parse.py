"""Source files to units: functions and classes with their calls, docstrings and imports.

Python files go through the standard library's syntax tree, or, where they do not parse, an
indentation scan. JavaScript and TypeScript go through a tokenizer that knows strings,
templates, comments and regular expressions, and recognises declarations only.
"""

from __future__ import annotations

import ast
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas


@dataclass
class Unit:
    name: str
    type: str
    start_line: int
    end_line: int
    source: str
    docstring: str = ""
    calls: list[str] = field(default_factory=list)


def _unquoted(literal: str) -> str:
    for quote in ('"', "'", '"', "'"):
        literal = literal.strip(quote)
    return literal.strip()


# Python


class _PythonFile:
    def __init__(self, code: str):
        self.lines = code.splitlines(keepends=True)
        self.raw = [line.encode() for line in self.lines]
        self.units: list[Unit] = []

    def text(self, node: ast.AST) -> str:
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.raw[first][node.col_offset : node.end_col_offset].decode(errors="replace")
        return b"".join([self.raw[first][node.col_offset :], *self.raw[first + 1 : last], self.raw[last][: node.end_col_offset]]).decode(errors="replace")

    def docstring(self, body: list[ast.stmt]) -> str:
        for s in body:
            if isinstance(s, ast.Expr) and (isinstance(s.value, ast.JoinedStr) or isinstance(s.value, ast.Constant) and isinstance(s.value.value, str | bytes)):
                return _unquoted(self.text(s.value))
        return ""

    def visit(self, node: ast.stmt, prefix: str | None) -> None:
        if getattr(node, "decorator_list", None):
            return
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            name = f"{prefix}.{node.name}" if prefix else node.name
            self.units.append(Unit(name, "function", node.lineno, node.end_lineno, self.text(node), self.docstring(node.body), list(dict.fromkeys(n for s in node.body for n in _python_calls(s)))))
        elif isinstance(node, ast.ClassDef):
            self.units.append(Unit(node.name, "class", node.lineno, node.end_lineno, self.text(node), self.docstring(node.body)))
            prefix = node.name
        else:
            return
        for child in node.body:
            self.visit(child, prefix)


def _python_calls(node: ast.AST) -> Iterator[str]:
    """Called names, an outer call before the calls within it, else in order of the text."""
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name):
                yield n.func.id
            elif isinstance(n.func, ast.Attribute):
                yield n.func.attr
        children = list(ast.iter_child_nodes(n))
        children.sort(key=lambda c: (getattr(c, "lineno", 0), getattr(c, "col_offset", -1)))
        stack += reversed(children)


_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)")
_CALLED = re.compile(r"([A-Za-z_]\w*)[ \t]*\(")
_PYTHON_WORDS = {"if", "while", "for", "return", "and", "or", "not", "in", "is", "def", "class", "lambda", "with", "elif", "assert", "yield", "await", "print_"}


def _python_by_indent(code: str) -> list[Unit]:
    """Units of a file that does not parse: a definition reaches to the next line that is not deeper."""
    lines, units, open_classes = code.splitlines(), [], []
    for i, line in enumerate(lines):
        m = _DEF.match(line)
        if not m or i and lines[i - 1].lstrip().startswith("@"):
            continue
        depth, end = len(m[1]), i
        for j in range(i + 1, len(lines)):
            if lines[j].strip():
                if len(lines[j]) - len(lines[j].lstrip()) <= depth:
                    break
                end = j
        open_classes = [(d, n) for d, n in open_classes if d < depth]
        body = lines[i + 1 : end + 1]
        if m[2] == "class":
            units.append(Unit(m[3], "class", i + 1, end + 1, "\n".join(lines[i : end + 1])))
            open_classes.append((depth, m[3]))
        elif body:
            name = f"{open_classes[-1][1]}.{m[3]}" if open_classes else m[3]
            calls = [c for line in body for c in _CALLED.findall(line.split("#")[0]) if c not in _PYTHON_WORDS]
            units.append(Unit(name, "function", i + 1, end + 1, "\n".join(lines[i : end + 1]), "", list(dict.fromkeys(calls))))
    return units


def parse_python(code: str) -> tuple[list[Unit], list[str]]:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_indent(code), [line.strip() for line in code.splitlines() if re.match(r"(import|from(?! __future__))\s", line)]
    file = _PythonFile(code)
    imports = [file.text(n).strip() for n in tree.body if isinstance(n, ast.Import) or isinstance(n, ast.ImportFrom) and n.module != "__future__"]
    for node in tree.body:
        file.visit(node, None)
    return file.units, imports


# JavaScript and TypeScript

_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|\?\.|\.\.\.|[^\s\w])",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_JS_WORDS = frozenset("if for while switch catch return function typeof void delete in of instanceof new super import await yield throw case do else class const let var async with export default".split())
_PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass
class _Token:
    kind: str
    text: str
    at: int
    end: int


def _tokens(code: str) -> list[_Token]:
    out: list[_Token] = []
    at = 0
    while at < len(code):
        c = code[at]
        if c == "`":
            end = _template_end(code, at)
            out.append(_Token("string", code[at:end], at, end))
            at = end
            continue
        before = out[-1] if out else None
        if c == "/" and (before is None or before.kind == "sign" and before.text not in (")", "]", "}") or before.text in ("return", "typeof", "case")):
            if (m := _REGEX.match(code, at)) and not code.startswith(("//", "/*"), at):
                out.append(_Token("string", m[0], at, m.end()))
                at = m.end()
                continue
        m = _TOKEN.match(code, at)
        if m is None:
            at += 1
            continue
        if m.lastgroup != "space":
            out.append(_Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return out


def _template_end(code: str, at: int) -> int:
    at += 1
    while at < len(code):
        if code[at] == "\\":
            at += 2
        elif code[at] == "`":
            return at + 1
        elif code.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(code) and depth:
                if code[at] == "`":
                    at = _template_end(code, at)
                    continue
                depth += {"{": 1, "}": -1}.get(code[at], 0)
                at += 1
        else:
            at += 1
    return len(code)


class _ScriptFile:
    def __init__(self, code: str):
        self.code, self.t = code, _tokens(code)
        self.units: list[Unit] = []
        self.imports: list[str] = []
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if t.kind != "sign":
                continue
            if t.text in _PAIRS:
                stack.append(i)
            elif stack and t.text == _PAIRS[self.t[stack[-1]].text]:
                self.close[stack.pop()] = i
        for i in stack:
            self.close[i] = len(self.t)
        self.starts = [0, *(m.end() for m in re.finditer("\n", code))]

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].text in texts

    def word(self, i: int) -> str | None:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind == "word" else None

    def line(self, at: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.starts, at)

    def span(self, i: int, j: int) -> str:
        """Source from token i up to and with token j - 1."""
        return self.code[self.t[i].at : self.t[min(j, len(self.t)) - 1].end]

    def emit(self, kind: str, name: str, i: int, end: int, body: tuple[int, int] | None) -> None:
        first, last = self.t[i].at, self.t[min(end, len(self.t)) - 1].end
        doc, calls = "", []
        if body:
            lo, hi = body
            at = lo
            while at < hi:
                stop = self.statement_end(at, hi)
                if self.t[at].kind == "string" and stop - at <= 2 and not self.t[at].text.startswith(("/", "`")):
                    doc = _unquoted(self.t[at].text)
                    break
                at = max(stop, at + 1)
            if kind == "function":
                calls = list(dict.fromkeys(self.calls(lo, hi)))
        self.units.append(Unit(name, kind, self.line(first), self.line(max(first, last - 1)), self.code[first:last], doc, calls))

    def calls(self, lo: int, hi: int) -> Iterator[str]:
        i = lo
        while i < hi:
            made = self.is_(i, "new")
            start = i + 1 if made else i
            word = self.word(start) if start < hi else None
            if word is None or word in _JS_WORDS and word != "import" or self.is_(i - 1, "function", "class"):
                i += 1
                continue
            parts: list[tuple[str | None, int, int]] = []
            name: str | None = word if word != "import" else None
            j = start + 1
            while j < hi:
                if self.is_(j, "("):
                    end = min(self.close[j], hi)
                    if self.is_(end + 1, "{") and not self.is_(i - 1, "=", "(", ",", "return", "=>"):  # a method of an object or class
                        name = None
                    parts.append((None if made else name, j + 1, end))
                    name, made, j = None, False, end + 1
                elif self.is_(j, "[") or self.is_(j, "?.") and self.is_(j + 1, "["):
                    j += self.is_(j, "?.")
                    parts.append((None, j + 1, min(self.close[j], hi)))
                    name, j = None, min(self.close[j], hi) + 1
                elif self.is_(j, ".", "?.") and self.word(j + 1):
                    name, j = self.word(j + 1), j + 2
                elif self.is_(j, "?.") and self.is_(j + 1, "("):
                    j += 1
                else:
                    break
            # the last call is the outermost
            yield from (n for n, _, _ in reversed(parts) if n)
            for _, a, b in parts:
                yield from self.calls(a, b)
            i = max(j, i + 1)

    def statement_end(self, i: int, hi: int) -> int:
        """Just past a statement without a block of its own: a semicolon, or a line's end where nothing is open."""
        j = i
        while j < hi:
            if self.is_(j, ";"):
                return j + 1
            if j > i and "\n" in self.code[self.t[j - 1].end : self.t[j].at] and not (self.t[j - 1].kind == "sign" and self.t[j - 1].text not in (")", "]", "}")) and not (self.t[j].kind == "sign" and self.t[j].text not in ("{", "[", "(", "@", "#")):
                return j
            j = self.close[j] + 1 if j in self.close else j + 1
        return hi

    def block_after(self, i: int, hi: int) -> int | None:
        """The brace that opens a body, past parameters and a TypeScript result type."""
        while i < hi and not self.is_(i, "{", ";"):
            i = self.close[i] + 1 if i in self.close else i + 1
        return i if self.is_(i, "{") else None

    def statements(self, lo: int, hi: int, prefix: str | None, root: bool = False) -> None:
        i = lo
        while i < hi:
            start = i
            if root and self.is_(i, "import") and not self.is_(i + 1, "(", "."):
                end = self.statement_end(i, hi)
                self.imports.append(self.span(i, end).strip())
                i = max(end, start + 1)
                continue
            while self.is_(i, "export", "default", "declare", "abstract"):
                i += 1
            is_async = self.is_(i, "async") and self.is_(i + 1, "function")
            if self.is_(i + is_async, "function") and self.word(i + is_async + 1):
                i = self.function(i, i + is_async + 1, hi, prefix)
            elif self.is_(i, "class") and self.word(i + 1):
                i = self.class_(i, hi)
            elif self.is_(i, "const", "let"):
                end = self.statement_end(i, hi)
                if root and start == i:
                    self.imports.append(self.span(i, end).strip())
                self.declaration(i + 1, end, prefix)
                i = end
            else:
                i = self.skip(i, hi)
            i = max(i, start + 1)

    def skip(self, i: int, hi: int) -> int:
        """Past a statement that holds no unit, with its blocks."""
        while i < hi:
            if self.is_(i, ";"):
                return i + 1
            if self.is_(i, "{"):
                i = self.close[i] + 1
                if not self.is_(i, ")", ",", ".", "else", "catch", "finally", "while", ";", "("):
                    return i
                continue
            i = self.close[i] + 1 if i in self.close else i + 1
            if 0 < i < hi and "\n" in self.code[self.t[i - 1].end : self.t[i].at] and not self.is_(i, ".", "{", "?.") and not (self.t[i - 1].kind == "sign" and self.t[i - 1].text not in (")", "]", "}")):
                return i
        return hi

    def function(self, i: int, name: int, hi: int, prefix: str | None) -> int:
        brace = self.block_after(name + 1, hi)
        if brace is None:
            return self.statement_end(i, hi)
        end = self.close[brace]
        own = self.word(name)
        self.emit("function", f"{prefix}.{own}" if prefix else own, i, end + 1, (brace + 1, end))
        self.statements(brace + 1, end, prefix)
        return end + 1

    def class_(self, i: int, hi: int) -> int:
        brace = self.block_after(i + 2, hi)
        if brace is None:
            return self.statement_end(i, hi)
        end, name = self.close[brace], self.word(i + 1)
        self.emit("class", name, i, end + 1, None)
        j = brace + 1
        while j < end:
            start = j
            while self.is_(j, "static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "*") and not self.is_(j + 1, "(", "="):
                j += 1
            if (self.word(j) or self.is_(j, "#")) and (self.is_(j + 1, "(", "<") or self.is_(j, "#") and self.is_(j + 2, "(")):
                at = j + 1 if self.is_(j, "#") else j
                body = self.block_after(at + 1, end)
                if body is not None:
                    stop = self.close[body]
                    own = ("#" if at > j else "") + self.word(at)
                    self.emit("function", f"{name}.{own}", start, stop + 1, (body + 1, stop))
                    self.statements(body + 1, stop, name)
                    j = stop + 1
                    continue
            j = max(self.statement_end(j, end), start + 1)
        return end + 1

    def declaration(self, lo: int, hi: int, prefix: str | None) -> None:
        i = lo
        while i < hi:
            name, j = self.word(i), i + 1
            while j < hi and not self.is_(j, "=", ",", ";"):
                j = self.close[j] + 1 if j in self.close else j + 1
            if name and self.is_(j, "="):
                self.arrow(name, j + 1, hi, prefix)
            while j < hi and not self.is_(j, ",", ";"):
                j = self.close[j] + 1 if j in self.close else j + 1
            i = j + 1

    def arrow(self, name: str, i: int, hi: int, prefix: str | None) -> None:
        j = i + self.is_(i, "async")
        if self.is_(j, "("):
            j = self.close[j] + 1
            while j < hi and not self.is_(j, "=>", ";", ","):  # a result type
                j = self.close[j] + 1 if j in self.close else j + 1
        elif self.word(j):
            j += 1
        if not self.is_(j, "=>"):
            return
        body, end = j + 1, j + 1
        if self.is_(body, "{"):
            end = self.close[body] + 1
            inner = (body + 1, end - 1)
        else:
            while end < hi and not self.is_(end, ",", ";"):
                end = self.close[end] + 1 if end in self.close else end + 1
            inner = (body, end)
        self.emit("function", f"{prefix}.{name}" if prefix else name, i, end, inner)
        if self.is_(body, "{"):
            self.statements(*inner, prefix)


def parse_script(code: str) -> tuple[list[Unit], list[str]]:
    file = _ScriptFile(code)
    try:
        file.statements(0, len(file.t), None, root=True)
    except (IndexError, KeyError, RecursionError):
        pass  # units found so far stay
    return file.units, file.imports


def parse_source(path: str, content: bytes) -> tuple[list[Unit], list[str]]:
    """Units and imports of a file, by its extension in any case; none for other files."""
    suffix = os.path.splitext(path)[1].lower()
    code = bytes(content).decode("utf-8", errors="replace")
    if suffix == ".py":
        return parse_python(code)
    if suffix in (".js", ".ts", ".jsx", ".tsx"):
        return parse_script(code)
    return [], []


def unit_table():
    """A table function of a path and a file's bytes: name, type, start_line, end_line, docstring, calls of its units."""

    @F.udtf(returnType="name string, type string, start_line int, end_line int, docstring string, calls array<string>")
    class Units:
        def eval(self, path: str, content: bytes):
            for u in parse_source(path, content or b"")[0] if path else []:
                yield u.name, u.type, u.start_line, u.end_line, u.docstring, u.calls

    return Units


def parse_units(files: DataFrame, repo_id: str | Column) -> DataFrame:
    """schemas.UNITS from files (rel_path, content); a file that cannot be read gives no row."""
    columns = [c.split()[0] for c in schemas.UNITS.replace(", ", ",").split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, path, content in zip(batch.repo_id, batch.rel_path, batch.content, strict=True):
                if content is None:
                    continue
                units, imports = parse_source(path, content)
                for u in units:
                    rows.append((f"{repo}::{path}::{u.name}::{u.start_line}", repo, u.name, path, u.type, u.start_line, u.end_line, u.source, u.docstring, u.calls, imports))
            yield pd.DataFrame(rows, columns=columns)

    repo = F.lit(repo_id) if isinstance(repo_id, str) else repo_id
    return files.select(repo.alias("repo_id"), "rel_path", "content").mapInPandas(run, schemas.UNITS)


def file_summaries(units: DataFrame, first: int = 30) -> DataFrame:
    """One `file` unit for each file with units: its path and its first unit names, in order."""
    seq = F.struct("start_line", "id", "name")
    named = units.groupBy("repo_id", "file").agg(F.slice(F.array_sort(F.collect_list(seq)), 1, first).alias("s"), F.any_value("imports").alias("imports"))
    text = F.concat(F.lit("File: "), F.col("file"), F.lit("\nContains: "), F.array_join(F.transform("s", lambda x: x["name"]), ", "))
    return named.select(F.concat_ws("::", "repo_id", F.lit("FILE"), "file").alias("id"), "repo_id", F.col("file").alias("name"), "file", F.lit("file").alias("type"), F.lit(1).alias("start_line"), F.lit(0).alias("end_line"), text.alias("source"), F.lit("").alias("docstring"), F.array().cast("array<string>").alias("calls"), "imports")


def sequenced(units: DataFrame) -> DataFrame:
    """`units` with `seq`, a number that grows with file, line and id; the order in which later units win names.

    A range partition by that order numbers rows without bringing them together.
    """
    ordered = units.repartitionByRange("file", "start_line", "id").sortWithinPartitions("file", "start_line", "id")
    return ordered.withColumn("seq", F.monotonically_increasing_id())
