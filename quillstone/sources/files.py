"""Directory discovery, JSON and JSONL files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: Fixed values.
EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx")
EXCLUDED_DIRS = ("tests", "test", "venv", ".venv", "__pycache__", "migrations", "node_modules", ".git", "dist", "build")
MAX_FILE_BYTES, MAX_FILES, MAX_REPO_KB = 1 << 20, 10_000, 204_800


class TooLarge(ValueError):
    pass


def glob_regex(pattern: str) -> str:
    """A wildmatch pattern as a regular expression over a path; directories end in a slash."""
    anchored = "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
            continue
        if c == "*":
            while i + 1 < len(body) and body[i + 1] == "*":
                i += 1
            alone = (i + 1 == len(body) or body[i + 1] == "/") and (not out or out.endswith("/"))
            out += "[^/]+" if alone else "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(body):
            i += 1
            out += re.escape(body[i])
        else:
            out += re.escape(c)
        i += 1
    tail = "/.*" if pattern.endswith("/") else "(?:/.*)?"
    return ("^" if anchored else "^(?:.*/)?") + out + tail + "$"


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(keeps, regex) of an ignore file, in order: the last that matches decides."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        rules.append((keeps, glob_regex(line[1:] if keeps else line.removeprefix("\\"))))
    return rules


def ignored(path: str, rules: list[tuple[bool, str]]) -> bool:
    hit = False
    for keeps, rule in rules:
        if re.match(rule, path, re.S):
            hit = not keeps
    return hit


def discover(root: str, *, extensions: tuple[str, ...] = EXTENSIONS, excluded: tuple[str, ...] = EXCLUDED_DIRS, max_bytes: int = MAX_FILE_BYTES, max_files: int = MAX_FILES) -> list[tuple[str, str, int]]:
    """(path, relative path, bytes) of the source files of a local directory, in order of their paths.

    Spark's own file sources hide names that begin with an underscore or a dot, so the listing
    is made here; it reads metadata only and stops at `max_files`.
    """
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            rules = ignore_rules(f.read())
    except (OSError, UnicodeDecodeError):
        rules = []
    found = []
    for here, dirs, names in os.walk(root):
        rel = os.path.relpath(here, root)
        place = lambda name: name if rel == "." else f"{rel}/{name}"  # noqa: E731, B023
        dirs[:] = sorted(d for d in dirs if d not in excluded and not d.startswith(".") and not ignored(place(d) + "/", rules))
        for name in sorted(names):
            path = os.path.join(here, name)
            if not name.endswith(extensions) or ignored(place(name), rules):
                continue
            try:
                size = os.stat(path).st_size
            except OSError:
                continue
            if size <= max_bytes:
                found.append((path, place(name), size))
                if len(found) >= max_files:
                    return found
    return found


def check_size(found: list[tuple[str, str, int]], max_kb: int = MAX_REPO_KB) -> None:
    total = sum(size for *_, size in found) // 1024
    if total > max_kb:
        raise TooLarge(f"{total} KB are more than {max_kb} KB")


def read_files(spark: SparkSession, found: list[tuple[str, str, int]], per_task: int = 200) -> DataFrame:
    """schemas.FILES of a listing; contents are read where the task runs, unreadable files are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 32):
                part = batch.iloc[at : at + 32]
                contents = []
                for path in part.path:
                    try:
                        with open(path, "rb") as f:
                            contents.append(f.read())
                    except OSError:
                        contents.append(None)
                yield pd.DataFrame({"rel_path": part.rel_path, "length": part.length, "content": contents})

    listing = spark.createDataFrame(found, "path string, rel_path string, length bigint")
    return listing.repartition(max(1, -(-len(found) // per_task)), "rel_path").mapInPandas(run, schemas.FILES)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines that are not blank."""
    return spark.read.text(path).where(F.rlike("value", F.lit(r"\S"))).agg(F.count("*").alias("n"))


def read_result(spark: SparkSession, path: str, schema: str, *, strict: bool = False) -> DataFrame:
    """A result file as one row; where it is missing or malformed, a row of nulls, or an error if `strict`."""
    from pyspark.errors import AnalysisException

    empty = spark.createDataFrame([()], "").select(F.from_json(F.lit(None).cast("string"), schema).alias("r")).select("r.*")
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        if strict:
            raise
        return empty
    rows = text.select(F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r")).select("r.*")
    return rows


def write_splits(rows: DataFrame, path: str, split_col: str = "split") -> None:
    """JSON lines, one folder a split."""
    rows.write.mode("overwrite").partitionBy(split_col).json(path)


def write_json(row: DataFrame, path: str) -> None:
    """A one-row frame as a pretty JSON file with sorted keys."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(json.loads(row.toJSON().first()), indent=2, sort_keys=True) + "\n")
