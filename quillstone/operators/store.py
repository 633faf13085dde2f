"""Keyed chunk store and catalogue tables over Parquet.

A store is a folder of chunks by repository and collection, in hash buckets of their ids. A
catalogue table is a folder of numbered versions: a change is one write of the next version,
which counts once Spark's committer has marked it as whole. A write that fails leaves the
version before it, and readers of that one are not disturbed; the version before it is removed.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..sources.scratch import kept

COLLECTIONS = ("_functions", "_classes", "_files")
BATCH = 100


def _numbered(spark: SparkSession, path: str) -> dict[int, bool]:
    """The versions at `path`, and whether each is whole."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(x.getPath().getName()) for x in fs.listStatus(p)] if fs.exists(p) else []
    return {int(n[1:]): bool(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))) for n in names if re.fullmatch(r"v[0-9]{10}", n)}


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of a table's last whole version."""
    whole = [n for n, ok in _numbered(spark, path).items() if ok]
    return f"{path}/v{max(whole):010d}" if whole else None


def replace(path: str, rows: DataFrame) -> None:
    """Writes the next version of a table; `rows` may come from the last one."""
    spark = rows.sparkSession
    known = _numbered(spark, path)
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/v{max(known, default=0) + 1:010d}")
    for n in sorted((n for n, ok in known.items() if ok))[:-1]:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n:010d}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and of `old` those that `new` does not replace."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def patched(old: DataFrame, patch: DataFrame, keys: list[str], fields: list[str], stamp: str | None = "updated_at") -> DataFrame:
    """`old` with those fields of `patch` that are not null; touched rows get a new time stamp."""
    p = patch.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_hit"))
    rows = old.join(p, keys, "left")
    out = []
    for c in old.columns:
        if c in fields:
            out.append(F.coalesce(f"_{c}", c).alias(c))
        elif c == stamp:
            out.append(F.when(F.col("_hit"), F.current_timestamp()).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out)


class Conflict(RuntimeError):
    """Another writer has committed first."""


class ChunkStore:
    """get or create, upsert, get by ids or metadata, count, delete.

    Rows lie in hash buckets of their ids. A write of a collection is a folder of the buckets
    that it touches; a repository's pointer, one small file, names the folder of every bucket of
    all its collections. A new pointer is renamed into place once all that it names is written,
    so readers, who look at the last pointer first, see all of a change or nothing. Files of the
    pointer before stay for those who read by it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets
        fields = [f for f in spark.createDataFrame([], schemas.CHUNKS).schema.fields if f.name not in ("repo_id", "collection")]
        self.schema = T.StructType(fields)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _remove(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.delete(p, True)

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(str(x.getPath().getName()) for x in fs.listStatus(p)) if fs.exists(p) else []

    def _pointers(self, repo_id: str) -> list[int]:
        return [int(n[1:]) for n in self._names(f"{self.path}/repo_id={repo_id}/pointers") if re.fullmatch(r"p[0-9]{10}", n)]

    def _pointer(self, repo_id: str, number: int) -> dict[str, dict[str, str]]:
        """By collection, the folder of each bucket that has rows."""
        fs, p = self._fs(f"{self.path}/repo_id={repo_id}/pointers/p{number:010d}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _last(self, repo_id: str) -> tuple[int, dict[str, dict[str, str]]]:
        known = self._pointers(repo_id)
        return (known[-1], self._pointer(repo_id, known[-1])) if known else (0, {})

    def _commit(self, repo_id: str, before: int, told: dict[str, dict[str, str]]) -> None:
        """Renames the next pointer into place, then removes what only pointers before the last one name."""
        here = f"{self.path}/repo_id={repo_id}/pointers"
        fs, draft = self._fs(f"{here}/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(told, sort_keys=True).encode()))
        out.close()
        _, place = self._fs(f"{here}/p{before + 1:010d}")
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise Conflict(repo_id)
        places = lambda pointer: {(c, b, w) for c, own in pointer.items() for b, w in own.items()}
        keep = places(told) | (places(self._pointer(repo_id, before)) if before else set())
        for number in [n for n in self._pointers(repo_id) if n < before]:
            for c, b, w in places(self._pointer(repo_id, number)) - keep:
                self._remove(f"{self.path}/repo_id={repo_id}/collection={c}/{w}/bucket={b}")
            self._remove(f"{here}/p{number:010d}")

    def _bucket(self, id_col: str = "id") -> Column:
        return F.pmod(F.xxhash64(id_col), F.lit(self.buckets)).cast("int")

    def _read(self, repo_id: str, suffix: str, own: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/repo_id={repo_id}/collection={suffix}/{w}/bucket={b}" for b, w in sorted(own.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _written(self, repo_id: str, suffix: str, own: dict[str, str], rows: DataFrame) -> dict[str, str]:
        """Writes `rows`, and what their buckets held besides; the folders of all buckets after that."""
        rest = [c for c in self.schema.names if c != "id"]
        new = rows.select("id", F.struct(*rest).alias("r")).groupBy("id").agg(F.max("r").alias("r")).select("id", "r.*").select(*self.schema.names)
        write = f"w{uuid.uuid4().hex}"
        here = f"{self.path}/repo_id={repo_id}/collection={suffix}/{write}"
        put = lambda df: df.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(here)
        try:
            put(new)
            touched = {n.removeprefix("bucket=") for n in self._names(here) if n.startswith("bucket=")}
            old = {b: w for b, w in own.items() if b in touched}
            if old:
                put(self._read(repo_id, suffix, old).join(self._read(repo_id, suffix, dict.fromkeys(touched, write)).select("id"), "id", "left_anti"))
        except Exception:
            self._remove(here)
            raise
        return own | dict.fromkeys(touched, write)

    def collection(self, repo_id: str, suffix: str) -> DataFrame:
        """A collection's rows; one that does not exist is empty."""
        return self._read(repo_id, suffix, self._last(repo_id)[1].get(suffix, {}))

    def collections(self, repo_id: str) -> dict[str, DataFrame]:
        """All collections as one pointer names them."""
        return {c: self._read(repo_id, c, own) for c, own in self._last(repo_id)[1].items()}

    def upsert(self, repo_id: str, suffix: str, rows: DataFrame) -> None:
        """Of rows that repeat an id, the one with the largest values counts. Only buckets of the rows' ids are read and written."""
        self.replace_all(repo_id, {suffix: rows})

    def get(self, repo_id: str, suffix: str, ids: DataFrame) -> DataFrame:
        """Rows of the given ids; other buckets than theirs are not read."""
        own = self._last(repo_id)[1].get(suffix, {})
        asked = {str(r.b) for r in ids.select(self._bucket().alias("b")).distinct().collect()}  # at most a number for each bucket
        return self._read(repo_id, suffix, {b: w for b, w in own.items() if b in asked}).join(ids.select("id"), "id", "left_semi")

    def where(self, repo_id: str, suffix: str, condition: Column) -> DataFrame:
        """Rows by metadata; the predicate reaches the scan."""
        return self.collection(repo_id, suffix).where(condition)

    def count(self, repo_id: str, suffix: str) -> int:
        return self.collection(repo_id, suffix).count()

    def delete(self, repo_id: str) -> None:
        self._remove(f"{self.path}/repo_id={repo_id}/pointers")  # readers find nothing from here on
        self._remove(f"{self.path}/repo_id={repo_id}")

    def replace_all(self, repo_id: str, parts: dict[str, DataFrame]) -> None:
        """Upserts several collections in one commit: readers see all of them before it or all after it, and a failure changes nothing."""
        number, told = self._last(repo_id)
        told = dict(told)
        done: list[str] = []
        try:
            for suffix, rows in parts.items():
                told[suffix] = self._written(repo_id, suffix, told.get(suffix, {}), rows)
                done.append(suffix)
            self._commit(repo_id, number, told)
        except Exception:
            before = self._last(repo_id)[1]
            for suffix in done:
                for w in set(told[suffix].values()) - set(before.get(suffix, {}).values()):
                    self._remove(f"{self.path}/repo_id={repo_id}/collection={suffix}/{w}")
            raise


def batch_plan(groups: DataFrame, by: str, n: str, size: int = BATCH) -> DataFrame:
    """Each group's number of batches of at most `size` rows."""
    return groups.select(by, n, F.ceil(F.col(n) / F.lit(size)).cast("long").alias("batches"))


def running_total(rows: DataFrame, order: str, value: str, name: str, parts: int = 64) -> DataFrame:
    """`rows` with `name`, the sum of `value` over all rows before, by `order`, whose values are distinct; nulls are first.

    Rows are cut into ranges of `order`. Each range is summed in its own task, and only the sums of
    the ranges, at most `parts` numbers, pass through one.
    """
    ranged = kept(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    summed = ranged.withColumn("_own", own).join(F.broadcast(earlier), F.col("_part") == F.col("_p"))
    return summed.withColumn(name, F.coalesce("_own", F.lit(0)) + F.col("_earlier")).drop("_part", "_p", "_own", "_earlier")


def numbered(rows: DataFrame, by: str, order: str, name: str, parts: int = 64) -> DataFrame:
    """`rows` with `name`, the place of each in its `by`, from 0, by `order`, whose values are distinct.

    Rows are cut into ranges of both columns and numbered range by range; only the counts of
    groups in ranges, at most groups + `parts` numbers, pass through one task. The rows travel, so they
    should be narrow.
    """
    ranged = kept(rows.repartitionByRange(parts, by, order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), earlier.alias("_earlier"))
    own = F.row_number().over(Window.partitionBy(by, "_part").orderBy(order)) - 1
    placed = ranged.withColumn("_own", own).join(F.broadcast(counts), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn(name, F.col("_own") + F.col("_earlier")).drop("_part", "_p", "_by", "_own", "_earlier")


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key, by the given columns; one aggregate, no sort of a key's history."""
    rest = [c for c in events.columns if c not in (key, *order)]
    last = events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("e"))
    return last.select(key, *[F.col(f"e.{c}").alias(c) for c in (*order, *rest)]).select(*events.columns)


def violations(repos: DataFrame, tasks: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """(rule, id) of rows that break the catalogue's constraints."""
    double = repos.groupBy("github_url").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select(F.lit("unique_url").alias("rule"), "id")
    out = double.union(repos.where(~F.col("status").isin(*schemas.REPO_STATUS)).select(F.lit("repo_status"), "id"))
    out = out.union(tasks.where(~F.col("status").isin(*schemas.TASK_STATUS)).select(F.lit("task_status"), "id"))
    out = out.union(tasks.join(repos.select(F.col("id").alias("repo_id")), "repo_id", "left_anti").select(F.lit("task_repo"), "id"))
    if messages is not None:
        out = out.union(messages.where(~F.col("role").isin("user", "assistant")).select(F.lit("message_role"), "id"))
        out = out.union(messages.where(F.col("retrieval_mode").isNotNull() & ~F.col("retrieval_mode").isin("naive", "graph")).select(F.lit("message_mode"), "id"))
    return out


def cascade_delete(repo_ids: DataFrame, repos: DataFrame, tasks: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the given repositories: tasks go with them, messages lose the reference."""
    gone = repo_ids.select(F.col("id").alias("_gone")).distinct()
    left = repos.join(gone, repos["id"] == gone["_gone"], "left_anti")
    work = tasks.join(gone, tasks["repo_id"] == gone["_gone"], "left_anti")
    said = messages.join(gone, messages["repo_id"] == gone["_gone"], "left")
    said = said.withColumn("repo_id", F.when(F.col("_gone").isNull(), F.col("repo_id"))).drop("_gone")
    return left, work, said


def repo_summary(repos: DataFrame) -> DataFrame:
    """Newest first: name (else the URL's last segment), status, and counts that default to 0."""
    s = F.from_json("stats", schemas.STATS)
    count = lambda f: F.coalesce(s[f], F.lit(0)).alias(f)
    name = F.coalesce("name", F.element_at(F.split("github_url", "/"), -1)).alias("name")
    return repos.orderBy(F.desc("created_at"), "id").select("id", name, "github_url", "status", F.struct(count("files"), count("functions"), count("classes"), count("edges")).alias("stats"), "created_at")


def missing_required(required: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return required.select(key).distinct().join(found.select(key), key, "left_anti")


def latest_numbered(paths: DataFrame, path_col: str, *by: str) -> DataFrame:
    """Of each group, the path with the largest number at its end; paths without one do not count."""
    number = F.try_element_at(F.regexp_extract_all(path_col, F.lit(r"-([0-9]{1,18})/?$"), F.lit(1)), F.lit(1)).cast("long")
    return paths.withColumn("_n", number).where("_n is not null").groupBy(*by).agg(F.max_by(path_col, "_n").alias(path_col))
