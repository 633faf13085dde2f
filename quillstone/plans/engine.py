"""The engine's surface: ingest, retrieve, prompts, catalogue and health over one folder."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import embed, text
from ..operators import graph, parse, retrieve, store
from ..sources import files
from ..streaming import jobs


class Busy(RuntimeError):
    """The repository is being worked on."""


class Known(RuntimeError):
    """The repository is there already."""


class Engine:
    """Tables under `path`: repos, task_events, units, edges, vectors, and the chunk store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.chunks = store.ChunkStore(spark, f"{self.path}/chunks")

    # tables

    def _there(self, name: str) -> bool:
        return store.current(self.spark, f"{self.path}/{name}") is not None

    def _table(self, name: str, schema: str) -> DataFrame:
        path = store.current(self.spark, f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def _replace(self, name: str, rows: DataFrame) -> None:
        store.replace(f"{self.path}/{name}", rows)

    def repos(self) -> DataFrame:
        return self._table("repos", schemas.REPOS)

    def task_events(self) -> DataFrame:
        return self._table("task_events", schemas.TASKS)

    def tasks(self) -> DataFrame:
        """The last state of each task."""
        return store.latest(self.task_events(), "id", "updated_at")

    def task_status(self, task_id: str) -> DataFrame:
        percent = text.progress_percent(F.col("stage"), F.col("current_step"), F.col("total_steps"))
        return self.tasks().where(F.col("id") == task_id).withColumn("percent", percent)

    def list_repos(self, status: str | None = None) -> DataFrame:
        """Summaries, newest first; of one status only, if it is given."""
        repos = self.repos()
        return store.repo_summary(repos if status is None else repos.where(F.col("status") == status))

    def progress_stream(self, task_id: str | None = None, *, timed: bool = True) -> DataFrame:
        """A stream of the changes of tasks (see `jobs.progress`), of one task only, if it is given."""
        here = store.current(self.spark, f"{self.path}/task_events")
        if here is None:
            raise KeyError("no task yet")
        events = self.spark.readStream.schema(schemas.TASKS).parquet(here)
        events = events if task_id is None else events.where(F.col("id") == task_id)
        return jobs.progress(events.select(F.col("id").alias("task"), F.unix_micros("updated_at").alias("seq"), "stage", "current_step", "status"), timed)

    def health(self) -> dict[str, str]:
        """ok, if Spark answers and the store's folder can be listed; else degraded."""
        try:
            ok = self.spark.sql("SELECT 1 AS one").first().one == 1
            store.current(self.spark, f"{self.path}/repos")
        except Exception:
            ok = False
        return {"status": "ok" if ok else "degraded"}

    # ingest

    def _note(self, task: str, repo: str, stage: str, step: int, total: int, status: str = "running") -> None:
        now = datetime.now(UTC)
        row = self.spark.createDataFrame([(task, repo, stage, step, total, status, now, now)], schemas.TASKS)
        here = store.current(self.spark, f"{self.path}/task_events")
        if here:
            row.coalesce(1).write.mode("append").parquet(here)
        else:
            self._replace("task_events", row.coalesce(1))

    def _status(self, repo: str, **fields: str) -> None:
        names = list(fields)
        patch = self.spark.createDataFrame([(repo, *fields.values())], "id string, " + ", ".join(f"{n} string" for n in names))
        self._replace("repos", store.patched(self.repos(), patch, ["id"], names))

    def ingest(self, directory: str, url: str, name: str | None = None) -> tuple[str, str]:
        """Reads a local checkout into tables; returns the ids of the repository and the task."""
        old = self.repos().where(F.col("github_url") == url).select("id", "status").first()
        if old is not None:
            if old.status == "complete":
                raise Known(url)
            self.delete_repo(old.id, force=True)
        repo, task, now = str(uuid.uuid4()), str(uuid.uuid4()), datetime.now(UTC)
        row = self.spark.createDataFrame([(repo, url, name or url.rstrip("/").split("/")[-1], "queued", None, None, None, None, now, now)], schemas.REPOS)
        self._replace("repos", self.repos().unionByName(row))
        try:
            self._note(task, repo, "discovering", 1, 6)
            found = files.discover(directory)
            files.check_size(found)
            self._status(repo, status="parsing")
            self._note(task, repo, "parsing", 2, 6)
            units = parse.parse_units(files.read_files(self.spark, found), repo)
            here = f"{self.path}/units/repo_id={repo}"
            units.drop("repo_id").write.mode("overwrite").parquet(here)
            units = parse.sequenced(self.spark.read.parquet(here).withColumn("repo_id", F.lit(repo)))
            self._status(repo, status="graphing")
            self._note(task, repo, "graph", 3, 6)
            edges = graph.edges(units)
            edges.write.mode("overwrite").parquet(f"{self.path}/edges/repo_id={repo}")
            self._status(repo, status="storing")
            self._note(task, repo, "storing", 4, 6)
            chunk = lambda u: u.withColumn("document", text.document()).select("id", "document", "name", "file", "type", "start_line", "end_line", "calls")
            parts = {"_functions": chunk(units.where("type = 'function'")), "_classes": chunk(units.where("type = 'class'")), "_files": chunk(parse.file_summaries(units))}
            self.chunks.replace_all(repo, parts)
            vectors = embed.vectors(self.chunks.collection(repo, "_functions"), "id", "document")
            vectors.write.mode("overwrite").parquet(f"{self.path}/vectors/repo_id={repo}")
            # cut once, for every question that is asked later
            graph.adjacency(self.spark.read.parquet(f"{self.path}/edges/repo_id={repo}")).write.mode("overwrite").parquet(f"{self.path}/adjacency/repo_id={repo}")
            retrieve.name_index(self.chunks.collection(repo, "_functions")).write.mode("overwrite").parquet(f"{self.path}/names/repo_id={repo}")
            n = units.agg(F.count_if(F.col("type") == "function").alias("f"), F.count_if(F.col("type") == "class").alias("c")).first()
            links = self.spark.read.parquet(f"{self.path}/edges/repo_id={repo}").count()
            stats = f'{{"files":{len(found)},"functions":{n.f},"classes":{n.c},"edges":{links}}}'
            self._status(repo, status="complete", stats=stats)
            self._note(task, repo, "complete", 6, 6, "complete")
        except Exception as e:
            self.chunks.delete(repo)
            self._status(repo, status="failed", error_code=type(e).__name__, error_message=str(e)[:500])
            self._note(task, repo, "failed", 6, 6, "failed")
            raise
        return repo, task

    def delete_repo(self, repo_id: str, force: bool = False) -> None:
        row = self.repos().where(F.col("id") == repo_id).select("status").first()
        if row is None:
            raise KeyError(repo_id)
        if row.status in schemas.IN_PROGRESS and not force:
            raise Busy(repo_id)
        self.chunks.delete(repo_id)
        for name in ("units", "edges", "vectors", "adjacency", "names"):
            self.chunks._remove(f"{self.path}/{name}/repo_id={repo_id}")
        gone = self.spark.createDataFrame([(repo_id,)], "id string")
        repos, events, messages = store.cascade_delete(gone, self.repos(), self.task_events(), self._table("messages", schemas.MESSAGES))
        self._replace("repos", repos)
        if self._there("task_events"):
            self._replace("task_events", events)
        if self._there("messages"):
            self._replace("messages", messages)

    # retrieve

    def retrieve(self, repo_id: str, questions: DataFrame, mode: str = "graph") -> DataFrame:
        """schemas.RETRIEVED for questions (question_id, question)."""
        row = self.repos().where(F.col("id") == repo_id).select("status").first()
        if row is None:
            raise KeyError(repo_id)
        if row.status != "complete":
            raise Busy(repo_id)
        chunks = self.chunks.collection(repo_id, "_functions")
        vectors, near, names = (self.spark.read.parquet(f"{self.path}/{name}/repo_id={repo_id}") for name in ("vectors", "adjacency", "names"))
        if mode == "naive":
            return retrieve.naive(questions, chunks, vectors, names=names)
        return retrieve.graph_augmented(questions, chunks, vectors, near, names)

    def build_prompts(self, retrieved: DataFrame, questions: DataFrame) -> DataFrame:
        return text.context_prompts(retrieved, questions)

    def register_sql(self) -> None:
        """SQL names of the engine's own functions, and parse_units(path, content), a table function."""
        from ..operators.curate import diff_changed_lines, python_parses

        self.spark.udf.register("diff_changed_lines", diff_changed_lines)
        self.spark.udf.register("python_parses", python_parses)
        self.spark.udtf.register("parse_units", parse.unit_table())
