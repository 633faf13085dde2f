"""Text expressions: symbols, documents, prompts, frames, JSON in prose, context budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas

#: Fixed values.
MAX_SYMBOLS = 8
CHUNK_CHARS, CONTEXT_CHARS = 3_000, 12_000
INPUT_CHARS = 10_000


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def symbols(text: str | Column) -> Column:
    """Names that a question mentions: dotted or underscored identifiers, and what stands in backticks.

    Sorted, each once, the first eight. Identifiers are ASCII and end where ASCII word characters do.
    The repeated group is possessive: else the pattern recurses for each part of a dotted name.
    """
    plain = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*+(?:\.[A-Za-z_][A-Za-z0-9_]*+)*+)"), F.lit(1))
    named = F.filter(plain, lambda t: F.contains(t, F.lit("_")) | F.contains(t, F.lit(".")))
    quoted = F.regexp_extract_all(text, F.lit("`([A-Za-z_][A-Za-z0-9_.]*)`"), F.lit(1))
    return F.slice(F.array_sort(F.array_union(named, quoted)), 1, MAX_SYMBOLS)


def document(file: str = "file", type_: str = "type", name: str = "name", docstring: str = "docstring", calls: str = "calls", source: str = "source") -> Column:
    """A unit as the text that is embedded; empty docstrings and call lists have no line."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), F.col(file)),
        F.concat(F.lit("Type: "), F.col(type_)),
        F.concat(F.lit("Name: "), F.col(name)),
        F.when(F.coalesce(F.col(docstring), F.lit("")) != "", F.concat(F.lit("Docstring: "), F.col(docstring))),
        F.when(F.size(calls) > 0, F.concat(F.lit("Calls: "), F.array_join(calls, ", "))),
        F.col(source),
    )


def metadata() -> Column:
    """What a store keeps of a unit beside its document; calls as a JSON list."""
    return F.struct("name", "file", "type", "start_line", "end_line", F.to_json("calls").alias("calls"))


def within_budget(chunks: DataFrame, by: str = "question_id", rank: str = "rank", content: str = "content", *, each: int = CHUNK_CHARS, total: int = CONTEXT_CHARS) -> DataFrame:
    """Chunks with `taken`: what is left of each after cutting to `each` and then to what remains of `total`.

    Taking greedily in order of rank equals a running sum: of c = min(each, length), a chunk
    gets min(c, total - sum of c before it) and stays while that sum is under the total.
    """
    c = F.least(F.lit(each), F.length(content))
    before = Window.partitionBy(by).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.withColumn("_c", c).withColumn("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    take = F.greatest(F.lit(0), F.least(F.col("_c"), F.lit(total) - F.col("_p"))).cast("int")
    return rows.where(F.col("_p") < total).withColumn("taken", F.substring(F.col(content), F.lit(1), take)).drop("_c", "_p")


def context_prompts(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, prompt) from budgeted chunks (question_id, rank, name, file, lines, type, content) and questions (question_id, question)."""
    kept = within_budget(chunks)
    tag = F.when(F.col("type") == "seed", "[SEED]").otherwise("[NEIGHBOR]")
    line = F.concat(tag, F.lit(" "), F.col("name"), F.lit("  ("), F.col("file"), F.lit("  L"), F.col("lines")[0], F.lit("–"), F.col("lines")[1], F.lit(")\n"), F.col("taken"))
    # at most a few chunks a question: the budget bounds the list
    context = kept.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))
    #: Fixed value: the prompt's beginning.
    head = "You are a code analysis assistant. Use the retrieved context below to answer the question. Reference function names and file paths where relevant.\n\n=== Retrieved context ===\n"
    whole = F.concat(F.lit(head), F.coalesce("context", F.lit("")), F.lit("\n\n=== Question ===\n"), F.col("question"))
    return questions.join(context, "question_id", "left").select("question_id", whole.alias("prompt"))


def json_object(raw: str | Column) -> Column:
    """The JSON object in a model's answer: in a fence, else from the first brace to the last; null if there is none or it is malformed.

    A fence is looked for in two steps, and braces by their places, so that a text of many
    openings without an end is read once, not once for each.
    """
    raw = _c(raw)
    opened = F.regexp_extract(raw, r"(?s)```(?:json)?\s*+(\{.*+)", 1)
    fenced = F.regexp_extract(opened, r"(?s)^(\{.*?\})\s*+```", 1)
    first = F.instr(raw, "{")
    last = F.length(raw) - F.instr(F.reverse(raw), "}") + 1
    braces = F.when((first > 0) & (last > first) & F.contains(raw, F.lit("}")), F.substring(raw, first, last - first + 1))
    text = F.when(fenced != "", fenced).otherwise(braces)
    return F.when(F.try_parse_json(text).isNotNull(), text)


def parse_review(raw: str | Column) -> Column:
    """A review struct; a raw answer that does not parse becomes the summary, cut to 1000 characters."""
    r = F.from_json(json_object(raw), schemas.REVIEW)
    # a score in quotes or with decimals counts, cut to a whole number
    score = F.get_json_object(json_object(raw), "$.overall_score").try_cast("double").cast("int")
    return F.when(
        json_object(raw).isNotNull(),
        F.struct(F.coalesce(score, F.lit(50)).alias("overall_score"), F.coalesce(r["issues"], F.from_json(F.lit("[]"), "array<struct<severity:string,line:int,description:string,suggestion:string>>")).alias("issues"), F.coalesce(r["strengths"], F.array().cast("array<string>")).alias("strengths"), F.coalesce(r["summary"], F.lit("")).alias("summary")),
    ).otherwise(
        F.struct(F.lit(50).alias("overall_score"), F.from_json(F.lit("[]"), "array<struct<severity:string,line:int,description:string,suggestion:string>>").alias("issues"), F.array().cast("array<string>").alias("strengths"), F.substring(raw, 1, 1000).alias("summary"))
    )


def parse_debug(raw: str | Column) -> Column:
    """A debug struct; confidence is high, medium or low (else low); a raw answer that does not parse becomes the cause."""
    r = F.from_json(json_object(raw), schemas.DEBUG)
    sure = F.when(r["confidence"].isin("high", "medium", "low"), r["confidence"]).otherwise(F.lit("low"))
    return F.when(
        json_object(raw).isNotNull(),
        F.struct(F.coalesce(r["probable_cause"], F.lit("")).alias("probable_cause"), F.coalesce(r["root_location"], F.lit("")).alias("root_location"), F.coalesce(r["execution_path"], F.array().cast("array<string>")).alias("execution_path"), sure.alias("confidence")),
    ).otherwise(F.struct(F.substring(raw, 1, 1000).alias("probable_cause"), F.lit("").alias("root_location"), F.array().cast("array<string>").alias("execution_path"), F.lit("low").alias("confidence")))


def parse_tests(raw: str | Column) -> Column:
    """A tests struct; a missing count is the number of cases."""
    r = F.from_json(json_object(raw), schemas.TESTS)
    none = F.from_json(F.lit("[]"), "array<struct<type:string,name:string>>")
    return F.when(
        json_object(raw).isNotNull(),
        F.struct(F.coalesce(r["test_code"], F.lit("")).alias("test_code"), F.coalesce(r["test_count"], F.size(F.coalesce(r["cases"], none))).alias("test_count"), F.coalesce(r["cases"], none).alias("cases")),
    ).otherwise(F.struct(_c(raw).alias("test_code"), F.lit(0).alias("test_count"), none.alias("cases")))


def event_frame(event: str | Column, data: str | Column) -> Column:
    """A server-sent event; `data` is JSON text."""
    return F.concat(F.lit("event: "), _c(event), F.lit("\ndata: "), _c(data), F.lit("\n\n"))


def frames(rows: DataFrame, text_col: str) -> DataFrame:
    """Rows of (place, event, data) for each whole frame of a text; a partial tail and frames without both lines give none."""
    # what follows the last blank line is a partial frame
    pieces = F.split(text_col, "\n\n", -1)
    whole = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    out = rows.withColumn("_f", whole).select(*rows.columns, F.posexplode("_f").alias("place", "_frame"))
    out = out.withColumn("event", F.regexp_extract("_frame", "(?m)^event: ?(.*)$", 1)).withColumn("data", F.regexp_extract("_frame", "(?m)^data: ?(.*)$", 1))
    return out.where((F.col("event") != "") & F.try_parse_json("data").isNotNull()).drop("_frame")


def assembled(chunks: DataFrame, by: str = "stream", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """(by, text): each stream's chunks, cut anywhere, as one text in order of `seq`; an answer's length bounds it."""
    parts = chunks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(seq, chunk))).alias("_parts"))
    return parts.select(by, F.array_join(F.transform("_parts", lambda x: x[chunk]), "").alias("text"))


#: What may follow each event of an answer stream; the first follows nothing.
FOLLOWERS = {"": ("retrieval_done", "error"), "retrieval_done": ("token", "done", "error"), "token": ("token", "done", "error"), "done": (), "error": ()}


def may_follow(before: Column, event: Column) -> Column:
    """Whether an answer stream may have `event` after `before` (null at its start): retrieval_done, token*, then done or error."""
    ok = F.lit(False)
    for first, then in FOLLOWERS.items():
        ok = ok | ((F.coalesce(before, F.lit("")) == first) & event.isin(*then)) if then else ok
    return ok


def order_faults(events: DataFrame, by: str = "stream", seq: str = "seq", event: str = "event") -> DataFrame:
    """The events of answer streams that may not stand where they do, with the event before them."""
    w = Window.partitionBy(by).orderBy(seq)
    rows = events.withColumn("before", F.lag(event).over(w))
    return rows.where(~may_follow(F.col("before"), F.col(event)))


def clean_url(url: str | Column, host: str = "github.com") -> Column:
    """An owner/repository URL of `host` over http or https, less slashes at its end; null for any other."""
    pattern = rf"^https?://{host.replace('.', r'[.]')}/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/?$"
    return F.when(F.rlike(_c(url), F.lit(pattern)), F.regexp_replace(url, "/+$", ""))


def host_of(url: str | Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def too_long(text: str | Column, limit: int = INPUT_CHARS) -> Column:
    return F.length(text) > limit


#: The format of a training sample.
SAMPLE_PARTS = (
    "### Task: Fix the bug described by the commit message.\n\n### Commit message:\n",
    "\n\n### Buggy code:\n```python\n",
    "\n```\n\n### Fixed code:\n```python\n",
    "\n```",
)


def stripped(text: str | Column) -> Column:
    """A text without the white space at its ends; empty for null."""
    return F.btrim(F.coalesce(_c(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))


def training_sample(message: str | Column, old: str | Column, new: str | Column, url: str | Column) -> Column:
    """A curated commit as prompt and completion."""
    task, code, fixed, end = map(F.lit, SAMPLE_PARTS)
    prompt = F.concat(task, stripped(message), code, stripped(old), fixed)
    completion = F.concat(stripped(new), end)
    meta = F.struct(stripped(message).alias("message"), F.coalesce(_c(url), F.lit("")).alias("url"))
    return F.struct(F.concat(prompt, completion).alias("text"), prompt.alias("prompt"), completion.alias("completion"), meta.alias("meta"))


def reference_code(completion: str | Column) -> Column:
    """The code that a completion is scored against: without fences, trimmed."""
    return stripped(F.replace(_c(completion), F.lit("```"), F.lit("")))


def predicted_code(answer: str | Column) -> Column:
    """What a model wrote before its first fence."""
    return stripped(F.split(answer, "```", 2)[0])


def fenced_blocks(text: str | Column) -> Column:
    """The fenced code blocks of a text, as structs of language and code."""
    blocks = F.regexp_extract_all(text, F.lit("(?s)(```[a-zA-Z0-9]*\n.*?```)"), F.lit(1))
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, "^```([a-zA-Z0-9]*)\n", 1).alias("language"), F.regexp_extract(b, "(?s)^```[a-zA-Z0-9]*\n(.*?)```$", 1).alias("code")))


def progress_percent(stage: Column, current: Column, total: Column) -> Column:
    """Steps done, or else the stage's place among seven, in percent, at most 100."""
    place = F.array_position(F.array(*map(F.lit, schemas.STAGES)), stage) - 1
    by_steps = F.round(100.0 * current / F.nullif(total, F.lit(0)))
    return F.least(F.lit(100.0), F.coalesce(F.when(total > 0, by_steps), F.round(100.0 * F.greatest(place, F.lit(0)) / len(schemas.STAGES)))).cast("int")


def envelope(data: Column, code: Column | None = None, message: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(data.alias("data"), F.when(F.lit(code is not None), F.struct((null if code is None else code).alias("code"), (null if message is None else message).alias("message"))).alias("error"))


def review_prompt(language: str | Column, code: str | Column) -> Column:
    head = (
        " code.\n\nAnswer with one JSON object: overall_score (0-100), issues (at most 10, worst first; each with severity critical|high|medium|low|info, "
        "line or null, description, suggestion), strengths (at most 5), summary.\nReturn only the JSON object.\n\nCode to review:\n```"
    )
    return F.concat(F.lit("Perform a code review of the following "), _c(language), F.lit(head), _c(language), F.lit("\n"), _c(code), F.lit("\n```"))


def debug_prompt(language: str | Column, code: str | Column, error: str | Column) -> Column:
    head = " code and the error it gives.\n\nAnswer with one JSON object: probable_cause, root_location, execution_path (list), confidence high|medium|low.\nReturn only the JSON object.\n\nCode:\n```"
    return F.concat(F.lit("Debug the following "), _c(language), F.lit(head), _c(language), F.lit("\n"), _c(code), F.lit("\n```\n\nError:\n"), _c(error))


def tests_prompt(language: str | Column, code: str | Column, framework: str | Column) -> Column:
    head = " code.\n\nAnswer with one JSON object: test_code, test_count, cases (each with type and name).\nReturn only the JSON object.\n\nCode:\n```"
    return F.concat(F.lit("Write "), _c(framework), F.lit(" tests for the following "), _c(language), F.lit(head), _c(language), F.lit("\n"), _c(code), F.lit("\n```"))


def completion_messages(prompt: str | Column) -> Column:
    """A function to complete, as chat messages."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit("Complete the function. Return only code.").alias("content")),
        F.struct(F.lit("user").alias("role"), _c(prompt).alias("content")),
    )
