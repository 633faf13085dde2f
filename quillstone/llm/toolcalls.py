"""Tool-call linking: calls meet results by identifier, in topological order, as canonical JSON.

Calls and results are tables of single events, keyed by conversation and identifier, and are
joined by hash; no conversation is gathered in one task, so one of any length is only more
rows. A call's place is its turn, pushed behind every call that it waits for: where results
come before the calls that use them, as they should, turns are that order already, and only
conversations that break it take part in further rounds. Chains of calls that wait for one
call each are walked by pointer jumping, in as many rounds as their length has bits; calls that
wait for several are then placed in rounds, each once all its needs are. What no round reaches
waits in a circle, or behind one.

DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch_root, staged

CALLS = "conv_id bigint, call_id string, turn bigint, name string, arguments string, after array<string>"
RESULTS = "conv_id bigint, call_id string, turn bigint, content string"


def schemas(spark: SparkSession, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """(name, fields): of each tool, its arguments with type (as variants name it) and need."""
    rows = [(n, [(k, t, need) for k, (t, need) in sorted(f.items())]) for n, f in sorted(tools.items())]
    return spark.createDataFrame(rows, "name string, fields array<struct<field:string,type:string,needed:boolean>>")


def in_order(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, place): place grows along every dependency; null for calls in a circle or behind one."""
    one = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.coalesce("turn", F.lit(0))).alias("place"))
    places = staged(one, "places")
    needs = calls.where("conv_id is not null and call_id is not null and after is not null").select("conv_id", "call_id", F.explode("after").alias("need")).where("need is not null").distinct()
    before = places.select("conv_id", F.col("call_id").alias("need"), F.col("place").alias("need_place"))
    needs = staged(needs.join(before, ["conv_id", "need"]).join(places, ["conv_id", "call_id"]), "needs")
    broken = staged(needs.where("need_place >= place").select("conv_id").distinct(), "broken")
    if not broken.limit(1).count():
        return places
    edges = needs.join(broken, "conv_id", "left_semi").select("conv_id", "need", "call_id")
    own = places.join(broken, "conv_id", "left_semi")
    several = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("open"), F.min("need").alias("to"))
    one_need = staged(own.join(several.where("open = 1"), ["conv_id", "call_id"]).select("conv_id", "call_id", "to", F.col("place").alias("least"), F.lit(1).cast("bigint").alias("steps")), "chains")
    chains = _jumped(one_need, own)
    knots = staged(_peeled(chains, edges, own.join(several.select("conv_id", "call_id", "open"), ["conv_id", "call_id"], "left").where("open is null or open > 1")), "knots")
    far = knots.select("conv_id", F.col("call_id").alias("to"), F.col("place").alias("to_place"))
    # a call that ends in a circle points to no knot
    ends = chains.join(far, ["conv_id", "to"], "left").select("conv_id", "call_id", F.when(F.col("to_place").isNotNull(), F.greatest("least", F.col("steps") + F.col("to_place"))).alias("place"))
    return places.join(broken, "conv_id", "left_anti").unionByName(knots).unionByName(ends)


def _jumped(chains: DataFrame, own: DataFrame) -> DataFrame:
    """Calls with one need each, as (conv_id, call_id, to, least, steps): place = max(least, steps + place of `to`).

    `to` starts as the need and moves on while it has one need too; every round doubles how far
    it is, so a chain is walked in as many rounds as its length has bits. What goes in a circle
    never comes to a call without or with several needs, and stops after those rounds.
    """
    longest = own.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    for _ in range(int(longest).bit_length()):
        on = chains.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("least").alias("next_least"), F.col("steps").alias("next_steps"))
        joined = chains.join(on, ["conv_id", "to"], "left")
        moved = joined.select("conv_id", "call_id", F.coalesce("next", "to").alias("to"), F.greatest("least", F.col("steps") + F.col("next_least")).alias("least"), (F.col("steps") + F.coalesce("next_steps", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved"))
        before, chains = chains, staged(moved, "chains")
        discard(before)
        if not chains.where("moved").limit(1).count():
            break
    return chains


def _peeled(chains: DataFrame, edges: DataFrame, knots: DataFrame) -> DataFrame:
    """(conv_id, call_id, place) of the calls without or with several needs.

    Their needs are first followed to the knots at the ends of chains; each round then gives a
    place to those all of whose needs have one. Rounds are as many as knots in a row wait for
    each other; what no round reaches has a null.
    """
    spark = knots.sparkSession
    direct = edges.join(knots.where("open is not null").select("conv_id", "call_id"), ["conv_id", "call_id"])
    over = chains.select("conv_id", F.col("call_id").alias("need"), "to", "least", "steps")
    links = direct.join(over, ["conv_id", "need"], "left").select("conv_id", "call_id", F.coalesce("to", "need").alias("to"), F.col("least"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    links = staged(links, "links")
    waiting = staged(knots.select("conv_id", "call_id", "place", F.coalesce("open", F.lit(0).cast("bigint")).alias("open")), "waiting")
    path = f"{scratch_root(spark)}/placed-{uuid.uuid4().hex}"
    number = 0
    while True:
        ready = waiting.where("open = 0").select("conv_id", "call_id", "place")
        ready.write.parquet(f"{path}/round={number}")
        ready = spark.read.schema(ready.schema).parquet(f"{path}/round={number}")
        if not ready.limit(1).count():
            break
        met = links.join(ready.select("conv_id", F.col("call_id").alias("to"), F.col("place").alias("to_place")), ["conv_id", "to"])
        pushed = met.groupBy("conv_id", "call_id").agg(F.max(F.greatest(F.coalesce(F.col("least") + 1, F.lit(0).cast("bigint")), F.col("steps") + F.col("to_place"))).alias("floor"), F.count("*").alias("met"))
        left = waiting.where("open > 0").join(pushed, ["conv_id", "call_id"], "left")
        left = left.select("conv_id", "call_id", F.greatest("place", "floor").alias("place"), (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"))
        before, waiting = waiting, staged(left, "waiting")
        discard(before)
        number += 1
    placed = spark.read.schema(ready.schema).option("recursiveFileLookup", "true").parquet(path)
    return placed.unionByName(waiting.select("conv_id", "call_id", F.lit(None).cast("bigint").alias("place")))


def _faults(arguments: Column, fields: Column) -> Column:
    """What is wrong with an arguments object: not_object, missing:f, type:f, unknown:f."""
    value = F.try_parse_json(arguments)
    object_ = F.schema_of_variant(value).startswith("OBJECT")
    members = F.expr("try_cast(try_parse_json(_arguments) as map<string, variant>)")
    keys = F.map_keys(members)
    of_type = lambda f: F.schema_of_variant(F.try_element_at(members, f["field"]))
    absent = F.transform(F.filter(fields, lambda f: f["needed"] & ~F.array_contains(keys, f["field"])), lambda f: F.concat(F.lit("missing:"), f["field"]))
    wrong = F.transform(F.filter(fields, lambda f: F.array_contains(keys, f["field"]) & (of_type(f) != f["type"])), lambda f: F.concat(F.lit("type:"), f["field"]))
    named = F.transform(fields, lambda f: f["field"])
    extra = F.transform(F.array_sort(F.filter(keys, lambda k: ~F.array_contains(named, k))), lambda k: F.concat(F.lit("unknown:"), k))
    return F.when(fields.isNull(), F.array(F.lit("no_such_tool"))).when(F.coalesce(~object_, F.lit(True)), F.array(F.lit("not_object"))).otherwise(F.concat(absent, wrong, extra))


def link(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """A row per distinct call, and one per result that no call asked for.

    Columns: conv_id, call_id, call_turn, result_turn, place, status (linked, early, unanswered,
    orphan, unnamed), faults, record. A result that comes at or before its call's turn is early.
    Of repeated calls or results with one identifier the earliest turn counts, ties to the
    smallest content. Calls and results without conversation or identifier are unnamed, one
    row each. `record` is canonical JSON: keys sorted at every depth, no white space. Arguments
    that are no JSON object stay in it as a string. Other columns are not read.
    """
    named = lambda df: df.where("conv_id is not null and call_id is not null")
    left = named(calls).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments")).alias("c"))
    right = named(results).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    both = left.join(right.hint("shuffle_hash"), ["conv_id", "call_id"], "full").join(in_order(calls), ["conv_id", "call_id"], "left")
    loose = calls.where("conv_id is null or call_id is null").select("conv_id", "call_id", F.struct("turn", "name", "arguments").alias("c"), F.lit(None).cast("struct<turn:bigint,content:string>").alias("r"))
    loose = loose.unionByName(results.where("conv_id is null or call_id is null").select("conv_id", "call_id", F.lit(None).cast("struct<turn:bigint,name:string,arguments:string>").alias("c"), F.struct("turn", "content").alias("r")))
    rows = both.unionByName(loose.withColumn("place", F.lit(None).cast("bigint")))
    status = (
        F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "unnamed")
        .when(F.col("c").isNull(), "orphan")
        .when(F.col("r").isNull(), "unanswered")
        .when(F.col("r.turn") <= F.col("c.turn"), "early")
        .otherwise("linked")
    )
    rows = rows.withColumn("status", status).withColumn("_arguments", F.col("c.arguments"))
    rows = rows.join(F.broadcast(tools.select(F.col("name").alias("_tool"), "fields")), F.col("c.name") == F.col("_tool"), "left")
    rows = rows.withColumn("faults", F.when(F.col("c").isNull(), F.array().cast("array<string>")).otherwise(_faults(F.col("_arguments"), F.col("fields"))))
    # a variant keeps an object's keys sorted, at every depth
    arguments = F.coalesce(F.to_json(F.try_parse_json("_arguments")), F.to_json(F.struct(F.col("_arguments").alias("text"))))
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit(""))
    part = lambda name, c: F.when(text(c) != "", F.concat(F.lit(f'"{name}":'), text(c)))
    record = F.concat(
        F.lit("{"),
        F.concat_ws(",", F.when(F.col("_arguments").isNotNull(), F.concat(F.lit('"arguments":'), arguments)), part("call_id", "call_id"), part("content", "r.content"), part("conv_id", "conv_id"), part("name", "c.name"), part("place", "place"), part("status", "status")),
        F.lit("}"),
    )
    return rows.select("conv_id", "call_id", F.col("c.turn").alias("call_turn"), F.col("r.turn").alias("result_turn"), "place", "status", F.array_join("faults", ",").alias("faults"), record.alias("record"))


def turns_as_events(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads plain chat turns as events: what a user says asks, the assistant's next turn answers.

    The supplied conversations hold no calls, so their ids decide what a call is like. A call's
    identifier is its turn; in every 11th conversation two turns of four share one. A call waits
    for the user's turn before it; in every third conversation it waits for the one after it, so
    order must be made; in every 13th also for the one before, which is a circle. Arguments are
    {"chars", "text"}; in some conversations chars is text, a field is added, or they are no object.
    JSON messages of the form {"tool_calls": [{"id", "name", "arguments", "after"}]} (assistant)
    and {"tool_call_id", "content"} (tool) are read by `messages_as_events`.
    """
    own = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    every = lambda n, rest: F.pmod("conv_id", F.lit(n)) == rest
    number = lambda shift: F.when(every(11, 4), F.floor((F.col("turn") + shift) / 4) * 4).otherwise(F.col("turn") + shift).cast("string")
    chars = F.length("text").alias("chars")
    arguments = (
        F.when(every(7, 1), F.to_json(F.struct(F.length("text").cast("string").alias("chars"), "text")))
        .when(every(7, 2), F.to_json(F.struct(chars, "role", "text")))
        .when(every(7, 3), F.to_json(F.array("text")))
        .otherwise(F.to_json(F.struct(chars, "text")))
    )
    after = F.when(every(13, 5), F.array(number(-2), number(2))).when(every(3, 0), F.array(number(2))).otherwise(F.array(number(-2)))
    asked = own.where("role = 'user'").select("conv_id", number(0).alias("call_id"), "turn", F.lit("ask").alias("name"), arguments.alias("arguments"), after.alias("after"))
    answered = own.where("role = 'assistant'").select("conv_id", number(-1).alias("call_id"), "turn", F.col("text").alias("content"))
    return asked, answered


def messages_as_events(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in JSON messages; other messages, and JSON of another form, have none."""
    own = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    made = F.from_json(F.get_json_object("text", "$.tool_calls"), "array<struct<id:string,name:string,arguments:variant,after:array<string>>>")
    asked = own.where("role = 'assistant'").select("conv_id", "turn", F.explode(made).alias("c")).select("conv_id", F.col("c.id").alias("call_id"), "turn", "c.name", F.to_json("c.arguments").alias("arguments"), "c.after")
    answer = F.get_json_object("text", "$.tool_call_id")
    answered = own.where((F.col("role") == "tool") & answer.isNotNull()).select("conv_id", answer.alias("call_id"), "turn", F.get_json_object("text", "$.content").alias("content"))
    return asked, answered
