"""Named queries over the supplied tables and their SQL.

The tables hold no source code, so operators meet stand-ins: a document is a unit, its first
token its name and its distinct tokens its calls; a benchmark text is a question; a source is
a repository or file. Searches take the rows whose ids 100 divides as queries, against all rows.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import embed, metrics, text
from ..operators import admission, curate, graph, parse, retrieve, store, topk, vector_index
from ..sources import files
from ..sources.scratch import kept, scratch
from ..streaming import jobs
from . import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = oracles.SQL


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# stand-ins


def _units(spark: SparkSession, sf: str) -> DataFrame:
    words = embed.tokens("text")
    docs = _table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.nullif(F.regexp_extract(F.lower("text"), "[a-z_0-9]+", 0), F.lit("")).alias("name"),  # the first word
        F.col("source").alias("file"),
        F.lit("function").alias("type"),
        F.lit(1).alias("start_line"),
        F.size(F.split("text", "\n", -1)).alias("end_line"),
        F.array_distinct(words).alias("calls"),
        F.col("text").alias("document"),
        F.col("doc_id").alias("seq"),
    )


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges(_units(spark, sf))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return embed.vectors(_table(spark, sf, "documents"), "doc_id", "text")


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return kept(retrieve.seeds(_questions(spark, sf), _units(spark, sf), _doc_vectors(spark, sf)), "seeds")


def _graph_hits(spark: SparkSession, sf: str) -> DataFrame:
    found, units = _seeds(spark, sf), _units(spark, sf)
    return retrieve.expanded(found, units.where("type = 'function'"), graph.edges(units, at=found))


# embedding


@query
def hash_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return embed.token_counts(_table(spark, sf, "documents"), "doc_id", "text")


@query
def hash_embed_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return embed.entries(_doc_vectors(spark, sf)).withColumn("weight", F.round("weight", 9))


@query
def hash_embed_norms(spark: SparkSession, sf: str) -> DataFrame:
    return embed.norms(_doc_vectors(spark, sf)).withColumn("norm", F.round("norm", 9))


@query
def dense_from_sparse(spark: SparkSession, sf: str) -> DataFrame:
    dense = embed.densify(_doc_vectors(spark, sf))
    return dense.select("id", F.transform("vector", lambda x: F.round(x, 9)).alias("vector"))


# vector search


def _near(spark: SparkSession, sf: str, k: int, where: Column | None = None) -> DataFrame:
    rows = _table(spark, sf, "embeddings")
    return topk.dense_top_k(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", k, where=where)


@query
def vector_topk_dense(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf, 5).withColumn("sim", F.round("sim", 4))


@query
def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf, 5, F.col("label") < 3).withColumn("sim", F.round("sim", 4))


def _vector_index(spark: SparkSession, sf: str) -> tuple[vector_index.VectorIndex, DataFrame, DataFrame]:
    """An index of all embeddings, the embeddings, and every hundredth as queries."""
    rows = _table(spark, sf, "embeddings")
    return vector_index.build(rows, scratch(spark, "vector-index"), "vec_id", "embedding", k=5), rows, rows.where("vec_id % 100 = 0")


@query
def vector_index_all_lists(spark: SparkSession, sf: str) -> DataFrame:
    """`vector_topk_dense` through an index all of whose lists are probed."""
    index, _, asked = _vector_index(spark, sf)
    return index.search(asked, "vec_id", "embedding", 5, probe=index.settings.lists).withColumn("sim", F.round("sim", 4))


@query
def vector_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Of each query: its exact nearest rows, how many of them the index found, and how many rows each way scores."""
    index, rows, asked = _vector_index(spark, sf)
    found = vector_index.recall(index.search(asked, "vec_id", "embedding", 5), topk.dense_top_k(asked, rows, "vec_id", "embedding", 5))
    return found.join(index.scored(asked, "vec_id", "embedding"), "query_id").join(rows.agg(F.count("*").alias("rows")))


@query
def vector_similarity_clamped(spark: SparkSession, sf: str) -> DataFrame:
    """Of cosine distances 0 to 2, as events' values give them."""
    return _table(spark, sf, "events").select("event_id", F.round(embed.similarity(F.abs(F.col("value")) / 50.0), 6).alias("sim"))


@query
def vector_topk_hash(spark: SparkSession, sf: str) -> DataFrame:
    asked = embed.vectors(_questions(spark, sf), "question_id", "question")
    return topk.sparse_top_k(asked, _doc_vectors(spark, sf), 5).withColumn("sim", F.round("sim", 4))


@query
def knn_label_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    label = _table(spark, sf, "embeddings").select("vec_id", "label")
    hits = _near(spark, sf, 10).join(label.withColumnsRenamed({"vec_id": "query_id", "label": "gold"}), "query_id").join(label.withColumnRenamed("vec_id", "id"), "id")
    by_query = hits.groupBy("query_id").agg(*[F.max(((F.col("rank") <= k) & (F.col("label") == F.col("gold"))).cast("int")).alias(f"hit{k}") for k in (1, 5, 10)])
    return by_query.agg(F.count("*").alias("n"), *[metrics.percent(f"hit{k}", 2).alias(f"recall_at_{k}") for k in (1, 5, 10)])


# symbols


def _hosts(spark: SparkSession, sf: str) -> DataFrame:
    host = text.host_of("url")
    return _table(spark, sf, "pages").select(F.col("page_id").alias("id"), host.alias("name"), host.alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("url").alias("document"))


@query
def symbol_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", F.array_join(text.symbols("url"), " ").alias("symbols"))


@query
def symbol_lookup_exact(spark: SparkSession, sf: str) -> DataFrame:
    asked = _table(spark, sf, "pages").where("page_id % 100 = 0").select(F.col("page_id").alias("question_id"), F.col("url").alias("question"))
    return retrieve.symbol_hits(asked, _hosts(spark, sf)).select("question_id", "id", "sim")


@query
def seeds_exact_over_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Every second question has its dots taken out, so it names no symbol and gets vector hits."""
    pages, hosts = _table(spark, sf, "pages"), _hosts(spark, sf)
    question = F.when(F.col("page_id") % 200 == 0, F.col("url")).otherwise(F.regexp_replace("url", "[._]", " "))
    asked = pages.where("page_id % 100 = 0").select(F.col("page_id").alias("question_id"), question.alias("question"))
    found = retrieve.seeds(asked, hosts, embed.vectors(hosts, "id", "document"))
    return found.withColumn("sim", F.round("sim", 4))


# graph


@query
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.nodes(_units(spark, sf))


@query
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).select("src", "dst")


@query
def graph_edge_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = _units(spark, sf).agg(F.count("*").alias("nodes"), F.count_distinct("name").alias("names"))
    return n.join(_edges(spark, sf).agg(F.count("*").alias("edges")))


@query
def graph_degree_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf)).groupBy("out_degree", "in_degree").agg(F.count("*").alias("n"))


def _hop(spark: SparkSession, sf: str, cap: int | None) -> DataFrame:
    asked = _table(spark, sf, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("question_id"), F.col("doc_id").alias("id"))
    return graph.neighbours(asked, kept(graph.edges(_units(spark, sf), at=asked), "edges"), cap)


@query
def graph_expand_one_hop(spark: SparkSession, sf: str) -> DataFrame:
    return _hop(spark, sf, None)


@query
def graph_expand_capped_50(spark: SparkSession, sf: str) -> DataFrame:
    return _hop(spark, sf, graph.DEGREE_CAP)


@query
def graph_node_link_json(spark: SparkSession, sf: str) -> DataFrame:
    """The graph through its JSON and back."""
    text_ids = _edges(spark, sf).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "seq")
    nodes = graph.nodes(_units(spark, sf)).withColumn("id", F.col("id").cast("string"))
    _, back = graph.from_node_link_pieces(kept(graph.node_link_pieces(nodes, text_ids), "node-link"))
    return back.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query
def graph_bipartite_order_part(spark: SparkSession, sf: str) -> DataFrame:
    """Orders call the parts they hold; one hop from every hundredth order."""
    edge = _table(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_linenumber").cast("long").alias("seq"))
    asked = _table(spark, sf, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return graph.neighbours(asked, edge.distinct(), None)


# retrieval


@query
def retrieve_naive(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.naive(_questions(spark, sf), _units(spark, sf), _doc_vectors(spark, sf)).drop("content")


@query
def retrieve_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _graph_hits(spark, sf)


@query
def retrieve_public_view(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.public_view(_graph_hits(spark, sf))


@query
def fusion_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows of each question are seeds and neighbours, and their scores' range."""
    return _graph_hits(spark, sf).groupBy("question_id", "type").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


@query
def topk_stable_ties(spark: SparkSession, sf: str) -> DataFrame:
    """The first three parts of each brand by size, ties by name, then key."""
    rows = _table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", "p_size")
    return topk.ranked(rows, 3, "p_brand", F.desc("p_size"), F.asc("p_name"), F.asc("p_partkey"))


@query
def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    cut = text.within_budget(_graph_hits(spark, sf), each=600, total=2_000)
    return cut.select("question_id", "rank", F.length("taken").alias("taken"))


@query
def prompt_text(spark: SparkSession, sf: str) -> DataFrame:
    return text.context_prompts(_graph_hits(spark, sf), _questions(spark, sf))


# evaluation


def _repo_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.named_edges(_units(spark, sf))


@query
def edge_sample_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.stable_sample(_repo_edges(spark, sf), "repo", "src", "dst").select("repo", "src", "dst", "source", "target")


def _edge_rows(spark: SparkSession, sf: str) -> DataFrame:
    """For each sampled edge, whether its target's name is among the vector and graph hits of a question that names its source."""
    sample = kept(metrics.stable_sample(_repo_edges(spark, sf), "repo", "src", "dst"), "sample")
    units = _units(spark, sf)
    # edges of one source ask the same, so a question is asked once
    asked = sample.select(F.col("source").alias("question_id"), F.concat(F.lit("Which function is directly called by `"), "source", F.lit("`?")).alias("question")).distinct()
    found = kept(retrieve.seeds(asked, units, _doc_vectors(spark, sf)), "seeds")
    near = graph.neighbours(found, graph.edges(units, at=found)).join(units.select("id"), "id", "left_semi").select("question_id", "id")
    hits = kept(retrieve.fuse(found, near).select("question_id", "id", F.lit("graph").alias("mode")).union(found.select("question_id", "id", F.lit("naive"))), "hits")
    named = hits.join(units.select("id", F.col("name").alias("target")), "id").groupBy(F.col("question_id").alias("source"), "target")
    named = named.agg(*[F.max((F.col("mode") == m).cast("int")).alias(m) for m in ("naive", "graph")])
    return sample.join(named, ["source", "target"], "left").select("repo", "src", "dst", *[F.coalesce(m, F.lit(0)).alias(f"{m}_hit_at_8") for m in ("naive", "graph")])


def _recall(rows: DataFrame, *by: str) -> DataFrame:
    n = F.count("*")
    return rows.groupBy(*by).agg(n.alias("n"), metrics.percent("naive_hit_at_8").alias("naive_recall"), metrics.percent("graph_hit_at_8").alias("graph_recall"), metrics.wilson_text(F.sum("graph_hit_at_8"), n).alias("graph_interval"))


@query
def edge_eval_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(_edge_rows(spark, sf)).withColumn("delta", F.round(F.col("graph_recall") - F.col("naive_recall"), 1))


@query
def edge_eval_by_repo(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(_edge_rows(spark, sf), "repo")


@query
def wilson_interval_by_group(spark: SparkSession, sf: str) -> DataFrame:
    n, hits = F.count("*"), F.sum((F.col("value") > 10).cast("int"))
    low, high = metrics.wilson(hits, n)
    return _table(spark, sf, "events").groupBy("event_type").agg(n.alias("n"), hits.alias("hits"), low.alias("low"), high.alias("high"), metrics.wilson_text(hits, n).alias("interval"))


@query
def latency_percentiles_floor_rank(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.at_ranks(_table(spark, sf, "events"), "value", ["event_type"], ("p50", metrics.floor_rank(0.5)), ("p95", metrics.floor_rank(0.95)))


@query
def latency_percentiles_index_rank(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.at_ranks(_table(spark, sf, "events"), "value", ["event_type"], ("p50", metrics.index_rank(0.5)), ("p95", metrics.index_rank(0.95)))


@query
def latency_median_int(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").groupBy("event_type").agg(F.percentile("value", 0.5).cast("int").alias("median"))


@query
def recall_at_5_10_file_or_name(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose ids 100 divides search all others; a hit has the same file or name."""
    about = _units(spark, sf).select("id", "name", "file")
    vectors = kept(_doc_vectors(spark, sf), "vectors")
    asked = vectors.where("id % 100 = 0")
    hits = topk.sparse_top_k(asked, vectors, 11).where("question_id <> id")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).where("rank <= 10")
    gold = about.withColumnsRenamed({"id": "question_id", "name": "gold_name", "file": "gold_file"})
    judged = hits.join(about, "id").join(gold, "question_id").withColumn("hit", (F.col("file") == F.col("gold_file")) | (F.col("name") == F.col("gold_name")))
    by_query = judged.groupBy("question_id").agg(F.max(((F.col("rank") <= 5) & F.col("hit")).cast("int")).alias("h5"), F.max(F.col("hit").cast("int")).alias("h10"))
    return by_query.agg(F.count("*").alias("n"), metrics.percent("h5", 2).alias("recall_at_5"), metrics.percent("h10", 2).alias("recall_at_10"))


@query
def edge_eval_golden(spark: SparkSession, sf: str) -> DataFrame:
    """The published summary from its counts: 26, 13 and 25 hits of 40."""
    hits = F.when(F.col("repo") == "a", 26).when(F.col("repo") == "b", 13).otherwise(25)
    rows = spark.range(120).select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("repo"), F.floor(F.col("id") / 3).alias("i"))
    rows = rows.select("repo", F.lit(0).alias("naive_hit_at_8"), F.lit(2).alias("naive_latency_ms"), (F.col("i") < hits).cast("int").alias("graph_hit_at_8"), F.lit(3).alias("graph_latency_ms"))
    return metrics.edge_summary(rows).withColumn("repos", F.array_join("repos", ","))


@query
def pass_at_1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pass_at_1(_table(spark, sf, "labels").where("quality is not null").withColumn("passed", F.col("quality") == 1))


@query
def bleu_by_turn(spark: SparkSession, sf: str) -> DataFrame:
    """Each assistant turn against the user turn before it."""
    c = _table(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    user = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("reference"))
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("candidate"))
    rows = user.join(said, ["conv_id", "t"]).withColumn("id", F.concat_ws("-", "conv_id", "t"))
    return metrics.bleu(rows).withColumn("bleu", F.round("bleu", 6))


#: Words that weigh more in the corpus' weighted score.
HEAVY_WORDS = ("the", "that", "you", "and", "of")


@query
def bleu_of_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """All assistant turns against the user turns before them, as one corpus."""
    rows = _turns(spark, sf).where("answer is not null")
    scores = metrics.corpus_bleu(rows, "answer", "asked", HEAVY_WORDS)
    return scores.select("n", F.round("bleu", 9).alias("bleu"), F.round("weighted", 9).alias("weighted"), F.round(metrics.code_bleu(F.col("bleu"), F.col("weighted")), 9).alias("combined"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """A user's turn and the assistant's next one, or null where there is none."""
    c = _table(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked")).join(said, ["conv_id", "turn"], "left")


@query
def generation_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that no answer follows count as failed generations."""
    return metrics.generation_failures(_turns(spark, sf))


@query
def scored_code(spark: SparkSession, sf: str) -> DataFrame:
    """What is scored of a completion that ends in a fence, and of an answer that goes on behind one."""
    fenced = lambda c, after: F.concat(F.lit("\n\t"), F.coalesce(c, F.lit("")), F.lit(f" \n```{after}"))
    return _turns(spark, sf).select("conv_id", "turn", text.reference_code(fenced("asked", "\n")).alias("reference"), text.predicted_code(fenced("answer", "\nmore")).alias("predicted"))


@query
def task_prompts(spark: SparkSession, sf: str) -> DataFrame:
    language = F.coalesce("lang", F.lit("text"))
    code = F.coalesce("text", F.lit(""))
    made = F.array(text.review_prompt(language, code), text.debug_prompt(language, code, F.lit("E")), text.tests_prompt(language, code, F.lit("pytest")))
    return _table(spark, sf, "documents").select("doc_id", F.posexplode(made).alias("place", "prompt"))


@query
def completion_messages(spark: SparkSession, sf: str) -> DataFrame:
    said = _table(spark, sf, "benchmark").select("item_id", F.posexplode(text.completion_messages("text")).alias("place", "m"))
    return said.select("item_id", "place", "m.role", "m.content")


@query
def result_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of a nation as one answer of a vector store: parallel arrays, distances shorter than the ids or not there."""
    meta = F.struct(F.col("c_name").alias("name"), F.lit(None).cast("string").alias("file"), F.lit(1).alias("start_line"), F.col("c_nationkey").cast("int").alias("end_line"))
    rows = _table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", meta.alias("meta"), "c_mktsegment"))).alias("r"))
    one = lambda c: F.array(F.transform("r", lambda x: x[c]))
    answer = rows.select(F.array(F.transform("r", lambda x: x["c_custkey"].cast("string"))).alias("ids"), one("c_mktsegment").alias("documents"), one("meta").alias("metadatas"), F.when(F.col("c_nationkey") % 5 != 0, F.array(F.slice(F.transform("r", lambda x: F.pmod(x["c_custkey"], F.lit(3)) / 2.0), 1, 5))).alias("distances"))
    return retrieve.flatten_result(answer).select("id", "name", "file", F.element_at("lines", 2).alias("end_line"), "sim", "content")


@query
def split_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON lines, a folder a split, and read again."""
    path = scratch(spark, "splits")
    slot = F.pmod("doc_id", F.lit(8))
    files.write_splits(_table(spark, sf, "documents").select("doc_id", "text", F.when(slot < 6, "train").when(slot < 7, "validation").otherwise("test").alias("split")), path)
    back = spark.read.schema("doc_id long, text string, split string").json(path)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.sum(F.length("text")).alias("chars"))


@query
def codebleu_combine(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that are missing count as the n-gram part."""
    v = F.col("value") / 100.0
    part = F.when(F.col("event_id") % 3 == 0, v / 2)
    return _table(spark, sf, "events").select("event_id", metrics.code_bleu(v, part, None, v).alias("score"))


# curation

#: Words that occur in the supplied documents.
DOC_WORDS = ("the", "des", "der", "los")


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as commits: the text's first line is the message, its rest the change, its text before that the old file."""
    return _as_commits(_table(spark, sf, "documents"))


def _as_commits(docs: DataFrame) -> DataFrame:
    line = F.substring_index("text", "\n", 1)
    return docs.select("doc_id", "lang", line.alias("message"), F.col("text").alias("old_contents"), F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.substring(F.col("text"), F.length(line) + 2, F.length("text"))).alias("new_contents"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("url"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    reason = curate.reject_reason(language="en", words=DOC_WORDS, min_words=5, diff=False)
    return _commits(spark, sf).withColumn("reject_reason", reason)


@query
def curate_reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return curate.rejections(_judged(spark, sf))


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    return curate.first_accepted(_judged(spark, sf), accept=100, order="doc_id")


@query
def curate_accept_cut(spark: SparkSession, sf: str) -> DataFrame:
    return _scan(spark, sf).where("reject_reason is null").select("doc_id", "seen", "accepted")


@query
def curate_buffered_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """Every document out of a shuffle with a buffer of 100 rows: in its own partition, and no more than the buffer early."""
    rows = _table(spark, sf, "documents").select("doc_id", F.monotonically_increasing_id().alias("place"))
    part = lambda c: F.shiftright(c, 33)
    out = curate.buffered(rows, size=100)
    return out.select("doc_id", (part("pos") == part("place")).alias("own_part"), (F.col("pos") >= F.col("place") - 100).alias("in_bounds"))


@query
def curate_scan_progress(spark: SparkSession, sf: str) -> DataFrame:
    return curate.rejections(_scan(spark, sf))


@query
def curate_diff_size(spark: SparkSession, sf: str) -> DataFrame:
    return _commits(spark, sf).select("doc_id", curate.diff_changed_lines("old_contents", "new_contents").alias("changed"))


@query
def curate_syntax_valid(spark: SparkSession, sf: str) -> DataFrame:
    return _commits(spark, sf).select("doc_id", curate.python_parses("message").alias("valid"))


@query
def curate_split_permutation(spark: SparkSession, sf: str) -> DataFrame:
    sizes = {"train": 75, "validation": 12, "test": 13}
    rows = curate.split(_scan(spark, sf).where("reject_reason is null"), sizes)
    return rows.select("doc_id", "split", "slot")


@query
def curate_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    """A split that needs no numbering: by a digest of the id."""
    return _table(spark, sf, "documents").select("doc_id", _hash_split().alias("split"))


def _hash_split() -> Column:
    slot = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 8
    return F.when(slot < 6, "train").when(slot < 7, "validation").otherwise("test")


@query
def training_sample_format(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "conversations")
    user = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("asked"))
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("answer"))
    s = user.join(said, ["conv_id", "t"]).select("conv_id", "t", text.training_sample("asked", "asked", "answer", F.concat(F.lit("conv/"), F.col("conv_id"))).alias("s"))
    return s.select("conv_id", "t", "s.text", "s.prompt", "s.completion", F.col("s.meta.message").alias("message"), F.col("s.meta.url").alias("url"))


# units


@query
def file_summary_first30(spark: SparkSession, sf: str) -> DataFrame:
    units = _units(spark, sf).withColumns({"repo_id": F.lit("r"), "imports": F.array().cast("array<string>"), "start_line": F.col("id")}).where("name is not null")
    return parse.file_summaries(units).select("id", "file", "type", "source")


@query
def document_render(spark: SparkSession, sf: str) -> DataFrame:
    units = _units(spark, sf).withColumns({"docstring": F.when(F.col("id") % 2 == 0, F.concat(F.lit("about "), F.col("name"))).otherwise(""), "source": F.col("document")})
    return units.select("id", text.document().alias("document"))


@query
def unit_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf).select("id", text.metadata().alias("m")).select("id", "m.*")


@query
def review_scores_as_written(spark: SparkSession, sf: str) -> DataFrame:
    """Scores as numbers, in quotes, with decimals, or as words."""
    score = F.element_at(F.array(F.lit("85"), F.lit('"85"'), F.lit("85.5"), F.lit('"high"')), (F.col("event_id") % 4 + 1).cast("int"))
    raw = F.concat(F.lit('{"overall_score": '), score, F.lit(', "summary": "s"}'))
    return _table(spark, sf, "events").select("event_id", text.parse_review(raw)["overall_score"].alias("score"))


@query
def unit_stats(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 5 == 0, "class").otherwise("function")
    rows = _table(spark, sf, "documents").withColumn("type", kind)
    return rows.groupBy("source").agg(F.count_if(F.col("type") == "function").alias("functions"), F.count_if(F.col("type") == "class").alias("classes"))


@query
def batch_plan(spark: SparkSession, sf: str) -> DataFrame:
    groups = _table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return store.batch_plan(groups, "source", "n")


@query
def batch_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Percent done after each batch, batches in order of their groups."""
    groups = store.batch_plan(_table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", "n")
    each = store.running_total(groups, "source", "batches", "before")
    total = each.agg(F.sum("batches").alias("total"))
    each = each.select("source", "before", F.explode(F.sequence(F.lit(1).cast("long"), "batches")).alias("batch"))
    return each.join(F.broadcast(total)).select("source", "batch", F.floor(100.0 * (F.col("before") + F.col("batch")) / F.col("total")).alias("percent"))


# structured model output


def _prose(spark: SparkSession, sf: str) -> DataFrame:
    """Events' JSON as model answers: fenced, bare in prose, or cut off."""
    way = F.col("event_id") % 3
    raw = F.when(way == 0, F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))).when(way == 1, F.concat(F.lit("Here it is "), F.col("props"), F.lit(" as asked"))).otherwise(F.concat(F.lit("No answer "), F.substring("props", 1, 5)))
    return _table(spark, sf, "events").select("event_id", raw.alias("raw"))


@query
def json_from_prose(spark: SparkSession, sf: str) -> DataFrame:
    return _prose(spark, sf).select("event_id", text.json_object("raw").alias("json"))


def _answers(spark: SparkSession, sf: str, body: Column) -> DataFrame:
    good = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    return _table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit("I cannot say")).otherwise(good).alias("raw"))


@query
def review_parse(spark: SparkSession, sf: str) -> DataFrame:
    issue = F.concat(F.lit('{"severity":"low","line":'), F.col("event_id").cast("string"), F.lit(',"description":"d","suggestion":"s"}'))
    body = F.concat(F.lit('{"overall_score":'), (F.col("event_id") % 101).cast("string"), F.lit(',"issues":['), issue, F.lit('],"summary":"'), F.col("event_type"), F.lit('"}'))
    r = text.parse_review("raw")
    return _answers(spark, sf, body).select("event_id", r["overall_score"].alias("score"), F.size(r["issues"]).alias("issues"), F.try_element_at(r["issues"], F.lit(1))["line"].alias("line"), F.size(r["strengths"]).alias("strengths"), r["summary"].alias("summary"))


@query
def debug_parse(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit('{"probable_cause":"'), F.col("event_type"), F.lit('","execution_path":["a","b"],"confidence":"'), F.when(F.col("event_id") % 2 == 0, "high").otherwise("sure"), F.lit('"}'))
    r = text.parse_debug("raw")
    return _answers(spark, sf, body).select("event_id", r["probable_cause"].alias("cause"), r["root_location"].alias("location"), F.array_join(r["execution_path"], ">").alias("path"), r["confidence"].alias("confidence"))


@query
def tests_parse(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit('{"test_code":"'), F.col("event_type"), F.lit('","cases":[{"type":"edge","name":"n"},{"type":"happy","name":"m"}]}'))
    r = text.parse_tests("raw")
    return _answers(spark, sf, body).select("event_id", r["test_code"].alias("code"), r["test_count"].alias("count"), F.array_join(F.transform(r["cases"], lambda c: c["name"]), ",").alias("names"))


# stores and catalogue


def _chunks(spark: SparkSession, sf: str, where: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    return _table(spark, sf, "customer").where(where).select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("document"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("file"), F.lit("function").alias("type"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), empty.alias("calls"))


def _stored(spark: SparkSession, sf: str) -> store.ChunkStore:
    """A store after an insert of all customers but the tenths, and an upsert of the even ones with new text."""
    chunks = store.ChunkStore(spark, scratch(spark, "chunks"))
    chunks.upsert("r", "_functions", _chunks(spark, sf, "c_custkey % 10 <> 0"))
    chunks.upsert("r", "_functions", _chunks(spark, sf, "c_custkey % 2 = 0").withColumn("document", F.concat("document", F.lit(" v2"))))
    return chunks


@query
def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).collection("r", "_functions").select("id", "document", "name", "file")


@query
def store_get_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = _table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id"))
    return _stored(spark, sf).get("r", "_functions", ids).select("id", "document")


@query
def store_get_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).where("r", "_functions", F.col("name") == "BUILDING").select("id", "document")


@query
def store_count(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).collection("r", "_functions").agg(F.count("*").alias("n"))


@query
def store_delete(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _stored(spark, sf)
    chunks.upsert("s", "_functions", _chunks(spark, sf, "c_custkey % 3 = 0"))
    chunks.delete("r")
    left = chunks.collection("r", "_functions").agg(F.count("*").alias("r"))
    return left.join(chunks.collection("s", "_functions").agg(F.count("*").alias("s")))


def _repos(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as repositories: finished ones are complete, open ones parsing."""
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "parsing").otherwise("failed")
    stats = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"functions":'), (F.col("o_orderkey") % 97).cast("string"), F.lit("}")))
    null = F.lit(None).cast("string")
    return _table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("https://github.com/o/r"), F.col("o_orderkey")).alias("github_url"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("name"), status.alias("status"), stats.alias("stats"), null.alias("graph_data"), null.alias("error_code"), null.alias("error_message"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


@query
def repo_list_newest(spark: SparkSession, sf: str) -> DataFrame:
    s = store.repo_summary(_repos(spark, sf))
    return s.select("id", "name", "status", F.col("stats.functions").alias("functions"), F.col("stats.classes").alias("classes"), "created_at")


@query
def repo_status_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Repositories that customers of a third of the keys made are set to failed, with no new name."""
    null = F.lit(None).cast("string")
    patch = _table(spark, sf, "orders").where("o_custkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("failed").alias("status"), null.alias("name"))
    return store.patched(_repos(spark, sf), patch, ["id"], ["status", "name"]).select("id", "name", "status")


@query
def repo_delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Complete repositories go; their line items (tasks) go too, customers' references (messages) are set to null."""
    repos = _repos(spark, sf)
    tasks = _table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("repo_id"))
    messages = _table(spark, sf, "orders").select(F.concat(F.lit("m"), F.col("o_orderkey")).alias("id"), F.col("o_orderkey").cast("string").alias("repo_id"))
    a, b, c = store.cascade_delete(repos.where("status = 'complete'"), repos, tasks, messages)
    n = F.count("*").alias("n")
    return a.agg(F.lit("repos").alias("what"), n).union(b.agg(F.lit("tasks"), n)).union(c.where("repo_id is null").agg(F.lit("messages_without"), n))


@query
def task_latest(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events").select(F.col("user_id").alias("task"), "ts", "event_id", "event_type")
    return store.latest(events, "task", "ts", "event_id")


@query
def catalogue_violations(spark: SparkSession, sf: str) -> DataFrame:
    repos = _repos(spark, sf).withColumn("status", F.when(F.col("id").cast("long") % 50 == 0, "lost").otherwise(F.col("status")))
    tasks = _table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.when(F.col("l_linenumber") == 7, "none").otherwise(F.col("l_orderkey").cast("string")).alias("repo_id"), F.lit("running").alias("status"))
    return store.violations(repos, tasks).groupBy("rule").agg(F.count("*").alias("n"))


@query
def required_repos(spark: SparkSession, sf: str) -> DataFrame:
    """Nations that no fifth supplier has."""
    need = _table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"))
    return store.missing_required(need, _table(spark, sf, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_nationkey").alias("key")), "key")


@query
def latest_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Of each event type, the folder with the largest number."""
    folder = F.concat(F.lit("run/"), F.when(F.col("event_id") % 10 == 0, "final").otherwise(F.concat(F.lit("checkpoint-"), F.col("event_id"))))
    return store.latest_numbered(_table(spark, sf, "events").select("event_type", folder.alias("path")), "path", "event_type")


# events and frames


@query
def progress_change_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user whose type differs from the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _table(spark, sf, "events").withColumn("last", F.lag("event_type").over(w))
    return e.where(~F.col("event_type").eqNullSafe(F.col("last"))).select("user_id", "event_id", "event_type")


@query
def rate_limit_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Hours in which an event type came more than three times from one half of the users."""
    events = _table(spark, sf, "events").withColumn("client", F.col("user_id") % 2)
    n = events.groupBy(F.window("ts", "1 hour"), "client", "event_type").agg(F.count("*").alias("n"))
    return n.where("n > 3").select(F.col("window.start").alias("start"), "client", "event_type", "n")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests of two clients, their month run through in two minutes, so that limits bind."""
    kind = F.col("event_type")
    route = F.when(F.col("event_id") % 50 == 0, "health").when(kind.isin("signup", "purchase"), "ingest").when(kind.isin("click", "view"), "query").otherwise("code")
    fast = F.timestamp_micros(F.expr("unix_micros(cast(ts as timestamp)) div 20000"))
    return _table(spark, sf, "events").select("event_id", (F.col("user_id") % 2).alias("client"), route.alias("route"), fast.alias("ts"))


@query
def request_admission(spark: SparkSession, sf: str) -> DataFrame:
    return admission.decided(_requests(spark, sf), seq="event_id").select("event_id", "client", "route", "place", "served", "retry_after")


@query
def request_refusals(spark: SparkSession, sf: str) -> DataFrame:
    return admission.refusals(admission.decided(_requests(spark, sf), seq="event_id"))


def _answer_events(events: DataFrame) -> DataFrame:
    """A user's events as one answer stream; most break its order somewhere."""
    event = F.when(F.col("event_type") == "signup", "retrieval_done").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("token")
    return events.select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("seq"), event.alias("event"), "ts")


@query
def answer_stream_order(spark: SparkSession, sf: str) -> DataFrame:
    return text.order_faults(_answer_events(_table(spark, sf, "events"))).select("stream", "seq", "event", "before")


@query
def answer_stream_totals(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.stream_totals(_answer_events(_table(spark, sf, "events")))


@query
def sse_frames_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames: each text holds a whole frame and a partial one."""
    data = F.when(F.col("event_id") % 5 == 0, F.lit("not json")).otherwise(F.col("props"))
    frame = F.concat(text.event_frame(F.col("event_type"), data), F.lit("event: cut\nda"))
    return text.frames(_table(spark, sf, "events").select("event_id", frame.alias("frame")), "frame").select("event_id", "place", "event", "data")


def _chunked(events: DataFrame) -> DataFrame:
    """A user's events as one text of frames, each frame cut in two somewhere, some without JSON."""
    data = F.when(F.col("event_id") % 5 == 0, F.lit("not json")).otherwise(F.col("props"))
    frame = text.event_frame(F.col("event_type"), data)
    at = F.col("event_id") % F.length("frame")
    cut = F.array(F.expr("substring(frame, 1, cast(at as int))"), F.expr("substring(frame, cast(at as int) + 1)"))
    rows = events.select(F.col("user_id").cast("string").alias("stream"), "event_id", frame.alias("frame")).withColumn("at", at)
    return rows.select("stream", "event_id", F.posexplode(cut).alias("half", "chunk")).select("stream", (F.col("event_id") * 2 + F.col("half")).alias("seq"), "chunk")


@query
def sse_frames_assembled(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of each user's text, put together from chunks."""
    whole = text.assembled(_chunked(_table(spark, sf, "events")))
    return text.frames(whole, "text").select("stream", "place", "event", "data")


@query
def url_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Pages' paths as repository URLs, some with a slash, some on another host."""
    host = F.when(F.col("page_id") % 3 == 0, "github.com").otherwise(text.host_of("url"))
    url = F.concat(F.lit("https://"), host, F.lit("/o/r"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "/").otherwise(""))
    return _table(spark, sf, "pages").select("page_id", text.clean_url(url).alias("url"))


@query
def input_length_guard(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").groupBy(text.too_long("text").alias("too_long")).agg(F.count("*").alias("n"))


@query
def fenced_code_blocks(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("a\n```py\n"), F.col("event_type"), F.lit("\n```\nb\n```\nx\n```"))
    blocks = _table(spark, sf, "events").select("event_id", F.posexplode(text.fenced_blocks(raw)).alias("place", "b"))
    return blocks.select("event_id", "place", "b.language", "b.code")


@query
def progress_percent(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.element_at(F.array(F.lit("queued"), F.lit("parsing"), F.lit("storing"), F.lit("complete")), (F.col("event_id") % 4 + 1).cast("int"))
    current, total = (F.col("event_id") % 12).cast("int"), (F.col("event_id") % 3 * 5).cast("int")
    return _table(spark, sf, "events").select("event_id", text.progress_percent(stage, current, total).alias("percent"))


# files and reports


@query
def sha256_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha256"))


@query
def dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents split by a digest of their ids: what the manifest says of each split."""
    docs = _table(spark, sf, "documents")
    # lines are digested where they are read; only digests are ordered
    rows = docs.select(_hash_split().alias("split"), F.col("doc_id").alias("place"), curate.line_digest("text").alias("sha256"))
    rows = store.numbered(rows, "split", "place", "slot")
    told = curate.dataset_manifest(kept(rows, "samples"), dataset="documents", configuration="all", scanned=docs.count())
    parsed = told.select(F.from_json("manifest", "splits map<string, struct<samples: long, sha256: string>>, source_access struct<source_rows_scanned: long>").alias("m"))
    return parsed.select(F.explode("m.splits").alias("split", "s"), F.col("m.source_access.source_rows_scanned").alias("scanned")).select("split", "s.samples", "s.sha256", "scanned")


@query
def jsonl_count(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    _table(spark, sf, "conversations").write.json(path)
    return files.count_lines(spark, path)


@query
def jsonl_read(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    _table(spark, sf, "conversations").write.json(path)
    return files.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query
def benchmark_report_null_safe(spark: SparkSession, sf: str) -> DataFrame:
    """By language: shares of good and toxic documents, their difference, and one that is unknown."""
    rows = _table(spark, sf, "documents").join(_table(spark, sf, "labels"), "doc_id").groupBy("lang").agg(metrics.percent("quality", 2).alias("quality"), metrics.percent("toxic", 2).alias("toxic"))
    return rows.select("lang", "quality", "toxic", metrics.delta("quality", "toxic").alias("delta"), metrics.delta("quality", F.lit(None).cast("double")).alias("unknown"))


@query
def compare_guarded(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "labels")
    half = lambda r: rows.where(F.col("doc_id") % 2 == r).agg(metrics.percent("quality", 2).alias("score"), F.lit("h").alias("test_hash"))
    return metrics.compared(half(0), half(1), ["score"])


# source code

PYTHON_SAMPLE = '''"""Module."""
import os
from __future__ import annotations
from a import b


def first(x):
    """First."""
    return second(os.path.join(x, b(x)))


@wrapped
def hidden():
    pass


class Box:
    "A box."

    def put(self, item):
        def inner():
            return helper(item)
        return inner()

    class Lid:
        def close(self):
            self.box.put(first(1)).done()


if True:
    def conditional():
        pass


async def second(y):
    return first(y), first(y)
'''

SCRIPT_SAMPLE = '''import { x } from "./x";
const LIMIT = 3;

export function load(url) {
  "Loads.";
  const parse = (t) => { return JSON.parse(t); };
  return fetch(url).then(parse);
}

class Store extends Base {
  constructor(a) { super(a); this.items = new Map(make(a)); }
  async get(key) { return this.items.get(key) || load(key); }
}

export const twice = async (n) => double(n) + `${inner(n)}`;
'''


def _samples(spark: SparkSession) -> DataFrame:
    rows = [("a.py", PYTHON_SAMPLE), ("b.js", SCRIPT_SAMPLE), ("broken.py", "def f(:\n    g()\n\ndef ok(x):\n    return h(x)\n"), ("empty.py", "")]
    return spark.createDataFrame([(p, len(c), bytearray(c.encode())) for p, c in rows], "rel_path string, length long, content binary")


@query
def parse_units_python(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse_units(_samples(spark).where("rel_path = 'a.py'"), "r").drop("source")


@query
def parse_units_js(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse_units(_samples(spark).where("rel_path = 'b.js'"), "r").drop("source")


@query
def parse_edge_cases(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse_units(_samples(spark).where("rel_path in ('broken.py', 'empty.py')"), "r").drop("source")


@query
def discover_files(spark: SparkSession, sf: str) -> DataFrame:
    """A small tree: private modules stay, excluded and ignored paths go."""
    with tempfile.TemporaryDirectory() as root:
        for path in ("a.py", "pkg/__init__.py", "pkg/_private.py", "tests/t.py", ".hidden/h.py", "gen/out.js", "gen/keep.js", "doc.txt"):
            os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
            with open(f"{root}/{path}", "w") as f:
                f.write("x = 1\n")
        with open(f"{root}/.gitignore", "w") as f:
            f.write("gen/*\n!gen/keep.js\n")
        found = files.discover(root)
    return spark.createDataFrame([(rel, n) for _, rel, n in found], "rel_path string, length long")


# streams


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream; where it is a single file, its folder is watched for that name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    reader = spark.readStream.schema(_table(spark, sf, name).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query
def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of each user's event type, by a stateful stream."""
    events = _stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("task"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.lit(0).alias("current_step"), F.lit("running").alias("status"))
    return jobs.run_available(jobs.progress(events, timed=False), "stream-progress")


@query
def stream_symbol_enrich(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of pages' URLs joined to a static table of hosts."""
    pages = _stream(spark, sf, "pages")
    asked = pages.select(F.col("page_id").alias("question_id"), F.col("url").alias("question"))
    names = _hosts(spark, sf).groupBy("name").agg(F.min("id").alias("id"))
    return jobs.run_available(jobs.with_symbols(asked, names), "stream-symbols")


@query
def stream_answer_order(spark: SparkSession, sf: str) -> DataFrame:
    """`answer_stream_order` by a stateful stream."""
    return jobs.run_available(jobs.order_faults(_answer_events(_stream(spark, sf, "events")).select("stream", "seq", "event")), "stream-order")


@query
def stream_scan_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    """`curate_accept_cut` by a stream that stops when it has enough."""
    reason = curate.reject_reason(language="en", words=DOC_WORDS, min_words=5, diff=False)
    judged = _as_commits(_stream(spark, sf, "documents")).withColumn("reject_reason", reason)
    seen = jobs.scan_until(judged, "stream-scan", accept=100, order="doc_id")
    return seen.where("reject_reason is null").select("doc_id", "seen", "accepted")


@query
def stream_buffered_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The scan of a stream in the order of a shuffle with a bounded buffer: how many rows it saw, took and turned down."""
    reason = curate.reject_reason(language="en", words=DOC_WORDS, min_words=5)
    judged = curate.buffered(_as_commits(_stream(spark, sf, "documents"))).withColumn("reject_reason", reason)
    seen = jobs.scan_until(judged, "stream-buffered", accept=100)
    return seen.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.max("accepted").alias("accepted"), F.max("seen").alias("seen"))


@query
def stream_frames(spark: SparkSession, sf: str) -> DataFrame:
    """`sse_frames_assembled` by a stateful stream that keeps partial frames."""
    return jobs.run_available(jobs.frames(_chunked(_stream(spark, sf, "events"))), "stream-frames")
