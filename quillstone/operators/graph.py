"""Call graphs: bare-name resolution, one-hop expansion, node-link JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Fixed value: neighbours looked at in each direction of a seed.
DEGREE_CAP = 50


def nodes(units: DataFrame) -> DataFrame:
    return units.select("id", "name", "file", "type", "start_line", "end_line")


def callees(units: DataFrame, id_col: str = "id", name_col: str = "name", seq_col: str = "seq") -> DataFrame:
    """(name, dst): the last unit of each name, by `seq`; written, so that a plan knows how small it is and calls need no shuffle to meet it."""
    return kept(units.where(F.col(name_col).isNotNull()).groupBy(F.col(name_col).alias("name")).agg(F.max_by(id_col, seq_col).alias("dst")), "callees")


def _calls(units: DataFrame, id_col: str, calls_col: str, seq_col: str) -> DataFrame:
    return units.select(F.col(id_col).alias("src"), F.col(seq_col).alias("seq"), F.explode(F.array_distinct(calls_col)).alias("name"))


def edges(units: DataFrame, id_col: str = "id", name_col: str = "name", calls_col: str = "calls", seq_col: str = "seq", at: DataFrame | None = None) -> DataFrame:
    """(src, dst): a unit calls a name; the last unit of that name, by `seq`, is the callee.

    Unresolved names give nothing, as do calls to oneself; repeated calls are one edge. `seq`
    of an edge is its caller's. With `at` (id), only the edges that begin or end there: calls of
    other units are dropped as they are read.
    """
    last, calls = callees(units, id_col, name_col, seq_col), _calls(units, id_col, calls_col, seq_col)
    if at is None:
        found = calls.join(last, "name")
    else:
        ends = kept(at.select(F.col("id").alias("_at")).distinct(), "ends")
        begin = _calls(units.join(ends, F.col(id_col) == F.col("_at"), "left_semi"), id_col, calls_col, seq_col)
        called = kept(last.join(ends, F.col("dst") == F.col("_at"), "left_semi"), "called")
        found = begin.join(last, "name").union(calls.join(called, "name"))
    return found.where("src <> dst").groupBy("src", "dst").agg(F.min("seq").alias("seq"))


def named_edges(units: DataFrame) -> DataFrame:
    """(repo, src, dst, source, target): edges with their caller's file and both names; ids are keys, so a call and a callee's name are an edge once."""
    calls = units.where("name <> ''").select(F.col("file").alias("repo"), F.col("id").alias("src"), F.col("name").alias("source"), F.explode(F.array_distinct("calls")).alias("name"))
    return calls.join(callees(units).where("name <> ''"), "name").where("src <> dst").select("repo", "src", "dst", "source", F.col("name").alias("target"))


def degrees(edge: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of the nodes that have edges."""
    ends = edge.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edge.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def adjacency(edge: DataFrame, cap: int = DEGREE_CAP) -> DataFrame:
    """(seed, ids): the first `cap` successors, and in a row of their own predecessors, of each node.

    In order of the edge's seq, then of the other end. The cut is made before rows are
    shuffled, so that a hub sends `cap` rows a task and not its edges; made once, it serves any seeds.
    """
    ends = [edge.select(F.col(own).alias("seed"), F.lit(own).alias("side"), F.col(other).alias("id"), "seq") for own, other in (("src", "dst"), ("dst", "src"))]
    order = Window.partitionBy("seed", "side").orderBy("seq", "id")
    near = ends[0].union(ends[1]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap)
    return near.groupBy("seed", "side").agg(F.collect_list("id").alias("ids")).select("seed", "ids")


def neighbours(seeds: DataFrame, edge: DataFrame, cap: int | None = DEGREE_CAP) -> DataFrame:
    """(question_id, id): one hop from seeds (question_id, id) along edges and against them, less the seeds.

    At most `cap` successors and `cap` predecessors of each seed, in order of the edge's seq,
    then of the other end; `edge` may be an `adjacency`, which has made that cut.
    """
    asked = seeds.select("question_id", F.col("id").alias("seed")).distinct()
    if cap is not None:
        near = edge if "ids" in edge.columns else adjacency(edge, cap)
        found = asked.join(near, "seed").select("question_id", F.explode("ids").alias("id"))
    else:
        hop = lambda own, other: asked.join(edge.select(F.col(own).alias("seed"), F.col(other).alias("id")), "seed").select("question_id", "id")
        found = hop("src", "dst").union(hop("dst", "src"))
    return found.distinct().join(seeds.select("question_id", "id"), ["question_id", "id"], "left_anti")


def to_node_link(node: DataFrame, edge: DataFrame) -> DataFrame:
    """One row, `graph`: the node-link JSON of one repository's graph, nodes and links in order.

    For a graph that fits one value; `node_link_pieces` gives the same document for any size.
    """
    n = node.agg(F.sort_array(F.collect_list(F.struct("id", "name", "file", "type", "start_line", "end_line"))).alias("nodes"))
    e = edge.agg(F.sort_array(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target")))).alias("links"))
    whole = F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), F.struct().alias("graph"), "nodes", "links")
    return n.join(e).select(F.to_json(whole).alias("graph"))


NODE = "array<struct<id:string,name:string,file:string,type:string,start_line:int,end_line:int>>"
LINK = "array<struct<source:string,target:string>>"
NODE_LINK = f"directed boolean, multigraph boolean, nodes {NODE}, links {LINK}"


def from_node_link(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = graph.select(F.from_json("graph", NODE_LINK).alias("g"))
    return parsed.select(F.inline("g.nodes")), parsed.select(F.posexplode("g.links").alias("seq", "l")).select(F.col("l.source").alias("src"), F.col("l.target").alias("dst"), F.col("seq").cast("long").alias("seq"))


#: Nodes or links of a piece.
PIECE = 1_024


def _pieces(rows: DataFrame, section: int) -> DataFrame:
    """(section, place, piece): rows in order as JSON, many to a piece; each piece but the first begins with a comma."""
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, *rows.columns).sortWithinPartitions(*rows.columns)
    placed = ordered.select(F.monotonically_increasing_id().alias("at"), F.to_json(F.struct(*rows.columns)).alias("json"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "json"))), lambda x: x["json"]), ",")
    chunks = kept(placed.groupBy(F.floor(F.col("at") / PIECE).alias("place")).agg(joined.alias("body")), "pieces")
    comma = F.when(F.col("place") == F.col("first"), "").otherwise(",")
    return chunks.join(F.broadcast(chunks.agg(F.min("place").alias("first")))).select(F.lit(section).alias("section"), "place", F.concat(comma, "body").alias("piece"))


def node_link_pieces(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(section, place, piece): the node-link JSON of a graph of any size; in this order the pieces, joined, are the document.

    Rows are ordered by ranges, and no task holds more than a piece at a time.
    """
    spark = node.sparkSession
    frame = [(0, 0, '{"directed":true,"multigraph":false,"graph":{},"nodes":['), (2, 0, '],"links":['), (4, 0, "]}")]
    nodes = _pieces(node.select("id", "name", "file", "type", "start_line", "end_line"), 1)
    links = _pieces(edge.select(F.col("src").alias("source"), F.col("dst").alias("target")), 3)
    return spark.createDataFrame(frame, "section int, place long, piece string").union(nodes).union(links)


def from_node_link_pieces(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and links (src, dst, seq) numbered in the document's order, of pieces as `node_link_pieces` gives them."""
    listed = F.concat(F.lit("["), F.regexp_replace("piece", "^,", ""), F.lit("]"))
    parsed = lambda section, kind: pieces.where(F.col("section") == section).select("place", F.from_json(listed, kind).alias("x"))
    links = parsed(3, LINK).select("place", F.posexplode("x").alias("at", "l"))
    # gaps between pieces do not matter for the order
    links = links.select(F.col("l.source").alias("src"), F.col("l.target").alias("dst"), (F.col("place") * PIECE + F.col("at")).alias("seq"))
    return parsed(1, NODE).select(F.inline("x")), links
