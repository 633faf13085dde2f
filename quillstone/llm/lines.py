"""Cross-site boilerplate lines, by distinct-site spread.

A line is boilerplate if it occurs at `min_sites` sites or more. A line that occurs fewer times
than that cannot; the others get a HyperLogLog sketch of their sites, made where the rows are
and merged by aggregation. Where a sketch's estimate is near the limit, the sites are counted
exactly; elsewhere the estimate would have to be off by six times its usual error to matter.

A document without any line of its own is a copy rather than a page with boilerplate around it;
it is left whole, for a near-duplicate stage to decide on.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: Sketches of 2^12 registers have a relative error of 1.04 / 64; six times that is near.
LG_REGISTERS, NEAR = 12, 0.1


#: ASCII white space, which is taken off a line's ends.
SPACE = " \t\r\x0b\x0c"


def _bare(line: str | Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _pieces(text: str | Column) -> Column:
    return F.split(text, "\n", -1)


def _marks(at: str) -> Column:
    """Sorted places as an array that has "1" at them and "0" before: what looks each place up would be quadratic."""
    gaps = F.zip_with(at, F.concat(F.array(F.lit(-1)), at), lambda x, before: F.concat(F.repeat(F.lit("0"), x - before - 1), F.lit("1")))
    return F.split(F.array_join(gaps, ""), "", -1)


def _key(line: Column) -> list[Column]:
    """128 bits of a line without the white space around it."""
    trimmed = _bare(line)
    return [F.xxhash64(trimmed).alias("k1"), F.xxhash64(F.lit(1), trimmed).alias("k2")]


def numbered_lines(docs: DataFrame, id_col: str, site_col: str, text_col: str) -> DataFrame:
    """(id, seal, site, at, k1, k2) of lines that are not blank; id and seal name a document."""
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("seal"), F.col(site_col).cast("string").alias("site"), F.col(text_col).alias("text"))
    rows = own.select("id", "seal", "site", F.posexplode(_pieces("text")).alias("at", "line")).where(_bare("line") != "")
    return rows.select("id", "seal", "site", "at", *_key(F.col("line")))


def spread_lines(lines: DataFrame, *, min_sites: int) -> DataFrame:
    """(k1, k2) of the lines that occur at `min_sites` sites or more; rows without a site count for none."""
    often = staged(lines.where("site is not null").groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("k1", "k2"), "often")
    there = lines.where("site is not null").select("k1", "k2", "site").join(often, ["k1", "k2"])
    sketches = there.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", LG_REGISTERS).alias("sketch"))
    spread = staged(sketches.select("k1", "k2", F.hll_sketch_estimate("sketch").alias("about")), "spread")
    low, high = min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1
    near = spread.where(F.col("about").between(low, high)).select("k1", "k2")
    exact = there.join(near, ["k1", "k2"], "left_semi").groupBy("k1", "k2", "site").agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.count("*").alias("sites"))
    found = spread.where(F.col("about") > high).select("k1", "k2").union(exact.where(F.col("sites") >= min_sites).select("k1", "k2"))
    found = staged(found, "boilerplate")
    discard(often, spread)
    return found


def without_boilerplate(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", *, min_sites: int = 6, lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """`docs` without its boilerplate lines, with the numbers of lines before and of lines removed.

    Every row stays, with its other columns, whatever their names; only a column that has the
    name of a new one is replaced. A null text stays null and has no lines; blank lines are
    never boilerplate. Rows with a null id or site are rewritten like others. Repeated rows stay
    repeated. Lines are compared without the white space at their ends. A document that has no
    other line that is not blank is left whole. An empty table gives an empty result.
    """
    lines = staged(numbered_lines(docs, id_col, site_col, text_col), "lines")
    boilerplate = spread_lines(lines, min_sites=min_sites)
    # a document's repeated rows have the same lines: positions once
    hit = lines.join(boilerplate.hint("merge"), ["k1", "k2"]).select("id", "seal", "at").distinct()
    hit = staged(hit.groupBy("id", "seal").agg(F.array_sort(F.collect_list("at")).alias("at")), "hits")
    # other columns travel in one, so that their names meet nothing here
    other = [c for c in docs.columns if c not in (text_col, lines_col, removed_col)]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in other)).alias("other"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("seal"))
    # hits grow with the documents, so they are never broadcast
    on = rows["id"].eqNullSafe(hit["id"]) & (rows["seal"] == hit["seal"])
    rows = rows.join(hit.hint("merge"), on, "left").select("other", "text", "at")
    own = F.size(F.filter(_pieces("text"), lambda x: _bare(x) != ""))
    rows = rows.withColumn("cut", F.col("at").isNotNull() & (own > F.size("at")))
    kept = F.array_join(F.zip_with(_pieces("text"), _marks("at"), lambda x, m: F.when(F.coalesce(m, F.lit("")) != "1", x)), "\n")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(_pieces("text"))).cast("long")
    made = {text_col: F.when(F.col("cut"), kept).otherwise(F.col("text")), lines_col: n_lines, removed_col: F.when(F.col("cut"), F.size("at")).otherwise(F.lit(0)).cast("long")}
    order = [c for c in docs.columns if c not in (lines_col, removed_col)] + [lines_col, removed_col]
    return rows.select(*(made[c].alias(c) if c in made else F.col("other").getField(c).alias(c) for c in order))
