"""Graphs between topics: mentions, links and shared tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import discard, kept


def mentions(entries: DataFrame) -> DataFrame:
    """(src, dst, n): entries of src that hold all tokens of dst's name. Topics' names are joined on
    tokens, so an entry meets only topics that share one."""
    names = entries.select("topic").distinct().select(F.col("topic").alias("dst"), F.array_distinct(T.tokens(F.col("topic"))).alias("ts"))
    need = names.where(F.size("ts") > 0).select("dst", F.size("ts").alias("k"), F.explode("ts").alias("term"))
    have = entries.select("entry_id", F.col("topic").alias("src"), F.explode(F.array_distinct(T.tokens(F.col("body")))).alias("term"))
    hits = have.join(need, "term").where("src <> dst").groupBy("entry_id", "src", "dst", "k").agg(F.count("*").alias("m")).where("m = k")
    return hits.groupBy("src", "dst").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame, most: int = 8) -> DataFrame:
    """(topic, direction, rank, other, n): the strongest edges of each topic, both ways."""
    both = edges.select(F.col("src").alias("topic"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "n").unionByName(edges.select(F.col("dst").alias("topic"), F.lit("in").alias("direction"), F.col("src").alias("other"), "n"))
    w = Window.partitionBy("topic", "direction").orderBy(F.desc("n"), "other")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def link_in(linked: DataFrame) -> DataFrame:
    """linked (topic, idx, links): topic, idx and link_in, the links that point there (0 without)."""
    n = linked.select(F.explode("links").alias("l")).groupBy(F.col("l.topic").alias("topic"), F.col("l.idx").alias("idx")).agg(F.count("*").alias("link_in"))
    return linked.select("topic", "idx").join(n, ["topic", "idx"], "left").withColumn("link_in", F.coalesce("link_in", F.lit(0)))


def one_hop(linked: DataFrame, matched: DataFrame) -> DataFrame:
    """Entries (topic, idx) that matched entries link to and that aren't matched, with the first
    linker in log order. linked: entry_id, topic, idx, links; matched: entry_id."""
    src = linked.join(matched, "entry_id", "left_semi").select(F.col("entry_id").alias("by"), F.explode("links").alias("l"))
    to = linked.join(matched, "entry_id", "left_anti").select("entry_id", "topic", "idx")
    hit = src.select("by", F.col("l.topic").alias("topic"), F.col("l.idx").alias("idx")).join(to, ["topic", "idx"])
    return hit.groupBy("entry_id", "topic", "idx").agg(F.min("by").alias("linked_by"))


def broken_links(linked: DataFrame) -> DataFrame:
    """Topics that links name and that don't exist."""
    want = linked.select(F.explode("links").alias("l")).select(F.col("l.topic").alias("topic")).distinct()
    return want.join(linked.select("topic").distinct(), "topic", "left_anti")


def similar_topics(topics: DataFrame, name: str) -> DataFrame:
    """Other topics that hold a part (3 bytes or more, between dashes) of a new name."""
    hit = F.lit(False)
    for p in name.split("-"):
        if len(p.encode()) >= 3:
            hit = hit | F.col("topic").contains(p)
    return topics.select("topic").distinct().where((F.col("topic") != name) & hit)


def shared_tag_edges(entries: DataFrame, core: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, tag, weight): the heaviest tag that two topics share; a core tag counts 100 more."""
    n = entries.select("topic", F.explode("tags").alias("tag")).groupBy("topic", "tag").agg(F.count("*").alias("n"))
    pairs = n.select(F.col("topic").alias("a"), "tag", "n").join(n.select(F.col("topic").alias("b"), "tag", F.col("n").alias("m")), "tag").where("a < b")
    weight = F.least("n", "m") + F.when(F.col("tag").isin(*core), 100).otherwise(0) if core else F.least("n", "m")
    return pairs.groupBy("a", "b").agg(F.max_by("tag", F.struct(weight, F.col("tag"))).alias("tag"), F.max(weight).alias("weight"))


def reachable(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(name, depth) of what roots (name) reach over edges (src, dst), by breadth; cycles end the walk.

    Each level joins only the newest names and drops those already seen, so no path is listed twice. The
    edges and each level are written tables: a level is read from disk, not made again from all before it,
    also when an executor is lost. The edges' table goes at the end; the result reads those of the levels.
    """
    spark = edges.sparkSession
    edges, at = kept(edges.select("src", "dst"))
    level, newest = 0, roots.select("name").distinct().withColumn("depth", F.lit(0))
    seen = newest
    while depth is None or level < depth:
        level += 1
        step = edges.join(newest, edges.src == newest.name).select(F.col("dst").alias("name")).distinct().join(seen, "name", "left_anti").withColumn("depth", F.lit(level))
        newest, place = kept(step)
        if newest.isEmpty():
            discard(spark, place)
            break
        seen = seen.unionByName(newest)
    discard(spark, at)
    return seen
