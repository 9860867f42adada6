"""Graph queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.views import conversation_entries, entries, table
from .registry import CONV, ENTRIES, query, sql_tokens

_MENTIONS = f"""WITH {ENTRIES}, named AS (SELECT entry_id, topic || '-' || tags[1] AS topic, body FROM entries),
nm AS (SELECT topic AS dst, list_distinct({sql_tokens('topic')}) AS ts FROM (SELECT DISTINCT topic FROM named)), need AS (SELECT dst, len(ts) AS k, unnest(ts) AS term FROM nm WHERE len(ts) > 0),
have AS (SELECT entry_id, topic AS src, unnest(list_distinct({sql_tokens('body')})) AS term FROM named),
hit AS (SELECT entry_id, src, dst FROM have JOIN need USING (term) WHERE src <> dst GROUP BY entry_id, src, dst, k HAVING count(*) = k),
edges AS (SELECT src, dst, count(*) AS n FROM hit GROUP BY src, dst)"""


def _short(spark, sf_dir):
    """Topics named by language, which bodies mention as words."""
    names = F.element_at(F.create_map(*(F.lit(x) for kv in (("en", "the"), ("de", "der-die"), ("fr", "le-la"), ("es", "el-de")) for x in kv)), F.get("tags", F.lit(0)))
    return entries(spark, sf_dir).withColumn("topic", names)


_SHORT = _MENTIONS.replace("topic || '-' || tags[1] AS topic", "CASE tags[1] WHEN 'en' THEN 'the' WHEN 'de' THEN 'der-die' WHEN 'fr' THEN 'le-la' ELSE 'el-de' END AS topic")


@query(f"{_SHORT} SELECT * FROM edges")
def topic_mentions(spark, sf_dir):
    return G.mentions(_short(spark, sf_dir))


@query(f"""{_SHORT}, b AS (SELECT src AS topic, 'out' AS direction, dst AS other, n FROM edges UNION ALL SELECT dst, 'in', src, n FROM edges)
SELECT *, row_number() OVER (PARTITION BY topic, direction ORDER BY n DESC, other) AS rank FROM b QUALIFY rank <= 2""")
def topic_degrees(spark, sf_dir):
    return G.degrees(G.mentions(_short(spark, sf_dir)), 2)


def _linked(spark, sf_dir):
    """Turns as entries that link to the turn before; every fifth also to a topic that is missing."""
    c = conversation_entries(spark, sf_dir)
    link = lambda t, i: F.struct(t.alias("topic"), i.cast("long").alias("idx"))
    links = F.filter(F.array(F.when(F.col("idx") > 0, link(F.col("topic"), F.col("idx") - 1)), F.when(F.col("idx") % 5 == 4, link(F.concat(F.lit("gone-"), "role"), F.lit(0)))), lambda x: x.isNotNull())
    order = F.xxhash64("topic", "idx")
    return c.select("topic", F.col("idx").cast("long").alias("idx"), "role", links.alias("links"), (F.col("idx") + 1000 * F.regexp_extract("topic", r"(\d+)$", 1).cast("long")).alias("entry_id"), order.alias("h")).drop("h")


@query(f"WITH {CONV} SELECT topic, idx, (SELECT count(*) FROM conv d WHERE d.topic = c.topic AND d.idx = c.idx + 1) AS link_in FROM conv c")
def link_in_counts(spark, sf_dir):
    return G.link_in(_linked(spark, sf_dir))


@query(f"WITH {CONV}, m AS (SELECT topic, idx FROM conv WHERE idx % 3 = 2) SELECT 1000 * regexp_extract(topic, '([0-9]+)$', 1)::BIGINT + idx - 1 AS entry_id, topic, idx - 1 AS idx, 1000 * regexp_extract(topic, '([0-9]+)$', 1)::BIGINT + idx AS linked_by FROM m")
def link_one_hop(spark, sf_dir):
    linked = _linked(spark, sf_dir)
    return G.one_hop(linked, linked.where("idx % 3 = 2").select("entry_id"))


@query(f"WITH {CONV} SELECT DISTINCT 'gone-' || role AS topic FROM conv WHERE idx % 5 = 4")
def link_validation(spark, sf_dir):
    return G.broken_links(_linked(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT DISTINCT topic FROM entries WHERE topic <> 'src1-new' AND (contains(topic, 'src1') OR contains(topic, 'new'))")
def topic_suggestion(spark, sf_dir):
    return G.similar_topics(entries(spark, sf_dir), "src1-new")


@query(f"""WITH {ENTRIES}, n AS (SELECT topic, tag, count(*) AS n FROM (SELECT topic, unnest(tags) AS tag FROM entries) GROUP BY ALL),
p AS (SELECT a.topic AS a, b.topic AS b, a.tag, least(a.n, b.n) + CASE WHEN a.tag = 'fr' THEN 100 ELSE 0 END AS weight FROM n a JOIN n b ON a.tag = b.tag AND a.topic < b.topic)
SELECT a, b, tag, weight FROM p QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY weight DESC, tag DESC) = 1""")
def topic_tag_edges(spark, sf_dir):
    return G.shared_tag_edges(entries(spark, sf_dir), ("fr",))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 2 * o_custkey AS src, 2 * l_suppkey + 1 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e WHERE dst % 4 = 3),
r(name) AS (SELECT 2::BIGINT UNION SELECT dst FROM b JOIN r ON src = name) SELECT name FROM r""")
def graph_reachable(spark, sf_dir):
    """Over all orders from customer 1 to suppliers, and on from suppliers of odd number to their customers.
    Customers have even names, suppliers odd ones."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    edges = o.join(li, o.o_orderkey == li.l_orderkey).select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")).distinct()
    back = edges.where("dst % 4 = 3").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.reachable(edges.unionByName(back), spark.range(2, 3).withColumnRenamed("id", "name")).select("name")
