"""Queries on duplicates, chains and classes with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import similar as K
from ..session import ship
from ..sources.views import entries, table, with_as_of
from .registry import ENTRIES, query, sql_tokens
from .stats import _AGE, _FIRST

_WORDS = f"list_distinct(list_transform(list_filter(regexp_split_to_array({_FIRST}, '\\s+'), lambda w: strlen(w) >= 3), lambda w: lower(w)))"


def _aged(spark, sf_dir):
    ship(spark)
    return with_as_of(entries(spark, sf_dir)).withColumn("relevance", F.pmod(F.col("entry_id") * 7, F.lit(10)).cast("double"))


@query(f"""WITH {ENTRIES}, s AS (SELECT topic, entry_id, {_WORDS} AS ws FROM entries)
SELECT a.topic, a.entry_id AS a, b.entry_id AS b, round(len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws))::DOUBLE, 6) AS overlap FROM s a JOIN s b ON a.topic = b.topic AND a.entry_id < b.entry_id
WHERE len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws))::DOUBLE > 0.5""")
def overlap_pairs(spark, sf_dir):
    return K.overlap_pairs(entries(spark, sf_dir)).withColumn("overlap", F.round("overlap", 6))


@query(f"""WITH {ENTRIES}, s AS (SELECT topic, entry_id, {_WORDS} AS ws FROM entries)
SELECT a.topic, count(*) AS pairs FROM s a JOIN s b ON a.topic = b.topic AND a.entry_id < b.entry_id
WHERE len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws))::DOUBLE > 0.5 GROUP BY a.topic""")
def overlap_pair_counts(spark, sf_dir):
    return K.overlap_pair_counts(entries(spark, sf_dir))


@query("""WITH f AS (SELECT item_id, list_distinct(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: strlen(w) >= 2), lambda w: lower(w))) AS ws FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE, 6) AS jaccard FROM f a JOIN f b ON a.item_id < b.item_id AND b.item_id <= a.item_id + 50
WHERE len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE > 0.02""".replace("\\\\s", "\\s"))
def jaccard_pairs(spark, sf_dir):
    files = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file"), K.words_of(F.col("text"), 2).alias("ws"))
    return K.jaccard_pairs(files, 0.02).withColumn("jaccard", F.round("jaccard", 6))


@query(r"""WITH f AS (SELECT item_id, list_distinct(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: strlen(w) >= 2), lambda w: lower(w))) AS ws FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE, 6) AS jaccard FROM f a JOIN f b ON a.item_id < b.item_id
WHERE len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE > 0.02""")
def jaccard_all_pairs(spark, sf_dir):
    files = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file"), K.words_of(F.col("text"), 2).alias("ws"))
    return K.all_jaccard_pairs(files, 0.02).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH {ENTRIES}, p AS (SELECT topic, body FROM entries WHERE entry_id = 500), n AS (SELECT topic, list_distinct(list_filter({sql_tokens('body')}, lambda t: strlen(t) >= 3)) AS ts FROM p),
e AS (SELECT entry_id, topic, list_distinct({sql_tokens('body')}) AS ts FROM entries)
SELECT min(entry_id) AS entry_id FROM e JOIN n USING (topic) WHERE len(n.ts) >= 6 AND len(list_intersect(e.ts, n.ts)) / len(list_distinct(list_concat(e.ts, n.ts)))::DOUBLE > 0.7""")
def duplicate_probe(spark, sf_dir):
    e = entries(spark, sf_dir)
    r = e.where("entry_id = 500").select("topic", "body").first()
    return K.duplicate_probe(e, r.topic if r else "", r.body if r else "")


@query(f"""WITH {ENTRIES}, e AS (SELECT entry_id, topic, (entry_id * 7) % 10 AS relevance, lower({_FIRST}) AS key FROM entries),
g AS (SELECT key, arg_max(entry_id, relevance * 1000000000 + entry_id) AS best, arg_max(topic, relevance * 1000000000 + entry_id) AS bt FROM e WHERE strlen(key) >= 10 GROUP BY key HAVING count(DISTINCT topic) > 1)
SELECT entry_id, topic, CASE WHEN entry_id = best THEN (SELECT string_agg(x.topic, ',' ORDER BY x.entry_id) FROM e x WHERE x.key = e.key AND x.topic <> e.topic) END AS also_in FROM e LEFT JOIN g USING (key) WHERE best IS NULL OR topic = bt""")
def cross_topic_copies(spark, sf_dir):
    return K.cross_topic_copies(_aged(spark, sf_dir)).select("entry_id", "topic", F.array_join("also_in", ",").alias("also_in"))


@query()
def superseded(spark, sf_dir):
    return K.superseded(_aged(spark, sf_dir))


_DATE = "strftime(make_timestamp(ts_min * 60000000), '%Y-%m-%d %H:%M')"
#: The first line, its dominant term and its label of three words, by entry.
_TERMS = rf"""t AS (SELECT entry_id, topic, days_old, {_DATE} AS date, {_FIRST} AS line, list_filter(list_transform(regexp_split_to_array({_FIRST}, '\s+'), lambda w: regexp_replace(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '')), lambda w: strlen(w) >= 3 AND regexp_matches(w, '^\p{{Lu}}')) AS ws FROM aged),
d AS (SELECT *, ws[list_max(list_filter(range(1, len(ws) + 1), lambda i: strlen(ws[i]) = list_max(list_transform(ws, lambda w: strlen(w)))))] AS term FROM t)"""
_LABELS = r"""v AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(line, '^[#*\- ]+', ''), '\s+'), lambda w: w <> '') AS lw FROM d),
u AS (SELECT *, list_min(list_filter(range(1, len(lw) + 1), lambda i: starts_with(lw[i], '(') OR starts_with(lw[i], '[') OR contains(lw[i], '/') OR lw[i] IN ('→', '--', '—'))) AS stop FROM v),
lab AS (SELECT *, regexp_replace(array_to_string(lw[1:least(coalesce(stop - 1, len(lw)), 3)], ' '), '[:,;—]+$', '') AS label FROM u)"""


@query(rf"""WITH {ENTRIES}, {_AGE}, {_TERMS},
s AS (SELECT *, array_to_string((list_filter(regexp_split_to_array(replace(line, term, ''), '\s+'), lambda w: w <> ''))[1:5], ' ') AS step FROM d WHERE term IS NOT NULL)
SELECT topic, term, arg_max(entry_id, entry_id - days_old * 1000000000) AS newest, count(*) AS n,
  md5(term || ': ' || string_agg(CASE WHEN step = '' THEN date[6:] ELSE step || ' (' || date[6:] || ')' END, ' → ' ORDER BY days_old DESC, entry_id)) AS chain_md5 FROM s GROUP BY topic, term HAVING count(*) >= 2""")
def term_chains(spark, sf_dir):
    return K.term_chains(_aged(spark, sf_dir)).select("topic", "term", "newest", "n", F.md5("chain").alias("chain_md5"))


@query(rf"""WITH {ENTRIES}, {_AGE}, {_TERMS}, {_LABELS},
o AS (SELECT *, row_number() OVER (PARTITION BY topic, days_old // 2 ORDER BY days_old DESC, entry_id) AS no FROM lab),
q AS (SELECT *, row_number() OVER (PARTITION BY topic, days_old // 2, label ORDER BY no) = 1 AS fresh FROM o)
SELECT topic, days_old // 2 AS bucket, arg_max(entry_id, no) AS newest, count(*) AS n,
  coalesce(array_to_string(list(label ORDER BY no) FILTER (no <= 4 AND label <> '' AND fresh), ' | '), '') AS labels FROM q GROUP BY topic, bucket HAVING count(*) >= 3""")
def bucket_chains(spark, sf_dir):
    return K.bucket_chains(_aged(spark, sf_dir)).select("topic", "bucket", "newest", "n", "labels")


@query()
def leader_clusters(spark, sf_dir):
    return K.leader_clusters(_aged(spark, sf_dir))


@query()
def batch_dedup(spark, sf_dir):
    ship(spark)
    return K.batch_kept(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "role", "text").withColumnRenamed("role", "topic"))


@query()
def compressed_briefing(spark, sf_dir):
    return K.compressed(_aged(spark, sf_dir)).select("entry_id", "topic", "relevance", "chain", F.array_join("also_in", ",").alias("also_in"), "by")


_CASES = " ".join(f"WHEN {' OR '.join([f'''contains(f, '{w}') OR list_contains(tags, '{w}')''' for w in ws] + [f'''starts_with(f, '{p}')''' for p in K.OPENINGS.get(c, ())])} THEN '{c}'" for c, ws in K.CATEGORIES)
_RESCUE = " ".join(f"WHEN {' OR '.join(f'''contains(b3, '{w}')''' for w in ws)} THEN '{c}'" for c, ws in K.RESCUE)
_B3 = r"lower(array_to_string((list_filter(string_split(body, chr(10)), lambda x: trim(x, ' ') <> ''))[1:3], ' '))"


@query(f"""WITH {ENTRIES}, e AS (SELECT entry_id, tags, lower({_FIRST}) AS f, {_B3} AS b3 FROM entries), s AS (SELECT *, CASE {_CASES} END AS st, CASE {_RESCUE} END AS re FROM e),
t AS (SELECT tag, row_number() OVER (ORDER BY count(*) DESC, tag) AS rank FROM (SELECT unnest(tags) AS tag FROM s WHERE st IS NULL) GROUP BY tag HAVING count(*) >= 150 QUALIFY rank <= 5)
SELECT entry_id, coalesce(st, t.tag, re, 'UNTAGGED') AS class FROM s LEFT JOIN t ON st IS NULL AND t.tag = s.tags[1]""")
def classification(spark, sf_dir):
    return K.classified(entries(spark, sf_dir), least=150)


_TRIM = "' ' || chr(9) || chr(13) || chr(10)"


@query(f"""WITH d AS (SELECT doc_id, string_split(trim(text[1:length(text) // 2], {_TRIM}), chr(10)) AS have, string_split(trim('[tags: x]' || chr(10) || text, {_TRIM}), chr(10)) AS old FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(array_to_string(list_concat(have, list_filter(old, lambda x: NOT list_contains(list_transform(have, lambda y: trim(y, {_TRIM})), trim(x, {_TRIM})) AND trim(x, {_TRIM}) <> '' AND NOT starts_with(trim(x, ' '), '[tags:'))), chr(10))) AS body_md5 FROM d""")
def body_merge(spark, sf_dir):
    """Each document's first half as the newer body, and the whole, with tags, as the older."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    newer, older = F.expr("substring(text, 1, length(text) div 2)"), F.concat(F.lit("[tags: x]\n"), "text")
    return docs.select("doc_id", F.md5(K.merged_bodies(newer, older)).alias("body_md5"))


@query(rf"""WITH d AS (SELECT doc_id, text AS body FROM documents), w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace({_FIRST}, '^[#*\- ]+', ''), '\s+'), lambda w: w <> '') AS ws FROM d),
s AS (SELECT doc_id, ws, list_min(list_filter(range(1, len(ws) + 1), lambda i: starts_with(ws[i], '(') OR starts_with(ws[i], '[') OR contains(ws[i], '/') OR ws[i] IN ('→', '--', '—'))) AS stop FROM w)
SELECT doc_id, regexp_replace(array_to_string(ws[1:least(coalesce(stop - 1, len(ws)), 3)], ' '), '[:,;—]+$', '') AS label FROM s""")
def label_words(spark, sf_dir):
    """A label for each document, from its whole first content line."""
    return table(spark, sf_dir, "documents").select("doc_id", T.label_words(T.first_content(F.col("text"))).alias("label"))
