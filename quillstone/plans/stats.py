"""Statistics, listings, filters and text projections with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats as O
from ..session import workspace
from ..sources.store import Log
from ..sources.views import entries, live, log, table, with_as_of
from .registry import ENTRIES, query

_AGE = "aged AS (SELECT *, (SELECT max(ts_min) // 1440 + 1 FROM entries) - ts_min // 1440 AS days_old FROM entries)"
_META = r"'^\[(tags|source|type|modified|tier|confidence|links|linked from):'"
_CONTENT = rf"list_filter(string_split(body, chr(10)), lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(trim(x, ' '), {_META}))"
_FIRST = f"coalesce({_CONTENT}[1], '')"


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN strlen({x}) <= {n} THEN {x} ELSE {x}[1:list_max(list_filter(range(0, {n + 1}), lambda k: strlen({x}[1:k]) <= {n}))] END"


#: Composed bodies that carry metadata lines.
_BODY = "'[tags: ' || d.lang || ', ' || d.source || ']' || chr(10) || '[source: ' || d.source || '.txt:' || d.doc_id || ']' || chr(10) || CASE WHEN d.doc_id % 3 = 0 THEN '[confidence: 0.5]' || chr(10) ELSE '' END || CASE WHEN d.doc_id % 4 = 0 THEN '[links: ' || d.source || ':' || (d.doc_id % 7) || ' missing:x]' || chr(10) ELSE '' END || d.text"


def _composed(spark, sf_dir):
    d, nl = table(spark, sf_dir, "documents"), F.lit("\n")
    body = F.concat(
        F.lit("[tags: "), "lang", F.lit(", "), "source", F.lit("]"), nl, F.lit("[source: "), "source", F.lit(".txt:"), "doc_id", F.lit("]"), nl,
        F.when(F.col("doc_id") % 3 == 0, "[confidence: 0.5]\n").otherwise(""), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("[links: "), "source", F.lit(":"), (F.col("doc_id") % 7).cast("string"), F.lit(" missing:x]\n"))).otherwise(""), "text",
    )
    return d.select("doc_id", "source", body.alias("body"))


@query(f"WITH {ENTRIES} SELECT entry_id, topic, ts_min, confidence, md5(body) AS body_md5 FROM entries")
def log_live(spark, sf_dir):
    return entries(spark, sf_dir).select("entry_id", "topic", "ts_min", "confidence", F.md5("body").alias("body_md5"))


@query("SELECT doc_id AS entry_id, source AS topic, md5(text) AS body_md5 FROM documents WHERE doc_id = 77 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def log_point_read(spark, sf_dir):
    return live(log(spark, sf_dir)).where("entry_id = 77").select("entry_id", "topic", F.md5("body").alias("body_md5"))


@query(f"WITH {ENTRIES} SELECT entry_id, (8 + sum(12 + strlen(topic) + strlen(body)) OVER (ORDER BY entry_id) - (12 + strlen(topic) + strlen(body)))::BIGINT AS \"offset\" FROM entries")
def log_vacuum(spark, sf_dir):
    return O.vacuumed(entries(spark, sf_dir))


@query(f"""WITH {ENTRIES}, n AS (SELECT topic, min(entry_id) AS first_id FROM entries GROUP BY topic)
SELECT topic, first_id, row_number() OVER (PARTITION BY topic ORDER BY entry_id) - 1 AS no, strftime(make_timestamp(ts_min * 60000000), '%Y-%m-%d %H:%M') AS "timestamp", tags[1] AS tags, md5(body) AS body_md5 FROM entries JOIN n USING (topic)""")
def log_export(spark, sf_dir):
    """The export read back through the import: every entry, in its place."""
    out = O.export(entries(spark, sf_dir))
    doc = out.select("first_id", F.concat(F.lit('{"version":1,"topics":[{"topic":"'), "topic", F.lit('","entries":'), "entries", F.lit("}]}")).alias("json"))
    back = O.imported(doc).select("topic", "no", "timestamp", F.array_join("tags", ",").alias("tags"), F.md5("body").alias("body_md5"))
    return back.join(out.select("topic", "first_id"), "topic").select("topic", "first_id", "no", "timestamp", "tags", "body_md5")


@query(f"WITH {ENTRIES}, e AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS entry FROM documents) SELECT entry AS entry_id, source AS topic, 28401120 + 60 * doc_id AS ts_min, md5(text) AS body_md5 FROM e WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def log_rewritten(spark, sf_dir):
    """All documents appended to a log and the toxic ones deleted, read after a vacuum from the path opened anew."""
    at = f"{workspace(spark)}/log/{uuid.uuid4().hex}"
    w, bad = Log(spark, at), table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    docs = table(spark, sf_dir, "documents")
    w.append(docs.select(F.col("doc_id").alias("pos"), F.col("source").alias("topic"), F.col("text").alias("body"), (28401120 + 60 * F.col("doc_id")).alias("ts_min")))
    gone = docs.join(bad, "doc_id", "left_semi").select((28401120 + 60 * F.col("doc_id")).cast("int").alias("ts_min"))
    w.append(None, w.rows().join(gone, "ts_min", "left_semi").select("entry_id"))
    w.vacuum()
    return live(Log(spark, at).rows()).select("entry_id", "topic", F.col("ts_min").cast("long").alias("ts_min"), F.md5("body").alias("body_md5"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""WITH d AS (SELECT 'doc-' || doc_id AS topic, length(text) // 2 AS h, text FROM documents), s AS (SELECT topic, 0 AS idx, '2024-01-01 10:00' AS ts, text[1:h] AS body FROM d UNION ALL SELECT topic, 1, '2024-01-02 11:30', '## no date' || chr(10) || text[h + 1:] FROM d)
SELECT topic, idx, ts, trim(body, {_BLANK}) AS body FROM s WHERE body IS NOT NULL""")
def log_markdown(spark, sf_dir):
    """Each document as a topic file of two entries, its halves."""
    head, tail = F.expr("substring(text, 1, length(text) div 2)"), F.expr("substring(text, length(text) div 2 + 1)")
    file = F.concat(F.lit("# Notes\n## 2024-01-01 10:00\n"), head, F.lit("\n\n## 2024-01-02 11:30\n## no date\n"), tail)
    return O.markdown_sections(table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("name"), file.alias("text")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(rf"""WITH b AS (SELECT d.doc_id, {_BODY} AS body FROM documents d), l AS (SELECT doc_id, string_split(body, chr(10)) AS ls FROM b)
SELECT doc_id, array_to_string(list_transform(string_split(regexp_extract(list_filter(ls, lambda x: starts_with(x, '[tags: ') AND ends_with(x, ']'))[-1], '^\[tags: (.*)\]$', 1), ','), lambda t: trim(t, ' ')), '|') AS tags,
  regexp_extract(list_filter(ls, lambda x: starts_with(x, '[source: ') AND ends_with(x, ']'))[-1], '^\[source: (.*)\]$', 1) AS source, CASE WHEN doc_id % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
  (doc_id % 4 = 0)::INT::BIGINT AS n_links, CASE WHEN doc_id % 4 = 0 THEN doc_id % 7 END AS link_idx FROM l""")
def metadata_projection(spark, sf_dir):
    b = F.col("body")
    return _composed(spark, sf_dir).select("doc_id", F.array_join(T.tags_of(b), "|").alias("tags"), T.source_of(b).alias("source"), T.confidence_of(b).alias("confidence"), F.size(T.links_of(b)).cast("long").alias("n_links"), F.get(T.links_of(b), F.lit(0)).idx.alias("link_idx"))


@query(f"WITH {ENTRIES} SELECT entry_id, {_cut(_FIRST, 60)} AS p60, {_cut(_FIRST, 100)} AS p100 FROM entries")
def previews(spark, sf_dir):
    f = T.first_content(F.col("body"))
    return entries(spark, sf_dir).select("entry_id", T.truncated(f, 60).alias("p60"), T.truncated(f, 100).alias("p100"))


@query(rf"""WITH {ENTRIES}, t AS (SELECT entry_id, topic, ts_min, array_to_string(list_transform(({_CONTENT})[1:2], lambda x: trim(x, ' ')), ' ') AS text FROM entries), c AS (SELECT *, {_cut('text', 120)} AS cut FROM t)
SELECT entry_id, '[' || topic || '] ' || strftime(make_timestamp(ts_min * 60000000), '%Y-%m-%d %H:%M') || ' ' || CASE WHEN cut = text THEN text WHEN contains(cut, ' ') THEN regexp_extract(cut, '^(.*) [^ ]*$', 1) ELSE cut END AS snippet FROM c""")
def snippets(spark, sf_dir):
    return entries(spark, sf_dir).select("entry_id", T.snippet(F.col("topic"), F.col("ts_min"), F.col("body")).alias("snippet"))


@query(f"WITH {ENTRIES}, {_AGE} SELECT entry_id, ts_min // 1440 AS day, days_old, strftime(make_timestamp(ts_min * 60000000), '%Y-%m-%d %H:%M') AS date, CASE WHEN days_old = 0 THEN 'today' WHEN days_old = 1 THEN 'yesterday' WHEN days_old <= 7 THEN 'this week' ELSE '' END AS label FROM aged")
def day_projection(spark, sf_dir):
    e = with_as_of(entries(spark, sf_dir))
    return e.select("entry_id", T.day_of(F.col("ts_min")).alias("day"), "days_old", T.date_text(F.col("ts_min")).alias("date"), T.freshness(F.col("days_old")).alias("label"))


@query(f"WITH {ENTRIES} SELECT DISTINCT topic, regexp_full_match(topic, 'src1.*') AS globbed, contains(topic, 'rc1') AS held FROM entries")
def topic_glob(spark, sf_dir):
    t = entries(spark, sf_dir).select("topic").distinct()
    return t.select("topic", F.col("topic").rlike(T.glob_pattern("src1*")).alias("globbed"), F.col("topic").rlike(T.glob_pattern("rc1")).alias("held"))


@query("SELECT page_id, url = '853/' OR ends_with(url, '/853/') AS suffix, contains(url, 'spam') AS held FROM pages")
def source_filters(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.source_is(F.col("url"), "853/").alias("suffix"), T.source_holds(F.col("url"), "spam").alias("held"))


@query("""WITH f AS (SELECT DISTINCT source AS path, 28401120 + 60 * (SELECT max(doc_id) // 2 FROM documents) AS mtime FROM documents WHERE source LIKE '%1%'),
d AS (SELECT doc_id, source, 28401120 + 60 * doc_id AS ts_min FROM documents)
SELECT doc_id AS entry_id, source AS topic, CASE WHEN doc_id % 2 = 0 THEN source || '.txt:' || doc_id ELSE 'top/**/*1.txt' END AS source, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE (SELECT count(*) FROM f WHERE ends_with(path, '1') AND mtime > ts_min) END AS newer
FROM d WHERE CASE WHEN doc_id % 2 = 0 THEN EXISTS (SELECT 1 FROM f WHERE path = d.source AND mtime > ts_min) ELSE EXISTS (SELECT 1 FROM f WHERE ends_with(path, '1') AND mtime > ts_min) END""")
def stale_entries(spark, sf_dir):
    """Every second entry names a file, the others a glob; files below `top` were changed when half of the entries were written."""
    d = table(spark, sf_dir, "documents")
    half = d.agg((28401120 + 60 * F.floor(F.max("doc_id") / 2)).alias("mtime_min"))
    files = d.where("source LIKE '%1%'").select(F.concat(F.lit("top/"), "source", F.lit(".txt")).alias("path")).distinct().crossJoin(F.broadcast(half))
    source = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(".txt:"), "doc_id")).otherwise("top/**/*1.txt")
    return O.stale_sources(d.select(F.col("doc_id").alias("entry_id"), F.col("source").alias("topic"), source.alias("source"), (28401120 + 60 * F.col("doc_id")).alias("ts_min")), files)


@query("SELECT doc_id AS entry_id, source AS topic FROM documents WHERE doc_id % 5 = 0")
def untimed_entries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.col("source").alias("topic"), F.when(F.col("doc_id") % 5 == 0, 0).otherwise(28401120 + F.col("doc_id")).alias("ts_min"))
    return O.untimed(d).select("entry_id", "topic")


@query(f"WITH {ENTRIES} SELECT min(entry_id) AS entry_id FROM entries WHERE topic = 'src4' AND contains(lower(body), 'license')")
def first_match(spark, sf_dir):
    return O.first_match(entries(spark, sf_dir), "src4", "LICENSE")


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, lower(CASE WHEN strlen(t) <= 3 THEN t WHEN suffix(t, 'ies') AND strlen(t) > 4 THEN t[:-4] || 'y'
WHEN suffix(t, 'sses') THEN t[:-3] WHEN suffix(t, 's') AND NOT (suffix(t, 'ss') OR suffix(t, 'us') OR suffix(t, 'is')) THEN t[:-2] ELSE t END) AS tag FROM w)
SELECT doc_id, coalesce(string_agg(DISTINCT tag, ', ' ORDER BY tag) FILTER (tag <> ''), '') AS tags FROM n GROUP BY doc_id""")
def tag_normalising(spark, sf_dir):
    """All words of each document as tags."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.array_join(T.normal_tags(F.split("text", " ")), ", ").alias("tags"))


_PREFIXES = ", ".join(f"({i}, '{p}', '{t}')" for i, (p, t) in enumerate(T.PREFIX_TAGS))
_OPENED = f"CASE doc_id % {len(T.PREFIX_TAGS) + 1} " + " ".join(f"WHEN {i} THEN '{p.capitalize()} '" for i, (p, _) in enumerate(T.PREFIX_TAGS)) + " ELSE ' ' END"


@query(f"""WITH d AS (SELECT doc_id, lower(trim(list_filter(string_split({_OPENED} || text, chr(10)), lambda x: trim(x, ' ') <> '')[1], ' ')) AS f FROM documents),
t AS (SELECT doc_id, t, min(i) AS i FROM d JOIN (VALUES {_PREFIXES}) v(i, p, t) ON starts_with(f, p) GROUP BY doc_id, t) SELECT doc_id, coalesce(string_agg(t, ',' ORDER BY i), '') AS tags FROM documents LEFT JOIN t USING (doc_id) GROUP BY doc_id""")
def tag_detection(spark, sf_dir):
    """Each document behind one of the openings, or none, by its id."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.auto_tags(F.concat(F.expr(_OPENED), "text")), ",").alias("tags"))


@query(r"SELECT page_id, regexp_replace(lower(url), '[^\p{L}\p{N}-]', '-', 'g') AS topic FROM pages")
def topic_sanitising(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.topic_name(F.col("url")).alias("topic"))


@query(f"WITH {ENTRIES} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM entries) GROUP BY tag")
def tag_histogram(spark, sf_dir):
    return O.tag_counts(entries(spark, sf_dir))


_DICT = "dict AS (SELECT tag, row_number() OVER (ORDER BY n DESC, tag) - 1 AS bit FROM (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM entries) GROUP BY tag) QUALIFY bit < 32)"


@query(f"WITH {ENTRIES}, {_DICT} SELECT entry_id, coalesce(bit_or(1::BIGINT << bit::INT), 0) AS bitmap FROM (SELECT entry_id, unnest(tags) AS tag FROM entries) LEFT JOIN dict USING (tag) GROUP BY entry_id")
def tag_bitmaps(spark, sf_dir):
    return O.tag_bitmaps(entries(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT count(DISTINCT topic) AS topics, count(*) AS entries, count(*) FILTER (len(tags) > 0) AS tagged, strftime(make_timestamp(min(ts_min) * 60000000), '%Y-%m-%d') AS oldest, strftime(make_timestamp(max(ts_min) * 60000000), '%Y-%m-%d') AS newest, (SELECT count(DISTINCT u.tag) FROM (SELECT unnest(tags) AS tag FROM entries) u) AS unique_tags FROM entries")
def store_overview(spark, sf_dir):
    return O.overview(entries(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT topic, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, arg_max({_cut(_FIRST, 70)}, entry_id) AS preview FROM entries GROUP BY topic")
def topic_listing(spark, sf_dir):
    return O.topics(entries(spark, sf_dir))


@query(f"WITH {ENTRIES}, {_AGE}, s AS (SELECT topic, count(*) AS n, min(days_old) AS days, arg_min(entry_id, days_old * 1000000000 + entry_id) AS freshest FROM aged GROUP BY topic) SELECT topic, n, days, freshest, round(n * (1 + 1 / (1 + days / 7::DOUBLE)), 6) AS weight FROM s ORDER BY n * (1 + 1 / (1 + days / 7::DOUBLE)) DESC, topic LIMIT 8")
def topic_ranking(spark, sf_dir):
    return O.topic_ranking(entries(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {ENTRIES}, {_AGE}, t AS (SELECT unnest(tags) AS tag FROM aged WHERE days_old <= 7) SELECT tag, count(*) AS n FROM t WHERE tag <> 'raw-data' GROUP BY tag ORDER BY n DESC, tag LIMIT 8")
def tag_themes(spark, sf_dir):
    return O.themes(entries(spark, sf_dir))


@query(f"WITH {ENTRIES}, {_AGE} SELECT count(*) FILTER (days_old <= 1) AS last_1, count(*) FILTER (days_old <= 7) AS last_7, count(*) FILTER (days_old <= 30) AS last_30 FROM aged")
def velocity(spark, sf_dir):
    return O.velocity(entries(spark, sf_dir))


@query(f"WITH {ENTRIES}, {_AGE} SELECT topic, count(*) AS n, max(ts_min // 1440) AS newest_day, min(days_old) > 1 AS stale FROM aged GROUP BY topic")
def topic_staleness(spark, sf_dir):
    return O.stale_topics(entries(spark, sf_dir), 1)


@query(f"WITH {ENTRIES} SELECT entry_id, topic, strftime(make_timestamp(ts_min * 60000000), '%Y-%m-%d %H:%M') AS date FROM entries WHERE ts_min >= (SELECT max(ts_min) FROM entries) - 36 * 60")
def recent_hours(spark, sf_dir):
    return O.recent(entries(spark, sf_dir), days=7, hours=36)


@query(f"WITH {ENTRIES} SELECT entry_id, topic, strftime(make_timestamp(ts_min * 60000000), '%Y-%m-%d %H:%M') AS date FROM entries WHERE ts_min // 1440 >= (SELECT max(ts_min) // 1440 FROM entries) - 3")
def recent_days(spark, sf_dir):
    return O.recent(entries(spark, sf_dir), days=3)


@query(f"WITH {ENTRIES} SELECT topic, '## ' || topic || chr(10) || string_agg('- ' || {_cut(_FIRST, 80)}, chr(10) ORDER BY entry_id) AS text FROM entries GROUP BY topic")
def topic_digest(spark, sf_dir):
    return O.digest(entries(spark, sf_dir))


@query(f"WITH {ENTRIES}, big AS (SELECT topic FROM entries GROUP BY topic HAVING count(*) >= 10), want AS (SELECT topic, unnest(['de', 'fr', 'architecture']) AS tag FROM big) SELECT topic, tag FROM want WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.topic = want.topic AND list_contains(e.tags, want.tag))")
def tag_gaps(spark, sf_dir):
    return O.tag_gaps(entries(spark, sf_dir), ("de", "fr", "architecture"))


@query(f'WITH {ENTRIES} SELECT entry_id, topic, row_number() OVER (PARTITION BY topic ORDER BY entry_id) - 1 AS idx, entry_id = max(entry_id) OVER (PARTITION BY topic) AS "last" FROM entries')
def topic_index(spark, sf_dir):
    return O.indexed(entries(spark, sf_dir)).select("entry_id", "topic", "idx", "last")
