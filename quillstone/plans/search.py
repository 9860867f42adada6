"""Retrieval queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..session import workspace
from ..sources.views import entries
from .registry import ENTRIES, TF, TOKENS, query, sql_tokens


def _score_sql(terms: list[str], mode: str = "and", where: str = "true", limit: int | None = 20, boost: bool = True) -> str:
    k = len(terms)
    tf = ", ".join(f"len(list_filter(ts, lambda t: t = '{t}')) AS f{i}" for i, t in enumerate(terms))
    hits = " + ".join(f"(f{i} > 0)::INT" for i in range(k))
    part = " + ".join(f"CASE WHEN f{i} > 0 THEN ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE) + 1) * (f{i} * 2.2::DOUBLE) / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * wc / greatest(avgdl, 1))) ELSE 0 END" for i in range(k))
    boosts = f" * CASE WHEN {' OR '.join(f"contains(topic, '{t}')" for t in terms)} THEN 1.5::DOUBLE ELSE 1::DOUBLE END * (1 + 0.3::DOUBLE * ({' + '.join(f"(len(list_filter(tags, lambda g: contains(g, '{t}'))) > 0)::INT" for t in terms)}))" if boost else ""
    ok = f"hits > 0 AND (hits = {k} OR {str(mode == 'or').lower()} OR (\"full\" = 0 AND {k} >= 2))"
    return f"""WITH {ENTRIES}, f AS (SELECT * FROM entries WHERE {where}),
t AS (SELECT entry_id, topic, tags, {sql_tokens('body')} AS ts FROM f),
c AS (SELECT entry_id, topic, tags, len(ts) AS wc, {tf} FROM t), h AS (SELECT *, {hits} AS hits FROM c),
s AS (SELECT count(*) AS n, avg(wc) AS avgdl, count(*) FILTER (hits = {k}) AS "full", {', '.join(f'count(*) FILTER (f{i} > 0) AS d{i}' for i in range(k))} FROM h),
r AS (SELECT entry_id, topic, ({part}){boosts} AS score FROM h, s WHERE {ok})
SELECT entry_id, topic, round(score, 6) AS score FROM r ORDER BY r.score DESC, entry_id {f'LIMIT {limit}' if limit else ''}"""


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query(_score_sql(["apache", "license"]))
def bm25_and(spark, sf_dir):
    return _rounded(S.search(entries(spark, sf_dir), "Apache License with"))


@query(_score_sql(["idiot", "license", "clown"], "or"))
def bm25_or(spark, sf_dir):
    return _rounded(S.search(entries(spark, sf_dir), "idiot license clown", "or"))


@query(_score_sql(["apache", "mit", "gnu"]))
def bm25_fallback(spark, sf_dir):
    return _rounded(S.search(entries(spark, sf_dir), "apache mit gnu"))


@query(_score_sql(["licensed", "under"], "and", "ts_min // 1440 BETWEEN 19725 AND 19755 AND list_contains(tags, 'en')"))
def bm25_filtered(spark, sf_dir):
    return _rounded(S.search(entries(spark, sf_dir), "licensed under", where=S.Filter(after=19725, before=19755, tag="en")))


@query(_score_sql(["src", "license"], "or", "topic = 'src3'"))
def bm25_topic_scope(spark, sf_dir):
    return _rounded(S.search(entries(spark, sf_dir), "src license", "or", where=S.Filter(topic="src3")))


@query(_score_sql(["en", "under"], "or", limit=30))
def bm25_tag_boost(spark, sf_dir):
    return _rounded(S.search(entries(spark, sf_dir), "en under", "or", limit=30))


_MATCH = _score_sql(["license", "version"], limit=None, boost=False)


@query(f"SELECT topic, count(*) AS matches FROM ({_MATCH}) GROUP BY topic")
def search_topic_hits(spark, sf_dir):
    return S.match_counts(entries(spark, sf_dir), "license version")


@query(f"SELECT count(*) AS total, count(DISTINCT topic) AS topics FROM ({_MATCH})")
def search_count(spark, sf_dir):
    return S.match_counts(entries(spark, sf_dir), "license version").agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("total"), F.count("*").alias("topics"))


@query(f"""SELECT topic, entry_id, score, rank, more FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, entry_id) AS rank,
greatest(count(*) OVER (PARTITION BY topic) - 2, 0) AS more FROM ({_score_sql(['license', 'licensed'], 'or', limit=None)})) WHERE rank <= 2""")
def search_grouped(spark, sf_dir):
    return _rounded(S.grouped(entries(spark, sf_dir), "license licensed", 2, "or")).select("topic", "entry_id", "score", "rank", "more")


@query(f"WITH {ENTRIES}, {TOKENS}, {TF} SELECT * FROM tf")
def index_postings(spark, sf_dir):
    return S.postings(entries(spark, sf_dir))


_N = "(SELECT count(*) FROM entries)"
_IDF = f"floor(1000 * ln(({_N} - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1))::BIGINT"


@query(f"WITH {ENTRIES}, {TOKENS}, {TF}, d AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT term, df, {_IDF} AS idf_x1000 FROM d")
def index_term_stats(spark, sf_dir):
    e = entries(spark, sf_dir)
    return S.term_stats(S.postings(e), e.count())


@query(f"WITH {ENTRIES}, {TOKENS} SELECT entry_id, topic, len(ts) AS wc, ts_min // 1440 AS day, floor(confidence * 255)::BIGINT AS confidence_u8, ts_min FROM toks")
def index_entry_meta(spark, sf_dir):
    return S.entry_meta(entries(spark, sf_dir))


@query(f"WITH {ENTRIES}, {TOKENS} SELECT count(*) AS entries, count(DISTINCT topic) AS topics, floor(100 * avg(len(ts)))::BIGINT AS avgdl_x100 FROM toks")
def index_info(spark, sf_dir):
    return S.index_info(entries(spark, sf_dir))


def _index_sql(terms: list[str], limit: int, raw: bool) -> str:
    some = ", ".join(f"'{t}'" for t in terms)
    score = "s * confidence_u8 / 255 * CASE WHEN day = 0 THEN 1 ELSE 1 / (1 + (as_of - day) / 30::DOUBLE) END"
    out = f"floor(1000 * {score})::BIGINT" if raw else score
    return f"""WITH {ENTRIES}, {TOKENS}, {TF}, meta AS (SELECT entry_id, topic, len(ts) AS wc, ts_min // 1440 AS day, floor(confidence * 255) AS confidence_u8 FROM toks),
a AS (SELECT count(*) AS n, floor(100 * avg(wc)) / 100 AS avgdl, max(day) + 1 AS as_of FROM meta), d AS (SELECT term, count(*) AS df FROM tf WHERE term IN ({some}) GROUP BY term),
r AS (SELECT entry_id, topic, day, confidence_u8, as_of, count(*) AS hits, sum(floor(1000 * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)) / 1000 * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * wc / greatest(avgdl, 1)))) AS s
FROM tf JOIN d USING (term) JOIN meta USING (entry_id), a GROUP BY ALL),
z AS (SELECT entry_id, topic, {out} AS score FROM r WHERE {'true' if raw else f'hits = {len(terms)}'})
SELECT entry_id, topic, {'score' if raw else 'round(score, 6) AS score'} FROM z ORDER BY z.score DESC, entry_id LIMIT {limit}"""


@query(_index_sql(["license", "under"], 20, False))
def index_search(spark, sf_dir):
    return _rounded(S.index_search(entries(spark, sf_dir), "license under"))


@query(_index_sql(["license", "idiot"], 25, True))
def index_search_raw(spark, sf_dir):
    return S.index_search(entries(spark, sf_dir), "license idiot", 25, raw=True)


@query()
def search_diverse_top(spark, sf_dir):
    hits = S.search(entries(spark, sf_dir), "license idiot under", "or", limit=None).select("entry_id", "topic", F.round("score", 6).alias("score"))
    return S.diverse_top(hits, 10)


@query(_index_sql(["license", "under"], 20, False))
def index_read(spark, sf_dir):
    """The index is written, opened and searched."""
    return _rounded(_written(spark, sf_dir).search("license under", 20, diverse=False, boost=False).select("entry_id", "topic", "score"))


@query(_index_sql(["license", "idiot"], 25, True))
def index_read_raw(spark, sf_dir):
    return _written(spark, sf_dir).search_raw("license idiot", 25)


def _written(spark, sf_dir):
    at = f"{workspace(spark)}/index/{uuid.uuid4().hex}"
    S.write_index(entries(spark, sf_dir), at)
    return S.Index(spark, at)


@query(f"""WITH {ENTRIES}, l AS (SELECT entry_id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS line_no FROM entries)
SELECT entry_id, line_no, line FROM l WHERE contains(lower(line), 'licensed') OR contains(lower(line), 'gnu')""")
def search_line_hits(spark, sf_dir):
    return S.line_hits(entries(spark, sf_dir), "licensed gnu")


@query(f"WITH {ENTRIES} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM entries) WHERE contains(tag, 'e') OR contains('e', tag) GROUP BY tag ORDER BY n DESC, tag LIMIT 5")
def search_similar_tags(spark, sf_dir):
    return S.similar_tags(entries(spark, sf_dir), "e")


@query(f"WITH {ENTRIES}, {TOKENS} SELECT entry_id, len(ts) AS n_tokens, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM toks")
def text_tokens(spark, sf_dir):
    e = entries(spark, sf_dir).select("entry_id", T.tokens(F.col("body")).alias("ts"))
    return e.select("entry_id", F.size("ts").alias("n_tokens"), F.md5(F.array_join("ts", " ")).alias("tokens_md5"))


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"SELECT item_id, array_to_string(list_distinct_in_order, ' ') AS terms FROM (SELECT item_id, list_filter(ts, lambda t, i: t NOT IN ({_STOPS}) AND list_position(ts, t) = i) AS list_distinct_in_order FROM (SELECT item_id, {sql_tokens('text')} AS ts FROM benchmark))")
def text_query_terms(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("terms"))


@query()
def ambient_layers(spark, sf_dir):
    """What bears on a file `under.rs`, where each topic is a source file."""
    e = entries(spark, sf_dir).withColumn("source", F.concat("topic", F.lit(".rs")))
    return S.layered(e, "lib/under.rs", ["LicenseHolder", "idiot"], ["the", "aller"])
