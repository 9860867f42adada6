"""Session queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as S
from ..session import ship
from ..sources.views import table
from .registry import query

_NUM = "g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS late FROM events), num AS (SELECT *, sum(late) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)"


@query(f"WITH {_NUM} SELECT user_id, session::BIGINT AS session, min(ts) AS started, max(ts) AS last_active, count(*) AS n FROM num GROUP BY user_id, session")
def session_windows(spark, sf_dir):
    return S.sessions(table(spark, sf_dir, "events"))


@query(f"""WITH {_NUM}, b AS (SELECT *, last_value(CASE WHEN event_type IN ('error', 'signup') THEN ts END IGNORE NULLS) OVER w AS bt, last_value(CASE WHEN event_type IN ('error', 'signup') THEN event_type END IGNORE NULLS) OVER w AS bk,
count(*) OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3, count(*) FILTER (event_type = 'click') OVER x AS c, count(*) FILTER (event_type = 'view') OVER x AS v, count(*) FILTER (event_type = 'purchase') OVER x AS p FROM num
WINDOW w AS (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN ts - bt < INTERVAL 300 SECOND THEN CASE bk WHEN 'signup' THEN 'verify' ELSE 'debug' END WHEN n3 < 3 THEN 'unknown' WHEN p >= 2 AND c >= 1 THEN 'debug' WHEN p >= 1 AND c = 0 THEN 'verify' WHEN c >= 2 THEN 'build' WHEN v >= 3 THEN 'research' ELSE 'unknown' END AS phase FROM b""")
def session_phases(spark, sf_dir):
    return S.phases(table(spark, sf_dir, "events"))


@query(f"WITH {_NUM} SELECT user_id, session::BIGINT AS session, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM num GROUP BY ALL")
def session_first_injected(spark, sf_dir):
    return S.first_injected(table(spark, sf_dir, "events"))


@query(f"WITH {_NUM}, f AS (SELECT user_id, session, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM num GROUP BY ALL) SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM f)")
def session_not_injected(spark, sf_dir):
    """Events that aren't the first of their kind in their session."""
    e = table(spark, sf_dir, "events")
    return S.not_yet_injected(e.select("event_id"), S.first_injected(e), ["event_id"]).select("event_id")


@query()
def session_debounce(spark, sf_dir):
    ship(spark)
    return S.debounced(table(spark, sf_dir, "events"), 48 * 3600)


@query(f"WITH {_NUM} SELECT user_id, session::BIGINT AS session, event_type, count(*) AS n FROM num GROUP BY ALL HAVING count(*) >= 3")
def session_focus(spark, sf_dir):
    return S.focus(table(spark, sf_dir, "events"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def session_latest(spark, sf_dir):
    return S.latest(table(spark, sf_dir, "events"), "user_id", "event_type")


_COMMAND = "CASE doc_id % 4 WHEN 0 THEN 'cargo build' WHEN 1 THEN 'ls remake' WHEN 2 THEN 'make all' ELSE 'npm run x' END"


@query(f"""WITH d AS (SELECT doc_id AS id, list_filter(string_split(replace(text, 'en', 'error'), chr(10)), lambda x: contains(x, 'error') AND length(x) > 10 AND length(x) < 300) AS ls FROM documents WHERE doc_id % 4 <> 1)
SELECT id, len(ls) = 0 AS ok, array_to_string(ls[1:5], '|') AS errors FROM d""")
def session_builds(spark, sf_dir):
    """Each document as the output of a command, with an error where it has `en`."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(_COMMAND).alias("command"), F.expr("replace(text, 'en', 'error')").alias("output"))
    return S.build_results(rows).withColumn("errors", F.array_join("errors", "|"))
