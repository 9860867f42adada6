"""Code queries over the documents written as source files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code as C
from ..sources.views import table
from .registry import query

_SOURCE = """s AS (SELECT doc_id AS d, doc_id || '.rs' AS file, unnest(regexp_split_to_array(text, '[.\n]')) AS s, generate_subscripts(regexp_split_to_array(text, '[.\n]'), 1) AS line_no FROM documents),
x AS (SELECT *, list_transform(regexp_extract_all(s, '[A-Za-z]{2,}'), lambda w: lower(w)) AS w, d + CASE WHEN d % 8 < 7 THEN 1 ELSE 0 END AS e FROM s),
y AS (SELECT *, coalesce(w[1], 'none') || '_' || d AS a, coalesce(w[2], 'none') || '_' || d AS b, coalesce(w[3], 'none') || '_' || e AS c FROM x),
lines AS MATERIALIZED (SELECT file, line_no, CASE (line_no + d) % 6 WHEN 0 THEN CASE WHEN d % 2 = 0 THEN 'pub ' ELSE '' END || 'fn ' || a || '(QueryPlan: u32) {' WHEN 1 THEN '    ' || b || '(1).unwrap(); } // ' || s
  WHEN 2 THEN '    let v = Vec::new(); println!("' || s || '");' WHEN 3 THEN '    let k = map.entry(' || a || ').or_insert(idx as u8); ' || c || '(k[idx]);' WHEN 4 THEN CASE WHEN d % 8 = 0 THEN 'pub fn main() {' ELSE '// fn ' || a || '() ' || s END
  ELSE 'unsafe { run_all(' || c || '(name)) }' END AS line FROM y)"""
_NOISE = ", ".join(f"'{w}'" for w in C.NOISE)
_FNS = r"""d AS (SELECT file, line_no, regexp_extract(line, '^(?:pub )?fn ([a-z0-9_]+)\(', 1) AS name, starts_with(line, 'pub') AS is_pub FROM lines WHERE regexp_matches(line, '^(pub )?fn ')),
fns AS MATERIALIZED (SELECT d.*, coalesce(lead(line_no) OVER (PARTITION BY file ORDER BY line_no) - 1, n) AS end_line FROM d JOIN (SELECT file, max(line_no) AS n FROM lines GROUP BY file) USING (file))"""
_CALLS = rf"""calls AS MATERIALIZED (SELECT x.file, x.line_no, x.callee, coalesce(f.name, '<module>') AS caller
FROM (SELECT file, line_no, unnest(list_distinct(regexp_extract_all(line, '([A-Za-z0-9_]{{2,}})\(', 1))) AS callee FROM lines WHERE NOT starts_with(trim(line, ' '), '//')) x
ASOF LEFT JOIN fns f ON f.file = x.file AND x.line_no >= f.line_no WHERE callee NOT IN ({_NOISE}) AND NOT coalesce(f.line_no = x.line_no AND f.name = callee, false))"""
_ALL = f"WITH RECURSIVE {_SOURCE}, {_FNS}, {_CALLS}, e AS MATERIALIZED (SELECT DISTINCT caller AS src, callee AS dst FROM calls)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a source file: each sentence gives a line that defines, calls, allocates, indexes,
    comments or is unsafe, by its number, with the sentence's words for names. Eight files in a row call
    one another."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.posexplode(F.split("text", r"[.\n]")).alias("i", "s"))
    w = F.transform(F.regexp_extract_all("s", F.lit("[A-Za-z]{2,}"), F.lit(0)), F.lower)
    rows = rows.select("d", "s", (F.col("i") + 1).alias("line_no"), w.alias("w"), (F.col("d") + F.when(F.col("d") % 8 < 7, 1).otherwise(0)).alias("e"))
    a, b, c = (F.concat(F.coalesce(F.get("w", F.lit(i)), F.lit("none")), F.lit("_"), of) for i, of in ((0, "d"), (1, "d"), (2, "e")))
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    kind, s = (F.col("line_no") + F.col("d")) % 6, F.col("s")
    line = (
        F.when(kind == 0, text(F.when(F.col("d") % 2 == 0, "pub ").otherwise(""), "fn ", a, "(QueryPlan: u32) {")).when(kind == 1, text("    ", b, "(1).unwrap(); } // ", s))
        .when(kind == 2, text('    let v = Vec::new(); println!("', s, '");')).when(kind == 3, text("    let k = map.entry(", a, ").or_insert(idx as u8); ", c, "(k[idx]);"))
        .when((kind == 4) & (F.col("d") % 8 == 0), "pub fn main() {").when(kind == 4, text("// fn ", a, "() ", s)).otherwise(text("unsafe { run_all(", c, "(name)) }"))
    )
    return rows.select(F.concat("d", F.lit(".rs")).alias("file"), "line_no", line.alias("line"))


@query(f"{_ALL} SELECT file, name, line_no, end_line, is_pub FROM fns")
def code_functions(spark, sf_dir):
    return C.functions(_lines(spark, sf_dir))


@query(f"{_ALL} SELECT * FROM calls")
def code_calls(spark, sf_dir):
    return C.calls(_lines(spark, sf_dir))


@query(f"{_ALL}, r(name, depth) AS (SELECT 'or_insert', 0 UNION SELECT src, depth + 1 FROM e JOIN r ON dst = name WHERE depth < 3 AND src <> '<module>') SELECT name, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY name")
def code_callers(spark, sf_dir):
    return C.callers(_lines(spark, sf_dir), "or_insert")


@query(f"{_ALL}, r(name) AS (SELECT DISTINCT name FROM fns WHERE name IN ('main', 'run') UNION SELECT dst FROM e JOIN r ON src = name), g AS (SELECT dst, count(*) AS n FROM e GROUP BY dst) SELECT file, name, line_no, name IN (SELECT name FROM r) AS live, coalesce(n, 0) AS in_degree FROM fns LEFT JOIN g ON dst = name")
def code_live(spark, sf_dir):
    return C.live_functions(_lines(spark, sf_dir))


@query(f"""{_ALL}, h AS (SELECT f.file AS dst, c.file AS src FROM (SELECT DISTINCT file, caller, callee FROM calls WHERE caller <> '<module>') c JOIN fns f ON f.name = c.callee AND f.is_pub AND f.file <> c.file),
t AS (SELECT file, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM (SELECT DISTINCT file, 0 AS i, 0 AS o FROM lines UNION ALL SELECT dst, 1, 0 FROM h UNION ALL SELECT src, 0, 1 FROM h) GROUP BY file)
SELECT file, i AS in_degree, o AS out_degree, CASE WHEN i + o >= 10 THEN 'HUB' WHEN i >= 5 THEN 'CORE' WHEN i + o = 0 THEN 'EDGE' ELSE '' END AS tag FROM t""")
def code_centrality(spark, sf_dir):
    return C.centrality(_lines(spark, sf_dir))


@query(r"""WITH l AS (SELECT source AS file, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT file, unnest(regexp_extract_all(line, '\b([A-Z][A-Za-z0-9_]{2,})\b', 1)) AS name FROM l)
SELECT name, count(DISTINCT file) AS files FROM n GROUP BY name HAVING count(DISTINCT file) >= 2 ORDER BY files DESC, name LIMIT 10""")
def code_type_hubs(spark, sf_dir):
    """Documents as lines of files, a file for each source."""
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.explode(F.split("text", "\n")).alias("line"))
    return C.type_hubs(lines)


@query(f"""WITH {_SOURCE}, u AS (SELECT file, line_no, line, string_split(line, 'name')[1] AS pre, ltrim(line[length(string_split(line, 'name')[1]) + 5:], ' ') AS post FROM lines WHERE contains(line, 'name') AND NOT starts_with(trim(line, ' '), '//'))
SELECT file, line_no, CASE WHEN regexp_matches(post, '^\\.(clone|to_string|to_owned)\\(\\)') THEN 'clone' WHEN regexp_matches(post, '^\\.(contains|starts_with|ends_with)\\(') THEN 'method_call' WHEN regexp_matches(post, '^\\.(entry|insert|get)\\(') THEN 'map_key'
WHEN post[1] = '.' THEN 'method_call' WHEN regexp_matches(line, '[=!]=') THEN 'comparison' WHEN regexp_matches(line, '(format|println|writeln|write)!|"\\{{') THEN 'format_arg'
WHEN regexp_matches(pre, '\\.(entry|insert)\\(') OR regexp_matches(pre, '\\[ *$') THEN 'map_key' ELSE 'field_access' END AS category FROM u""")
def code_usages(spark, sf_dir):
    return C.usages(_lines(spark, sf_dir), "name")


@query(f"{_ALL} SELECT file, count(*) AS loc, coalesce(any_value(p.n), 0) AS n_pub FROM lines l LEFT JOIN (SELECT file, count(*) AS n FROM fns WHERE is_pub GROUP BY file) p USING (file) GROUP BY file HAVING count(*) > 5 AND n_pub <= 1")
def code_thin_files(spark, sf_dir):
    return C.near_files(_lines(spark, sf_dir))


@query("""SELECT event_id AS no, CASE event_id % 4 WHEN 2 THEN 'panic' ELSE event_type END AS func, CASE event_id % 4 WHEN 2 THEN 'x.rs' ELSE user_id || '.rs' END AS file,
CASE event_id % 4 WHEN 2 THEN user_id ELSE event_id END AS line_no FROM events WHERE event_id % 4 < 3""")
def code_frames(spark, sf_dir):
    """Each event as a line of a trace: a numbered frame, one with `in`, a panic, or a frame of the runtime."""
    kind, user, event = F.col("event_id") % 4, F.col("user_id"), F.col("event_id")
    place = F.concat(user, F.lit(".rs:"), event)
    line = (
        F.when(kind == 0, F.concat(event, F.lit(": app::"), "event_type", F.lit(" at "), place)).when(kind == 1, F.concat(F.lit("  in "), "event_type", F.lit(" ("), place, F.lit(")")))
        .when(kind == 2, F.concat(F.lit("thread 'm' panicked at 'bad', x.rs:"), user)).otherwise(F.concat(event, F.lit(": core::call_once at "), place))
    )
    return C.frames(table(spark, sf_dir, "events").select(event.alias("no"), line.alias("line")))


@query(f"""WITH {_SOURCE}, c AS (SELECT *, trim(line, ' ') AS t FROM lines WHERE NOT starts_with(trim(line, ' '), '//')),
r AS (SELECT file, line_no, CASE WHEN contains(t, '.unwrap()') THEN 'unwrap' WHEN contains(t, '.expect(') THEN 'expect' WHEN contains(t, '[') AND NOT contains(t, '//') AND regexp_matches(t, 'as usize]|(idx|index|i|pos)]') THEN 'index' END AS risk FROM c
UNION ALL SELECT file, line_no, 'cast' FROM c WHERE regexp_matches(t, 'as u(8|16|32)') UNION ALL SELECT file, line_no, 'unsafe' FROM c WHERE contains(t, 'unsafe')) SELECT * FROM r WHERE risk IS NOT NULL""")
def code_risks(spark, sf_dir):
    return C.risks(_lines(spark, sf_dir))


_COSTS = ", ".join(f"('{p}', '{k}')" for p, k in C.COSTS)


@query(f"""{_ALL}, r(name, depth) AS (SELECT 'main', 0 UNION SELECT dst, depth + 1 FROM e JOIN r ON src = name WHERE depth < 3), m AS (SELECT name, min(depth) AS depth FROM r GROUP BY name),
c AS (SELECT f.name, l.line FROM lines l ASOF JOIN fns f ON f.file = l.file AND l.line_no >= f.line_no WHERE NOT starts_with(trim(l.line, ' '), '//'))
SELECT name, depth, k AS kind, count(*) AS n FROM c JOIN m USING (name) JOIN (VALUES {_COSTS}) v(p, k) ON contains(line, p) GROUP BY ALL""")
def code_costs(spark, sf_dir):
    return C.costs(_lines(spark, sf_dir), "main")


_WORDS = r"list_distinct(list_transform(list_filter(regexp_split_to_array({}, '[^\p{{L}}\p{{N}}_]+'), lambda w: strlen(w) >= 4 AND regexp_matches(w, '[A-Za-z]')), lambda w: lower(w)))"


@query(f"""WITH d AS (SELECT doc_id, text AS o, text[1:length(text) // 2] AS n FROM documents), w AS (SELECT doc_id, o, {_WORDS.format('o')} AS ow, {_WORDS.format('n')} AS nw FROM d)
SELECT doc_id, CASE WHEN strlen(o) < 8 THEN '' ELSE array_to_string((list_sort(list_filter(ow, lambda x: NOT list_contains(nw, x))))[1:3], ',') END AS names FROM w""")
def code_removed_symbols(spark, sf_dir):
    """What each document loses when it is cut to its first half."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("o"), F.expr("substring(text, 1, length(text) div 2)").alias("n"))
    return d.select("doc_id", F.array_join(C.removed_symbols(F.col("o"), F.col("n")), ",").alias("names"))


_SYMBOLS = " UNION ALL ".join(f"SELECT file, regexp_extract(line, '^.*?{w}([A-Za-z][\\p{{L}}\\p{{N}}_]*)', 1) AS name FROM plain" for w in C.SYMBOL_WORDS)


@query(f"""WITH {_SOURCE}, plain AS (SELECT * FROM lines WHERE line_no <= 500 AND NOT regexp_matches(trim(line, ' '), '^(//|#|/\\*)')), n AS (SELECT DISTINCT file, name FROM ({_SYMBOLS}) WHERE strlen(name) >= 3)
SELECT file, string_agg(name, ',' ORDER BY name) AS symbols FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY name) AS no FROM n) WHERE no <= 20 GROUP BY file""")
def code_symbols(spark, sf_dir):
    """As the operator is defined, the first 20 symbols of a file's first 500 lines."""
    return C.file_symbols(_lines(spark, sf_dir)).select("file", F.array_join("symbols", ",").alias("symbols"))
