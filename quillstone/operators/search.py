"""Ranked retrieval: BM25 with filters, boosts and a fall back from all terms to any term.

An ad-hoc query reads the corpus once for its statistics and once for its scores, both without a
shuffle of entries: each entry's term counts are sums over its own token array, the statistics are
one row, and the result is a top-k of narrow rows. Each pass makes an entry's tokens once, and the
second only those of entries that hold the letters of a term. Many queries use the written index.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Filter:
    """Days are inclusive; tag and topic are exact; of tags, an entry must have all."""

    after: int | None = None
    before: int | None = None
    tag: str | None = None
    topic: str | None = None
    tags: tuple[str, ...] = ()

    def on(self, df: DataFrame) -> DataFrame:
        day = F.col("day") if "day" in df.columns else T.day_of(F.col("ts_min"))
        if self.topic is not None:
            df = df.where(F.col("topic") == self.topic)
        if self.after is not None:
            df = df.where(day >= self.after)
        if self.before is not None:
            df = df.where(day <= self.before)
        for tag in (*self.tags, *((self.tag,) if self.tag is not None else ())):
            df = df.where(F.array_contains("tags", tag))
        return df


#: Hits that a session's phase asks for where no limit is given; fixed values.
PHASE_LIMITS = {"research": 10, "build": 5, "verify": 5, "debug": 8}
#: Days before today that a date's name stands for; fixed values.
SHORTCUTS = {"today": 0, "yesterday": 1, "this-week": 7, "this_week": 7, "week": 7, "this-month": 30, "this_month": 30, "month": 30}


def day_number(date: str, today: int) -> int | None:
    """A shortcut or `YYYY-MM-DD…` as days since the epoch; null for anything else. Days of a month up to 31
    run over into the next, as February 31 does into March."""
    if date in SHORTCUTS:
        return today - SHORTCUTS[date]
    m = re.match(r"(\d{4})-(\d{2})-(\d{2})", date)
    if not m or not 1 <= int(m[2]) <= 12 or not 1 <= int(m[3]) <= 31:
        return None
    return (datetime.date(int(m[1]), int(m[2]), 1) - datetime.date(1970, 1, 1)).days + int(m[3]) - 1


def request_filter(now_min: int, after: str = "", before: str = "", days: int | None = None, hours: int | None = None, tag: str | None = None, topic: str | None = None) -> Filter:
    """The filter that a request asks for at a minute: `after` wins over hours, and hours over days."""
    today = now_min // 1440
    first = day_number(after, today) if after else (now_min - hours * 60) // 1440 if hours is not None else today - days if days is not None else None
    return Filter(first, day_number(before, today) if before else None, tag or None, topic or None)


def _is(term: str):
    return lambda t: t == term


def _holds(term: str):
    return lambda g: g.contains(term)


def _letters(terms: list[str]) -> str:
    """What a text must match to have one of the terms as a token, whatever the case."""
    return "(?iu)" + "|".join(re.escape(t) for t in terms)


def counted(entries: DataFrame, terms: list[str]) -> DataFrame:
    """entries with tfs (count of each term), hits (terms present) and wc (number of tokens).

    Tokens are made, once, only of entries that hold the letters of a term or have compounds; others
    have as many tokens as runs."""
    body = F.coalesce("body", F.lit(""))
    need = body.rlike(T.COMPOUND)
    if terms:
        need = body.rlike(_letters(terms)) | need
    df = entries.withColumn("ts", T.once(F.when(need, T.tokens(body))))
    tfs = F.array(*(F.when(F.col("ts").isNull(), 0).otherwise(F.size(F.filter("ts", _is(q)))) for q in terms)) if terms else F.array().cast("array<int>")
    wc = F.when(F.col("ts").isNull(), F.regexp_count(body, F.lit(T.LONG_SEGMENT))).otherwise(F.size("ts"))
    df = df.select(*(c for c in entries.columns), wc.alias("wc"), T.once(tfs).alias("tfs"))
    return df.withColumn("hits", F.size(F.filter("tfs", lambda x: x > 0)))


def _may_hold(entries: DataFrame, terms: list[str], every: bool) -> DataFrame:
    """entries without those whose letters hold none (or not all) of the terms, whose tokens needn't be made."""
    body = F.coalesce("body", F.lit(""))
    for some in [[t] for t in terms] if every else [terms] if terms else []:
        entries = entries.where(body.rlike(_letters(some)))
    return entries


def _stats(df: DataFrame, k: int) -> DataFrame:
    """One row: n, avgdl, the entries with all terms (full) and those with each (dfs)."""
    return df.agg(
        F.count("*").alias("n"), F.avg("wc").alias("avgdl"), F.count_if(F.col("hits") == k).alias("full"),
        F.array(*(F.count_if(F.get("tfs", F.lit(i)) > 0) for i in range(k))).alias("dfs") if k else F.array().cast("array<bigint>").alias("dfs"),
    )


def _chosen(entries: DataFrame, terms: list[str], mode: str) -> DataFrame:
    """Entries that have all terms, or any term if mode is "or" or no entry has all of them, counted; with
    the corpus statistics, one row, beside each."""
    k = len(terms)
    if not k:
        return counted(entries.where(F.lit(False)), terms).crossJoin(_stats(counted(entries, terms), 0).limit(1))
    df = counted(_may_hold(entries, terms, False), terms).crossJoin(F.broadcast(_stats(counted(entries, terms), k)))
    any_ok = F.lit(mode == "or") | ((F.col("full") == 0) & F.lit(k >= 2))
    return df.where((F.col("hits") == k) | any_ok & (F.col("hits") > 0))


def _bm25(k: int) -> Column:
    norm = 1 - B + B * F.col("wc") / F.greatest(F.col("avgdl"), F.lit(1.0))
    total = F.lit(0.0)
    for i in range(k):
        tf, df = F.get("tfs", F.lit(i)), F.get("dfs", F.lit(i))
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        total = total + F.when(tf > 0, idf * (tf * (K1 + 1)) / (tf + K1 * norm)).otherwise(0.0)
    return total


def search(entries: DataFrame, query: str, mode: str = "and", limit: int | None = 20, where: Filter = Filter(), boost: bool = True) -> DataFrame:
    """(entry_id, topic, score) by score, then id. A query without terms matches nothing."""
    terms = T.query_terms(query)
    df = _chosen(where.on(entries), terms, mode).withColumn("score", _bm25(len(terms)))
    if boost and terms:
        df = df.withColumn("score", F.col("score") * boosts(terms))
    df = df.where("score > 0").select("entry_id", "topic", "score").orderBy(F.desc("score"), "entry_id")
    return df.limit(limit) if limit is not None else df


def match_counts(entries: DataFrame, query: str, mode: str = "and", where: Filter = Filter()) -> DataFrame:
    """(topic, matches) of entries that match; the sum and the number of rows are the count tool's."""
    terms = T.query_terms(query)
    return _chosen(where.on(entries), terms, mode).groupBy("topic").agg(F.count("*").alias("matches"))


def grouped(entries: DataFrame, query: str, per_topic: int = 5, mode: str = "and") -> DataFrame:
    """The best entries of each topic, topics by their best score, with how many more there are."""
    rows = search(entries, query, mode, limit=None)
    by = Window.partitionBy("topic")
    rows = rows.select("*", F.row_number().over(by.orderBy(F.desc("score"), "entry_id")).alias("rank"), F.max("score").over(by).alias("best"), (F.count("*").over(by) - per_topic).alias("more"))
    return rows.where(F.col("rank") <= per_topic).withColumn("more", F.greatest("more", F.lit(0)))


# Index tables: written once for each log version, read by many queries.


def postings(entries: DataFrame) -> DataFrame:
    """(entry_id, term, tf)."""
    return entries.select("entry_id", F.explode(T.tokens(F.col("body"))).alias("term")).groupBy("entry_id", "term").agg(F.count("*").alias("tf"))


def term_stats(post: DataFrame, n: int | Column) -> DataFrame:
    """(term, df, idf_x1000): inverse frequency as the index stores it, in thousandths."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf_x1000", _idf_x1000(F.lit(n), F.col("df")))


def _idf_x1000(n: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((n - df + 0.5) / (df + 0.5) + 1))


def entry_meta(entries: DataFrame) -> DataFrame:
    """(entry_id, topic, wc, day, confidence_u8, ts_min)."""
    return entries.select("entry_id", "topic", F.size(T.tokens(F.col("body"))).alias("wc"), T.day_of(F.col("ts_min")).alias("day"), F.floor(F.col("confidence") * 255).alias("confidence_u8"), "ts_min")


def index_info(entries: DataFrame) -> DataFrame:
    meta = entry_meta(entries)
    return meta.agg(F.count("*").alias("entries"), F.countDistinct("topic").alias("topics"), F.floor(100 * F.avg("wc")).alias("avgdl_x100"))


def _index_scores(part: Column, hits: DataFrame, k: int, mode: str, raw: bool) -> DataFrame:
    """hits with the score: the sum of the terms' parts times confidence and recency. raw: any term, and
    the score in whole thousandths."""
    rows = hits.where(F.col("hits") == k) if mode == "and" and not raw else hits.where("hits > 0")
    recency = F.when(F.col("day") == 0, 1.0).otherwise(1 / (1 + (F.col("as_of") - F.col("day")) / 30))
    score = part * F.col("confidence_u8") / 255 * recency
    return rows.withColumn("score", F.floor(1000 * score).cast("long") if raw else score)


def _term_part(tf: Column, idf_x1000: Column) -> Column:
    norm = 1 - B + B * F.col("wc") / F.greatest(F.col("avgdl_x100") / 100, F.lit(1.0))
    return idf_x1000 / 1000 * (tf * (K1 + 1)) / (tf + K1 * norm)


def index_search(entries: DataFrame, query: str, limit: int = 20, mode: str = "and", raw: bool = False) -> DataFrame:
    """What the index built of these entries would give, without building it: scores from quantised
    statistics, times confidence and recency. raw: any term, and the score in whole thousandths."""
    terms = T.query_terms(query)
    k, day = len(terms), T.day_of(F.col("ts_min"))
    e = entries.select("entry_id", "topic", "body", day.alias("day"), F.floor(F.col("confidence") * 255).alias("confidence_u8"))
    stats = counted(e, terms).agg(
        F.count("*").alias("n"), F.floor(100 * F.avg("wc")).alias("avgdl_x100"), (F.max("day") + 1).alias("as_of"),
        F.array(*(F.count_if(F.get("tfs", F.lit(i)) > 0) for i in range(k))).alias("dfs") if k else F.array().cast("array<bigint>").alias("dfs"),
    )
    hits = counted(_may_hold(e, terms, mode == "and" and not raw), terms).crossJoin(F.broadcast(stats))
    part = F.lit(0.0)
    for i in range(k):
        tf, df = F.get("tfs", F.lit(i)), F.get("dfs", F.lit(i))
        part = part + F.when(tf > 0, _term_part(tf, _idf_x1000(F.col("n"), df))).otherwise(0.0)
    return _index_scores(part, hits, k, mode, raw).select("entry_id", "topic", "score").orderBy(F.desc("score"), "entry_id").limit(limit)


#: Layout of the written index; readers refuse another.
INDEX_VERSION = 1
INDEX_TABLES = ("postings", "term_stats", "entry_meta", "info")


def write_index(entries: DataFrame, path: str, log_version: int = 0) -> None:
    """Write the tables of an index below path. Postings lie in term order, so that a query reads few row
    groups; the corpus is tokenised once for them, and all other tables come from what was written."""
    spark, at = entries.sparkSession, path.rstrip("/")
    post = postings(entries).repartitionByRange("term").sortWithinPartitions("term", "entry_id")
    post.write.mode("overwrite").option("parquet.block.size", str(16 << 20)).parquet(f"{at}/postings")
    post = spark.read.parquet(f"{at}/postings")
    counts = post.groupBy("entry_id").agg(F.sum("tf").alias("wc"))
    snippet = T.snippet(F.col("topic"), F.col("ts_min"), F.col("body"))
    source = F.col("source") if "source" in entries.columns else F.lit(None).cast("string").alias("source")
    own = entries.select("entry_id", "topic", "tags", source, T.day_of(F.col("ts_min")).alias("day"), F.floor(F.col("confidence") * 255).alias("confidence_u8"), "ts_min", snippet.alias("snippet"))
    meta = own.join(counts, "entry_id", "left").withColumn("wc", F.coalesce("wc", F.lit(0)))
    meta.repartitionByRange("entry_id").sortWithinPartitions("entry_id").write.mode("overwrite").parquet(f"{at}/entry_meta")
    meta = spark.read.parquet(f"{at}/entry_meta")
    info = meta.agg(F.count("*").alias("n"), F.countDistinct("topic").alias("topics"), F.floor(100 * F.avg("wc")).alias("avgdl_x100"), (F.max("day") + 1).alias("as_of"))
    info = info.select("*", F.lit(INDEX_VERSION).alias("version"), F.lit(log_version).alias("log_version"))
    info.coalesce(1).write.mode("overwrite").parquet(f"{at}/info")
    term_stats(post, info.first().n).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/term_stats")


class Index:
    """The tables that write_index wrote, for reading."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.info = self._table("info")
        head = self.info.select("version", "log_version").first()
        if head is None or head.version != INDEX_VERSION:
            raise ValueError(f"index version {head and head.version}, not {INDEX_VERSION}: write it anew")
        self.log_version = head.log_version

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def hits(self, query: str, mode: str = "and", where: Filter = Filter(), raw: bool = False) -> DataFrame:
        """(entry_id, topic, tags, snippet, score) of all entries that match. One scan of postings, filtered by
        term; the terms' statistics have a row for each term of the query, and are broadcast."""
        terms = T.query_terms(query)
        few = self._table("term_stats").where(F.col("term").isin(terms)).select("term", "idf_x1000")
        post = self._table("postings").where(F.col("term").isin(terms)).join(F.broadcast(few), "term")
        rows = post.groupBy("entry_id").agg(F.collect_list(F.struct("tf", "idf_x1000")).alias("ps"), F.count("*").alias("hits"))
        if mode == "and" and not raw:
            rows = rows.where(F.col("hits") == len(terms))
        meta = where.on(self._table("entry_meta"))
        rows = rows.join(meta, "entry_id").crossJoin(F.broadcast(self.info.select("avgdl_x100", "as_of")))
        part = F.aggregate("ps", F.lit(0.0), lambda a, p: a + _term_part(p.tf, p.idf_x1000))
        return _index_scores(part, rows, len(terms), mode, raw).select("entry_id", "topic", "tags", "snippet", "score")

    def search(self, query: str, limit: int = 20, mode: str = "and", where: Filter = Filter(), diverse: bool = True, boost: bool = True) -> DataFrame:
        """(entry_id, topic, snippet, score): the top of the hits, of any term if none has all; no topic fills it
        (see diverse_top) if diverse. Boosts by topic and tags re-rank inside this top only."""
        terms = T.query_terms(query)
        hits = self.hits(query, mode, where)
        if mode == "and" and len(terms) >= 2 and hits.isEmpty():
            hits = self.hits(query, "or", where)
        top = diverse_top(hits.select("entry_id", "topic", "score"), limit) if diverse else hits.orderBy(F.desc("score"), "entry_id").select("entry_id", "topic", "score").limit(limit)
        rows = top.join(self._table("entry_meta").select("entry_id", "tags", "snippet"), "entry_id")
        return rows.withColumn("score", F.col("score") * boosts(terms) if boost else F.col("score")).select("entry_id", "topic", "snippet", "score").orderBy(F.desc("score"), "entry_id")

    def search_raw(self, query: str, limit: int = 20) -> DataFrame:
        """(entry_id, topic, score): any term, no filter, scores in whole thousandths, lower ids first on ties."""
        return self.hits(query, "or", raw=True).select("entry_id", "topic", "score").orderBy(F.desc("score"), "entry_id").limit(limit)

    def is_stale(self, log_version: int) -> bool:
        return log_version != self.log_version


def boosts(terms: list[str]) -> Column:
    """1.5 if the topic holds a term, times 0.3 more for each term that a tag holds."""
    in_topic = F.lit(False)
    for t in terms:
        in_topic = in_topic | F.col("topic").contains(t)
    tag_hits = sum((F.when(F.exists("tags", _holds(t)), 1).otherwise(0) for t in terms), F.lit(0))
    return F.when(in_topic, 1.5).otherwise(1.0) * (1 + 0.3 * tag_hits)


def diverse_top(hits: DataFrame, limit: int, cap: int = 3, factor: float = 1.5) -> DataFrame:
    """Bounded top-k of hits (entry_id, topic, score): once `limit` are held, a topic that holds `cap` needs
    more than `factor` times the least score held. Each step depends on those before, in the order of
    ids, so one task folds hits, and holds `limit` of them. The tasks that make the hits drop those that no
    order can hold: a score with more than `limit` scores at lower ids that are over `factor` times as high."""

    def possible(batches):
        import heapq

        best: list[float] = []
        for batch in batches:
            keep = []
            for s in batch.column(2).to_pylist():
                # one of these best isn't held, so the least score held is at least theirs by factor
                keep.append(not (len(best) > limit and 0 < best[0] and s < best[0] / max(factor, 1.0) * (1 - 1e-9)))
                if len(best) <= limit:
                    heapq.heappush(best, s)
                elif s > best[0]:
                    heapq.heapreplace(best, s)
            yield batch.filter(pa.array(keep, pa.bool_()))

    def fold(batches):
        import heapq

        held: list[tuple[float, int, str]] = []
        for batch in batches:
            for e, t, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if len(held) < limit:
                    heapq.heappush(held, (s, -e, t))
                elif s > held[0][0] and (sum(x[2] == t for x in held) < cap or s > factor * held[0][0]):
                    heapq.heapreplace(held, (s, -e, t))
        yield pa.RecordBatch.from_arrays([pa.array([-e for _, e, _ in held], pa.int64()), pa.array([t for *_, t in held], pa.string()), pa.array([s for s, *_ in held], pa.float64())], names=["entry_id", "topic", "score"])

    rows = hits.select(F.col("entry_id").cast("long"), "topic", F.col("score").cast("double")).sortWithinPartitions("entry_id")
    schema = "entry_id long, topic string, score double"
    return rows.mapInArrow(possible, schema).repartition(1).sortWithinPartitions("entry_id").mapInArrow(fold, schema)


def symbol_query(symbols: list[str], stem: str, most: int = 15) -> str:
    """The first terms, sorted, of a file's symbols: tokens of three bytes or more but the file's own stem."""
    return " ".join(sorted({t for x in symbols for t in T._py_tokens(x) if len(t.encode()) >= 3 and t != stem.lower()})[:most])


def layered(entries: DataFrame, file: str, symbols: list[str] = [], removed: list[str] = [], injected: DataFrame | None = None, find=None) -> DataFrame:
    """(entry_id, layer, rank): what bears on a file, each entry in the first layer that has it.

    Layer 1 are entries with the file as source, all of them, in log order (rank 0). Then come 2: up to five
    of eight hits of any of the file's symbols, if layer 1 has under five; 3: up to three of five hits of its
    stem; 4: three hits of `structural` and the stem; 5: three hits of each removed symbol. Entries that were
    injected (entry_id) are left out before any is counted as taken. find(query, limit, mode) gives hits
    (entry_id, score); without one, the entries are searched. At most 16 hits and three for each removed
    symbol come to the driver, where one layer's choice depends on those before.
    """
    name = file.rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    find = find or (lambda query, limit, mode: index_search(entries, query, limit, mode))
    own = entries.where(F.coalesce(T.source_is(F.col("source"), name), F.lit(False))).select("entry_id")
    asked = [(3, stem, 5, 3, "and"), (4, f"structural {stem}", 3, 3, "and"), *((5, x, 3, 3, "and") for x in removed)]
    words = symbol_query(symbols, stem) if own.limit(5).count() < 5 else ""
    if words:
        asked.insert(0, (2, words, 8, 5, "or"))
    hits = None
    for no, (_, query, limit, _, mode) in enumerate(asked):
        rows = find(query, limit, mode).select("entry_id", "score", F.lit(no).alias("no"))
        hits = rows if hits is None else hits.unionByName(rows)
    first = own if injected is None else own.join(injected, "entry_id", "left_anti")
    hits = hits.join(own, "entry_id", "left_anti")
    hits = hits if injected is None else hits.join(injected, "entry_id", "left_anti")
    taken: dict[int, tuple[int, int]] = {}
    found = sorted(hits.collect(), key=lambda r: (r.no, -r.score, r.entry_id))
    for no, (layer, _, _, most, _) in enumerate(asked):
        fresh = [r.entry_id for r in found if r.no == no and r.entry_id not in taken][:most]
        taken |= {e: (layer, rank) for rank, e in enumerate(fresh)}
    later = entries.sparkSession.createDataFrame([(e, *x) for e, x in taken.items()], "entry_id long, layer int, rank int")
    return first.select("entry_id", F.lit(1).alias("layer"), F.lit(0).alias("rank")).unionByName(later)


def line_hits(entries: DataFrame, query: str) -> DataFrame:
    """(entry_id, line_no, line): lines that hold a term of the query, whatever its case."""
    terms = T.query_terms(query)
    rows = entries.select("entry_id", F.posexplode(T.lines(F.col("body"))).alias("line_no", "line"))
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.lower("line").contains(t)
    return rows.where(hit)


def similar_tags(entries: DataFrame, tag: str, most: int = 5, top: int = 8) -> DataFrame:
    """(tag, n): tags that hold `tag` or stand in it, most frequent first; if there are none, the `top` most
    frequent tags."""
    counts = entries.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    tag = tag.lower()
    rows = counts.withColumn("like", F.col("tag").contains(tag) | F.lit(tag).contains(F.col("tag")))
    order = Window.orderBy(F.desc("like"), F.desc("n"), "tag")
    first = rows.orderBy(F.desc("like"), F.desc("n"), "tag").limit(max(most, top)).withColumn("no", F.row_number().over(order)).withColumn("any", F.max("like").over(Window.partitionBy()))
    return first.where((F.col("any") & F.col("like") & (F.col("no") <= most)) | (~F.col("any") & (F.col("no") <= top))).select("tag", "n")
