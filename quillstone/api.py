"""The store as one object: a method for each tool. Readers return DataFrames, writers change the log."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import code, graph, search, similar, stats
from .sources.store import Log
from .sources.views import with_as_of


class KnowledgeStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Log(spark, path)

    def _one(self, topic: str, body, ts_min: int | None) -> DataFrame:
        now = int(time.time() // 60) if ts_min is None else ts_min
        return self.spark.range(1).select(F.lit(0).alias("pos"), T.topic_name(F.lit(topic)).alias("topic"), body.alias("body"), F.lit(now).alias("ts_min"))

    @staticmethod
    def _body(text: str, tags: str | None, source: str | None, confidence: float | None, links: str | None):
        t = F.array_join(T.normal_tags(F.split(F.lit(tags), ",")), ", ") if tags else F.array_join(T.auto_tags(F.lit(text)), ", ")
        return T.composed(F.lit(text), t, F.lit(source).cast("string"), F.lit(confidence).cast("double"), F.lit(links).cast("string"))

    # writers

    def store(self, topic: str, text: str, tags: str | None = None, source: str | None = None, confidence: float | None = None, links: str | None = None, ts_min: int | None = None, force: bool = False) -> dict:
        """Append an entry; what it repeats, which topics are alike and which links are broken is said, and hinders nothing."""
        e = self.log.entries()
        wanted = {x.rpartition(":")[0] for x in (links or "").split()}
        told = {
            "duplicate_of": None if force else similar.duplicate_probe(e, topic, text).first()[0],
            "similar_topics": [r[0] for r in graph.similar_topics(e, topic).collect()] if e.where(F.col("topic") == topic).isEmpty() else [],
            "broken_links": sorted(wanted - {r[0] for r in e.where(F.col("topic").isin(*wanted)).select("topic").distinct().collect()}) if wanted else [],
        }
        self.log.append(self._one(topic, self._body(text, tags, source, confidence, links), ts_min))
        return told

    def batch(self, items: list[dict]) -> int:
        """Append up to 30 entries, without those that repeat an earlier one of the batch; more are refused."""
        if len(items) > 30:
            raise ValueError(f"batch too large ({len(items)} entries, max 30)")
        rows = [(i, x.get("topic", "unknown"), x["text"]) for i, x in enumerate(items)]
        kept = {r.pos for r in similar.batch_kept(self.spark.createDataFrame(rows, "pos long, topic string, text string")).collect()}
        new = None
        for i, x in enumerate(items):
            if i in kept:
                row = self._one(x.get("topic", "unknown"), self._body(x["text"], x.get("tags"), x.get("source"), None, None), x.get("ts_min")).withColumn("pos", F.lit(i))
                new = row if new is None else new.unionByName(row)
        if new is not None:
            self.log.append(new)
        return len(kept)

    def _pick(self, topic: str, index: int | None = None, match: str | None = None, tag: str | None = None) -> DataFrame:
        """The entry at an index, the first that holds a text, the last with a tag, or the last."""
        e = self.log.entries().where(F.col("topic") == topic)
        if index is not None:
            return e.where(F.col("idx") == index)
        if match is not None:
            return e.join(F.broadcast(stats.first_match(e, topic, match)), "entry_id", "left_semi")
        if tag is not None:
            e = e.where(F.array_contains("tags", tag))
        return e.join(F.broadcast(e.agg(F.max("entry_id").alias("entry_id"))), "entry_id", "left_semi")

    def append(self, topic: str, text: str, **pick) -> None:
        self.log.replace(self._pick(topic, **pick), F.concat(F.rtrim("body"), F.lit("\n" + text)))

    def revise(self, topic: str, text: str, modified: str = "", **pick) -> None:
        head = F.array_join(F.filter(T.lines(F.col("body")), lambda x: x.rlike(T.METADATA_LINE) & ~x.startswith("[modified:")), "\n")
        mark = F.lit(f"[modified: {modified}]" if modified else None).cast("string")
        self.log.replace(self._pick(topic, **pick), F.concat_ws("\n", F.nullif(head, F.lit("")), mark, F.lit(text)))

    def delete(self, topic: str, all: bool = False, last: bool = False, **pick) -> None:
        """Tombstones for a topic's entries: all, the last, or the one that index or match picks."""
        if not (all or last or pick):
            raise ValueError("say which entry: last, all, index or match")
        rows = self.log.entries().where(F.col("topic") == topic) if all else self._pick(topic, **pick)
        self.log.append(None, rows.select("entry_id"))

    def tag(self, topic: str, add: str = "", remove: str = "", **pick) -> None:
        split = lambda s: T.normal_tags(F.split(F.lit(s), ","))
        tags = F.array_join(F.array_sort(F.array_except(F.array_union("tags", split(add)), split(remove))), ", ")
        rest = F.array_join(F.filter(T.lines(F.col("body")), lambda x: ~x.startswith("[tags: ")), "\n")
        self.log.replace(self._pick(topic, **pick), F.when(tags == "", rest).otherwise(F.concat(F.lit("[tags: "), tags, F.lit("]\n"), rest)))

    def rename(self, old: str, new: str) -> None:
        if not self.log.entries().where(F.col("topic") == new).isEmpty():
            raise ValueError(f"{new} exists; merge instead")
        self.merge(old, new)

    def merge(self, source: str, into: str) -> None:
        self.log.replace(self.log.entries().where(F.col("topic") == source), topic=F.lit(into))

    def compact(self, topic: str | None = None, apply: bool = False) -> DataFrame | int | None:
        """Pairs of a topic that overlap, or, to apply, how many were merged; without a topic, the log is vacuumed."""
        if topic is None:
            return self.log.vacuum()
        e = self.log.entries().where(F.col("topic") == topic)
        if not apply:
            return similar.compaction_pairs(e)
        new = similar.compactions(e).persist()
        n = new.count()
        if n:
            gone = new.select(F.explode(F.array("a", "b")).alias("entry_id")).distinct()
            self.log.append(new.withColumnRenamed("a", "pos"), gone)
        new.unpersist()
        return n

    def migrate(self, apply: bool = False, ts_min: int | None = None) -> DataFrame | int:
        """Entries without a time, or, to apply, how many were written anew with the present one."""
        e = self.log.entries().where("ts_min = 0")
        if not apply:
            return e
        n = e.count()
        if n:
            now = int(time.time() // 60) if ts_min is None else ts_min
            self.log.append(e.select(F.col("entry_id").alias("pos"), "topic", "body", F.lit(now).alias("ts_min")), e.select("entry_id"))
        return n

    def import_(self, json_rows: DataFrame) -> None:
        rows = stats.imported(json_rows)
        ts = F.coalesce(F.expr("try_to_timestamp(timestamp, 'yyyy-MM-dd HH:mm')").cast("long") / 60, F.lit(int(time.time() // 60)))
        body = F.when(F.size("tags") > 0, F.concat(F.lit("[tags: "), F.array_join("tags", ", "), F.lit("]\n"), "body")).otherwise(F.col("body"))
        self.log.append(rows.select(F.monotonically_increasing_id().alias("pos"), "topic", body.alias("body"), ts.cast("int").alias("ts_min")))

    # readers

    def filter(self, after: str = "", before: str = "", days: int | None = None, hours: int | None = None, tag: str | None = None, topic: str | None = None, today: int | None = None) -> search.Filter:
        """A request's filter; today: a day number, or now."""
        return search.request_filter(int(time.time() // 60) if today is None else today * 1440, after, before, days, hours, tag, topic)

    def search(self, query: str, detail: str = "full", limit: int | None = None, mode: str = "and", where: search.Filter = search.Filter(), phase: str | None = None, index: str | None = None) -> DataFrame:
        """Without a limit, the phase of the session gives one; else 20, with detail "index" 10, grouped 5 a topic.
        index: the folder that reindex wrote; searches with a text snippet then read it, not the log. Detail
        "index" looks at all entries, whatever the filter."""
        limit = search.PHASE_LIMITS.get(phase or "") if limit is None else limit
        if index is not None and detail in ("index", "medium", "brief"):
            ix = search.Index(self.spark, index)
            if detail == "index":
                return ix.search(query, limit or 10, mode, boost=False)
            return ix.search(query, limit or 20, mode, where).withColumnRenamed("snippet", "text")
        limit = 20 if limit is None and detail not in ("grouped", "index") else limit
        e = self.log.entries()
        if detail == "count":
            return search.match_counts(e, query, mode, where).agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("total"), F.count("*").alias("topics"))
        if detail == "topics":
            return search.match_counts(e, query, mode, where)
        if detail == "grouped":
            return search.grouped(e, query, limit or 5, mode)
        if detail == "index":
            return search.index_search(e, query, limit or 10, mode)
        hits = search.search(e, query, mode, limit, where)
        text = {"brief": T.truncated(T.first_content(F.col("body")), 80), "medium": T.snippet(F.col("topic"), F.col("ts_min"), F.col("body"))}.get(detail, F.col("body"))
        return hits.join(e.select("entry_id", text.alias("text")), "entry_id").orderBy(F.desc("score"), "entry_id")

    def read(self, topic: str) -> DataFrame:
        return self.log.entries().where(F.col("topic") == T.topic_name(F.lit(topic))).select("idx", T.date_text(F.col("ts_min")).alias("date"), "body").orderBy("idx")

    def topics(self) -> DataFrame:
        return stats.topics(self.log.entries())

    def recent(self, days: int | None = None, hours: int | None = None) -> DataFrame:
        return stats.recent(self.log.entries(), days, hours)

    def entries(self, topic: str, match: str | None = None) -> DataFrame:
        e = self.log.entries().where(F.col("topic") == topic)
        return e if match is None else e.where(F.lower("body").contains(match.lower()))

    def stats(self) -> DataFrame:
        return stats.overview(self.log.entries())

    def tags(self) -> DataFrame:
        return stats.tag_counts(self.log.entries())

    def stale(self, files: DataFrame) -> DataFrame:
        """files (path, mtime_min): sourced entries of which a file, or files of a glob, are newer than they are."""
        return stats.stale_sources(self.log.entries(), files)

    def xref(self) -> DataFrame:
        return graph.mentions(self.log.entries())

    def graph(self, focus: str = "*") -> DataFrame:
        return graph.degrees(self.xref()).where(F.col("topic").rlike(T.glob_pattern(focus)))

    def trace(self, mode: str, lines: DataFrame, name: str = "main", text: str = "") -> DataFrame:
        """What a mode tells of source lines; for 'crash', text is the stack trace."""
        if mode == "crash" and not text:
            raise ValueError("crash needs the text of a stack trace")
        return {
            "callgraph": lambda: code.callgraph(lines, name), "codepath": lambda: code.usages(lines, name), "reverse": lambda: code.centrality(lines), "core": lambda: code.live_functions(lines),
            "simplify": lambda: code.near_files(lines), "crash": lambda: code.crash(lines, text), "perf": lambda: code.costs(lines, name),
        }[mode]()

    def prune(self, days: int = 30) -> DataFrame:
        return stats.stale_topics(self.log.entries(), days)

    def export(self) -> DataFrame:
        return stats.export(self.log.entries()).orderBy("first_id")

    def brief(self, query: str | None = None, since_hours: int | None = None) -> DataFrame:
        """Without a query the ranked topics; else what it selects, with one hop of links, compressed."""
        e = with_as_of(self.log.entries())
        if query is None:
            return stats.topic_ranking(self.log.entries())
        source_query = "." in query and " " not in query
        name = F.lit(False) if source_query else F.col("topic").rlike(T.glob_pattern(query.lower())) if "*" in query else F.col("topic").contains(T.topic_name(F.lit(query)))
        terms = T.query_terms(query)
        e = search.counted(e, terms)
        sourced = F.coalesce(T.source_is(F.col("source"), query), F.lit(False)) if source_query else F.lit(False)
        tf = F.aggregate("tfs", F.lit(0), lambda a, x: a + x)
        fresh = F.when(F.arrays_overlap("tags", F.array(F.lit("invariant"), F.lit("architecture"))), 1.0).otherwise(1 + 1 / (1 + F.col("days_old") / 7))
        base = F.when(name, 10.0).when(sourced, 15.0).otherwise(0.0)
        e = e.join(graph.link_in(self.log.entries()), ["topic", "idx"])
        hit = e.where(name | (F.col("hits") > 0) | sourced)
        if since_hours is not None:
            hit = hit.where(F.col("days_old") <= (0 if since_hours <= 12 else (since_hours - 1) // 24))
        rows = hit.withColumn("relevance", (base + tf) * fresh * F.col("confidence") + 2.0 * F.col("link_in"))
        if since_hours is None:
            far = graph.one_hop(self.log.entries(), hit.select("entry_id")).select("entry_id")
            rows = rows.unionByName(e.join(far, "entry_id", "left_semi").withColumn("relevance", 3.0 * F.col("confidence")))
        return similar.compressed(rows)

    context = brief

    def ambient(self, file: str, symbols: list[str] = [], removed: list[str] = [], injected: DataFrame | None = None, index: str | None = None) -> DataFrame:
        """What bears on a file, by layers; index: the folder that reindex wrote, which searches then read."""
        e = self.log.entries()
        if index is None:
            return search.layered(e, file, symbols, removed, injected)
        ix = search.Index(self.spark, index)
        return search.layered(e, file, symbols, removed, injected, lambda query, limit, mode: ix.search(query, limit, mode, boost=False))

    def themes(self) -> DataFrame:
        return stats.themes(self.log.entries())

    def classify(self) -> DataFrame:
        return similar.classified(self.log.entries())

    def session(self, events: DataFrame) -> DataFrame:
        from .operators import sessions

        return sessions.sessions(events)

    def reindex(self, path: str) -> None:
        """Write the index tables of this version of the log; search reads them."""
        version, e = self.log.version, self.log.entries()
        for name, df in (("xref", graph.mentions(e)), ("tags", stats.tag_dictionary(e))):
            df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
        search.write_index(e, path, version)

    def is_stale(self, version: int) -> bool:
        return version != self.log.version
