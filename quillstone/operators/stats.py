"""Counts, listings and rankings over entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.views import with_as_of

#: Tags that a topic should have; fixed values.
CORE_TAGS = ("architecture", "data-flow", "invariant", "change-impact")


def tag_counts(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def tag_dictionary(entries: DataFrame, most: int = 32) -> DataFrame:
    """(tag, bit) of the most frequent tags; the dictionary has `most` rows at most."""
    top = tag_counts(entries).orderBy(F.desc("n"), "tag").limit(most)
    return top.withColumn("bit", F.row_number().over(Window.orderBy(F.desc("n"), "tag")) - 1).select("tag", "bit")


def tag_bitmaps(entries: DataFrame) -> DataFrame:
    """(entry_id, bitmap) over the dictionary."""
    rows = entries.select("entry_id", F.explode_outer("tags").alias("tag")).join(F.broadcast(tag_dictionary(entries)), "tag", "left")
    return rows.groupBy("entry_id").agg(F.coalesce(F.bit_or(F.expr("shiftleft(1L, bit)")), F.lit(0)).alias("bitmap"))


def overview(entries: DataFrame) -> DataFrame:
    tags = tag_counts(entries).agg(F.count("*").alias("unique_tags"))
    rows = entries.agg(F.countDistinct("topic").alias("topics"), F.count("*").alias("entries"), F.count_if(F.size("tags") > 0).alias("tagged"), F.date_format(F.timestamp_seconds(F.min("ts_min") * 60), "yyyy-MM-dd").alias("oldest"), F.date_format(F.timestamp_seconds(F.max("ts_min") * 60), "yyyy-MM-dd").alias("newest"))
    return rows.crossJoin(tags)


def topics(entries: DataFrame) -> DataFrame:
    """(topic, n, tags, preview): preview is the last entry's first content line, 70 bytes at most."""
    tags = entries.select("topic", F.explode_outer("tags").alias("tag")).groupBy("topic").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    rows = entries.groupBy("topic").agg(F.count("*").alias("n"), F.max_by(T.truncated(T.first_content(F.col("body")), 70), "entry_id").alias("preview"))
    return rows.join(tags, "topic")


def topic_ranking(entries: DataFrame, limit: int = 8) -> DataFrame:
    """Topics by n * (1 + 1 / (1 + d / 7)), d being the newest entry's age; with that entry."""
    by = Window.partitionBy("topic").orderBy("days_old", "entry_id")
    rows = with_as_of(entries).withColumn("rank", F.row_number().over(by))
    out = rows.groupBy("topic").agg(F.count("*").alias("n"), F.min("days_old").alias("days"), F.max(F.when(F.col("rank") == 1, F.col("entry_id"))).alias("freshest"))
    return out.withColumn("weight", F.col("n") * (1 + 1 / (1 + F.col("days") / 7))).orderBy(F.desc("weight"), "topic").limit(limit)


def velocity(entries: DataFrame) -> DataFrame:
    """Entries of the last day, week and month."""
    return with_as_of(entries).agg(*(F.count_if(F.col("days_old") <= d).alias(f"last_{d}") for d in (1, 7, 30)))


def themes(entries: DataFrame, days: int = 7, most: int = 8) -> DataFrame:
    """(tag, n): the most frequent tags of the last days' entries, but for raw data."""
    tags = with_as_of(entries).where(F.col("days_old") <= days).select(F.explode("tags").alias("tag")).where("tag <> 'raw-data'")
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def stale_topics(entries: DataFrame, days: int = 5) -> DataFrame:
    """(topic, n, newest_day, stale): stale if the newest entry is more than `days` old."""
    rows = with_as_of(entries)
    return rows.groupBy("topic").agg(F.count("*").alias("n"), F.max(T.day_of(F.col("ts_min"))).alias("newest_day"), (F.min("days_old") > days).alias("stale"))


def recent(entries: DataFrame, days: int | None = None, hours: int | None = None) -> DataFrame:
    """(entry_id, topic, date): hours cut by the minute and win over days. The newest entry is now."""
    now = entries.agg(F.max("ts_min").alias("now"))
    rows = entries.crossJoin(F.broadcast(now))
    cut = F.col("ts_min") >= F.col("now") - hours * 60 if hours is not None else T.day_of(F.col("ts_min")) >= T.day_of(F.col("now")) - (7 if days is None else days)
    return rows.where(cut).select("entry_id", "topic", T.date_text(F.col("ts_min")).alias("date"))


def digest(entries: DataFrame) -> DataFrame:
    """(topic, text): a heading and a bullet for each entry, oldest first."""
    line = F.struct("entry_id", F.concat(F.lit("- "), T.truncated(T.first_content(F.col("body")), 80)).alias("line"))
    return entries.groupBy("topic").agg(F.array_sort(F.collect_list(line)).alias("rows")).select("topic", F.concat(F.lit("## "), "topic", F.lit("\n"), F.array_join(F.transform("rows", lambda r: r.line), "\n")).alias("text"))


def tag_gaps(entries: DataFrame, tags: tuple[str, ...] = CORE_TAGS, least: int = 10) -> DataFrame:
    """(topic, tag): core tags that a topic of `least` entries or more lacks. The tags are few and given."""
    big = entries.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("topic")
    have = entries.select("topic", F.explode("tags").alias("tag")).distinct()
    return big.select("topic", F.explode(F.array(*map(F.lit, tags))).alias("tag")).join(have, ["topic", "tag"], "left_anti")


def indexed(entries: DataFrame) -> DataFrame:
    """entries with idx, the place among live entries of the topic, and last."""
    by = Window.partitionBy("topic")
    return entries.withColumn("idx", F.row_number().over(by.orderBy("entry_id")) - 1).withColumn("last", F.col("entry_id") == F.max("entry_id").over(by))


def first_match(entries: DataFrame, topic: str, needle: str) -> DataFrame:
    """The first entry of a topic whose body holds needle, whatever its case."""
    hit = entries.where((F.col("topic") == topic) & F.lower("body").contains(needle.lower()))
    return hit.agg(F.min("entry_id").alias("entry_id"))


def export(entries: DataFrame) -> DataFrame:
    """(topic, first_id, n, entries): an array of entries as JSON for each topic; first_id orders topics."""
    body = F.array_join(F.filter(T.lines(F.col("body")), lambda x: ~x.startswith("[tags: ")), "\n")
    row = F.struct("entry_id", F.to_json(F.struct(T.date_text(F.col("ts_min")).alias("timestamp"), "tags", body.alias("body"))).alias("j"))
    out = entries.groupBy("topic").agg(F.min("entry_id").alias("first_id"), F.count("*").alias("n"), F.array_sort(F.collect_list(row)).alias("rows"))
    return out.select("topic", "first_id", "n", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r.j), ","), F.lit("]")).alias("entries"))


def imported(documents: DataFrame, col: str = "json") -> DataFrame:
    """(topic, no, timestamp, tags, body) of export documents {version, topics:[{topic, entries:[…]}]}."""
    schema = "struct<version:int, topics:array<struct<topic:string, entries:array<struct<timestamp:string, tags:array<string>, body:string>>>>>"
    t = documents.select(F.explode(F.from_json(col, schema)["topics"]).alias("t"))
    e = t.select(F.coalesce("t.topic", F.lit("unknown")).alias("topic"), F.posexplode("t.entries").alias("no", "e"))
    return e.select("topic", "no", "e.timestamp", F.coalesce("e.tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("e.body", F.lit("")).alias("body"))


def markdown_sections(files: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """(topic, idx, ts, body) of topic files with `## YYYY-MM-DD HH:MM` headings."""
    parts = F.filter(F.split(text, r"(?m)^(?=## \d{4}-)"), lambda s: s.rlike(r"^## \d{4}-"))
    rows = files.select(F.col(name).alias("topic"), F.posexplode(parts).alias("idx", "s"))
    return rows.select("topic", "idx", F.regexp_extract("s", r"^## (\d{4}-\d{2}-\d{2} \d{2}:\d{2})", 1).alias("ts"), F.regexp_replace(F.regexp_replace("s", r"^## [^\n]*\n?", ""), r"\A\s+|\s+\z", "").alias("body"))


def vacuumed(entries: DataFrame) -> DataFrame:
    """Live entries with new offsets: the sum of the record sizes (12 bytes, topic, body) before, after a
    header of 8. Sums run within ranges of ids, and over the ranges before; ranges are quantiles, 1023
    bounds at most, whatever the table's size."""
    size = F.lit(12) + F.octet_length("topic") + F.octet_length("body")
    rows = entries.select("entry_id", size.cast("long").alias("size"))
    bounds = rows.agg(F.percentile_approx("entry_id", [k / 1024 for k in range(1, 1024)], 20_480).alias("p"))
    rows = rows.crossJoin(F.broadcast(bounds)).select("entry_id", "size", F.size(F.filter("p", lambda x: x < F.col("entry_id"))).alias("range"))
    # one row: the bytes of each range, of which a row adds those before its own
    totals = rows.groupBy("range").agg(F.sum("size").alias("b")).agg(F.collect_list(F.struct("range", "b")).alias("t"))
    within = F.sum("size").over(Window.partitionBy("range").orderBy("entry_id")) - F.col("size")
    base = F.aggregate(F.filter("t", lambda x: x.range < F.col("range")), F.lit(0).cast("long"), lambda a, x: a + x.b)
    bases = rows.select("range").distinct().crossJoin(F.broadcast(totals)).select("range", base.alias("base"))
    return rows.withColumn("within", within).join(F.broadcast(bases), "range").select("entry_id", (F.lit(8) + F.col("base") + F.col("within")).alias("offset"))


def stale_sources(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(entry_id, topic, source, newer): entries whose source names a file that was changed after them, or a
    glob with `newer` such files. files (path, mtime_min).

    A path stands for itself or for a file one folder below, as does the folder before a glob's first
    `*`; below that, files of any depth count whose path ends as the glob does, but for hidden folders.
    Paths are joined on their last names or on the folder, so no entry meets all files.
    """
    e = entries.where("source IS NOT NULL").select("entry_id", "topic", "source", "ts_min", F.regexp_extract("source", r"^(.*?)(?::\d+)?$", 1).alias("wanted"))
    f = files.select("path", "mtime_min")
    short = f.select(F.explode(F.array_distinct(F.array("path", F.regexp_replace("path", r"^[^/]*/", "")))).alias("wanted"), "path", "mtime_min").withColumn("own", F.col("path") == F.col("wanted"))
    single = e.where(~F.col("wanted").contains("*")).join(short, "wanted")
    # the file itself comes before those one folder below
    single = single.groupBy("entry_id", "topic", "source", "ts_min").agg(F.max_by("mtime_min", F.struct("own", "path")).alias("m")).where("m > ts_min").select("entry_id", "topic", "source", F.lit(1).cast("long").alias("newer"))
    root, suffix = F.rtrim(F.substring_index("wanted", "*", 1), F.lit("/")), F.regexp_extract("wanted", r"([^*]*)$", 1)
    globs = e.where(F.col("wanted").contains("*")).select("*", root.alias("root"), suffix.alias("suffix"))
    parts = F.split("path", "/")
    roots = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("root"), F.array_join(F.slice(parts, k + 1, F.size(parts)), "/").alias("rest")))
    below = f.select("path", "mtime_min", F.explode(roots).alias("r")).select("path", "mtime_min", "r.root", "r.rest").where(~F.col("rest").rlike(r"(^|/)\.[^/]*/"))
    below = below.select("path", "mtime_min", F.explode(F.array_distinct(F.array("root", F.regexp_replace("root", r"^[^/]*/", "")))).alias("root"))
    many = globs.join(below, "root").where("mtime_min > ts_min AND endswith(path, suffix)").groupBy("entry_id", "topic", "source").agg(F.countDistinct("path").alias("newer"))
    return single.unionByName(many)


def untimed(entries: DataFrame) -> DataFrame:
    """Entries without a time."""
    return entries.where("ts_min = 0")
