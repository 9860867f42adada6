"""Views of the tables as a store of entries: what each operator reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Minutes since the epoch of the first entry's day, 2024-01-01.
FIRST_MINUTE = 28_401_120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only log: an entry for each document, a tombstone for each toxic label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    entries = docs.select(
        F.lit("entry").alias("kind"), F.col("doc_id").alias("entry_id"), F.col("source").alias("topic"), F.col("text").alias("body"),
        F.array("lang").alias("tags"), (FIRST_MINUTE + 60 * F.col("doc_id")).alias("ts_min"), F.lit(None).cast("long").alias("target"),
    )
    gone = labels.where("toxic = 1").select(F.lit("delete").alias("kind"), F.col("doc_id").alias("target"))
    return entries.unionByName(gone, allowMissingColumns=True)


def live(rows: DataFrame) -> DataFrame:
    """Entries that no tombstone targets, wherever it stands in the log."""
    gone = rows.where("kind = 'delete'").select(F.col("target").alias("entry_id"))
    return rows.where("kind = 'entry'").drop("kind", "target").join(gone, "entry_id", "left_anti")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live entries with the confidence that their quality label gives."""
    poor = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("entry_id"), F.lit(0.5).alias("c"))
    rows = live(log(spark, sf_dir)).join(poor, "entry_id", "left")
    return rows.withColumn("confidence", F.coalesce("c", F.lit(1.0))).drop("c")


def conversation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic for each conversation, its turns in order as entries 0, 1, …"""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv-"), "conv_id").alias("topic"), (F.row_number().over(w) - 1).alias("idx"), "role", F.col("text").alias("body"))


def with_as_of(df: DataFrame) -> DataFrame:
    """df with as_of, the day after its newest entry, and days_old. The clock is one row."""
    clock = df.agg((F.floor(F.max("ts_min") / 1440) + 1).alias("as_of"))
    return df.crossJoin(F.broadcast(clock)).withColumn("days_old", F.col("as_of") - F.floor(F.col("ts_min") / 1440))
