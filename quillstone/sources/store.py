"""The versioned log as Parquet: appended rows, tombstones, and edits as both.

Beside the rows, the folder `state` has a small numbered file for each change: the generation (the
folder of rows that counts) and the next free id. The highest number is the log's version. Files are
written under another name and renamed, so a reader sees a whole one or none.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.stats import indexed
from .views import live

LOG = "kind string, entry_id long, topic string, body string, ts_min int, target long"


class Locked(RuntimeError):
    """Another writer holds the log."""


class Log:
    """One writer at a time, others are refused; readers see the rows of finished appends. Every change is
    one append job. Opening an existing path goes on with what is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._state() is None:
            with self._writer():
                if self._state() is None:
                    self._empty("log")
                    self._put(0, {"generation": "log", "next_id": 0})

    # small files

    def _numbers(self) -> list[int]:
        at = self._jpath(f"{self.path}/state")
        if not self._fs.exists(at):
            return []
        return sorted(int(n) for s in self._fs.listStatus(at) if (n := s.getPath().getName()).isdigit())

    def _state(self) -> tuple[int, dict] | None:
        """The newest number and what it says. A file may go while it is being read; then a newer one is there."""
        for _ in range(5):
            numbers = self._numbers()
            if not numbers:
                return None
            try:
                stream = self._fs.open(self._jpath(f"{self.path}/state/{numbers[-1]:020d}"))
            except Exception:
                continue
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            return numbers[-1], json.loads(text)
        raise OSError(f"no readable state below {self.path}")

    def _put(self, number: int, state: dict) -> None:
        temp, to = self._jpath(f"{self.path}/state/_{uuid.uuid4().hex}"), self._jpath(f"{self.path}/state/{number:020d}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(temp, to):
            raise OSError(f"cannot write {to}")
        for old in self._numbers()[:-3]:
            self._fs.delete(self._jpath(f"{self.path}/state/{old:020d}"), False)

    @contextmanager
    def _writer(self):
        """Hold the lock file; it is created only if it isn't there."""
        lock = self._jpath(f"{self.path}/lock")
        self._fs.mkdirs(self._jpath(self.path))
        try:
            made = self._fs.createNewFile(lock)
        except Exception as e:
            raise Locked(f"{self.path} is being written") from e
        if not made:
            raise Locked(f"{self.path} is being written; break_lock() if its writer is dead")
        try:
            yield
        finally:
            self._fs.delete(lock, False)

    def break_lock(self) -> None:
        """Remove the lock of a writer that ended without removing it."""
        self._fs.delete(self._jpath(f"{self.path}/lock"), False)

    def _empty(self, generation: str) -> None:
        self.spark.createDataFrame([], LOG).write.mode("append").parquet(f"{self.path}/{generation}")

    @property
    def version(self) -> int:
        return self._state()[0]

    @property
    def _at(self) -> str:
        return f"{self.path}/{self._state()[1]['generation']}"

    # rows

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(self._at)

    def entries(self) -> DataFrame:
        """Live entries with what their metadata lines say, and idx, the place in the topic."""
        b = F.col("body")
        e = live(self.rows()).select("entry_id", "topic", "body", "ts_min", T.tags_of(b).alias("tags"), T.source_of(b).alias("source"), T.confidence_of(b).alias("confidence"), T.links_of(b).alias("links"))
        return indexed(e)

    def append(self, new: DataFrame | None, gone: DataFrame | None = None) -> None:
        """new: topic, body, ts_min, numbered in the order of pos; gone: entry_id.

        Rows are sorted by ranges of pos, and numbered by the counts of the ranges before theirs: the
        driver sees one number for each partition. Ids are reserved before rows are written, so a write
        that fails leaves a gap and nothing else.
        """
        with self._writer():
            number, state = self._state()
            top, n, parts, kept = state["next_id"], 0, [], []
            if new is not None:
                rows = new.select("pos", "topic", "body", "ts_min").repartitionByRange("pos").sortWithinPartitions("pos").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
                # rows are read from the folder that they go to, so they are fixed first
                rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
                kept.append(rows)
                base = []
                for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("at")).orderBy("part").collect():
                    base.append((r.part, top + n - r["at"]))
                    n += r.n
                base = self.spark.createDataFrame(base, "part int, base long")
                none = F.lit(None).cast("long")
                parts.append(rows.join(F.broadcast(base), "part").select(F.lit("entry").alias("kind"), (F.col("at") + F.col("base")).alias("entry_id"), "topic", "body", F.col("ts_min").cast("int"), none.alias("target")))
            if gone is not None:
                gone = gone.persist(StorageLevel.MEMORY_AND_DISK)
                gone.count()
                kept.append(gone)
                none = F.lit(None)
                parts.append(gone.select(F.lit("delete").alias("kind"), none.cast("long").alias("entry_id"), none.cast("string").alias("topic"), none.cast("string").alias("body"), none.cast("int").alias("ts_min"), F.col("entry_id").alias("target")))
            state = {**state, "next_id": top + n}
            self._put(number + 1, state)
            df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            df.write.mode("append").parquet(f"{self.path}/{state['generation']}")
            # the version that has these rows; one read before it may lack them
            self._put(number + 2, state)
            for x in kept:
                x.unpersist()

    def replace(self, old: DataFrame, body: Column | None = None, topic: Column | None = None) -> None:
        """Append old entries anew with another body or topic, and tombstones for them."""
        new = old.select(F.col("entry_id").alias("pos"), (topic if topic is not None else F.col("topic")).alias("topic"), (body if body is not None else F.col("body")).alias("body"), "ts_min")
        self.append(new, old.select("entry_id"))

    def vacuum(self) -> None:
        """Rewrite live entries, with their ids, into a new generation and go over to it. The rows of the
        generation before stay until the next vacuum, for readers that have begun."""
        with self._writer():
            number, state = self._state()
            e = live(self.rows()).select(F.lit("entry").alias("kind"), "entry_id", "topic", "body", "ts_min", F.lit(None).cast("long").alias("target"))
            to = f"log-{number + 1}"
            e.write.mode("overwrite").parquet(f"{self.path}/{to}")
            self._put(number + 1, {**state, "generation": to, "before": state["generation"]})
            if "before" in state:
                self._fs.delete(self._jpath(f"{self.path}/{state['before']}"), True)
