"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("quillstone")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a session on one machine that has
    none gets a temporary folder, one on a cluster is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quillstone-"))


_OWN: dict[str, str] = {}


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """df written once as Parquet in the workspace and read back, which cuts its lineage; and where it lies."""
    spark = df.sparkSession
    at = f"{workspace(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


def discard(spark: SparkSession, at: str) -> None:
    """Delete a table of `kept` that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, where neither PYTHONPATH nor the working
    folder does so already. The driver serves the archive to executors."""
    root = Path(__file__).resolve().parent.parent
    have = [Path(p).resolve() for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()) if p]
    app = spark.sparkContext.applicationId
    if app in _SENT or root in have or (Path.cwd() / "quillstone").exists():
        return
    at = Path(tempfile.mkdtemp(prefix="quillstone-")) / "quillstone.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in (root / "quillstone").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(at))
    _SENT.add(app)
