"""Exact dedup by progressive refinement, in DataFrame functions only.

Length, then length and prefix hash, then the full digest: each level groups only what the level
before left in groups of two or more, and each moves narrow rows (ids, numbers, digests) through a
shuffle, never a text. Sums by key are partial before the shuffle, so a group that holds a third of
all rows costs one row per task there.

Which rows are digested in full is decided in the scan, by a bitmap of the surviving (length, prefix
hash) keys. It has the same bound at every size and no false negatives; the more survivors, the more
other rows are digested too, which the exact grouping by length and digest afterwards leaves alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .shared import documents, written

#: Bits of the bitmap, in slots of 32768 (4 KB): 2048 rows, 8 MB, whatever the table's size.
BITS, SLOT = 1 << 26, 1 << 15


def _place(n_bytes: str, head: str) -> Column:
    return F.pmod(F.xxhash64(n_bytes, head), F.lit(BITS))


def _marked(heads: DataFrame) -> DataFrame:
    """(slot, bits): the bitmap of heads (n_bytes, head)."""
    at = heads.select(_place("n_bytes", "head").alias("at")).select(F.floor(F.col("at") / SLOT).cast("int").alias("slot"), F.pmod("at", F.lit(SLOT)).alias("bit"))
    return at.repartition("slot").groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _survives(df: DataFrame, bitmap: DataFrame, n_bytes: str, head: str) -> DataFrame:
    """df with survives__: false only if no surviving key is that of the row."""
    df = df.withColumn("at__", _place(n_bytes, head)).withColumn("slot", F.floor(F.col("at__") / SLOT).cast("int"))
    df = df.join(F.broadcast(bitmap), "slot", "left")
    bit = F.pmod("at__", F.lit(SLOT)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(bit, F.lit(8))) == 1
    return df.withColumn("survives__", F.coalesce(hit, F.lit(False))).drop("slot", "bits", "at__")


def _refined(docs: DataFrame, text: Column, prefix: int) -> DataFrame:
    """The bitmap of (length, prefix hash) keys that two or more rows have."""
    size, head = F.octet_length(text).alias("n_bytes"), F.xxhash64(F.substring(text, 1, prefix)).alias("head")
    lengths = docs.groupBy(size).agg(F.count("*").alias("n")).where("n > 1").select("n_bytes")
    narrow = docs.select(size, head).join(lengths, "n_bytes", "left_semi")
    heads = narrow.groupBy("n_bytes", "head").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes", "head")
    return written(_marked(heads))


def _digested(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    """(id__, n_bytes__, sha__) and row__, the row of docs: the full digest (hex) of rows whose length and
    prefix another row may share, null for all others, whose text is read no further."""
    bitmap = _refined(docs, F.coalesce(F.col(text_col), F.lit("")), prefix)
    text = F.coalesce(F.col(f"row__.`{text_col}`"), F.lit(""))
    df = docs.select(F.struct("*").alias("row__")).select("row__", F.col(f"row__.`{id_col}`").alias("id__"), F.octet_length(text).alias("n_bytes__"), F.xxhash64(F.substring(text, 1, prefix)).alias("head__"))
    return _survives(df, bitmap, "n_bytes__", "head__").select("row__", "id__", "n_bytes__", F.when(F.col("survives__"), F.sha2(text, 256)).alias("sha__"))


def _groups(rows: DataFrame) -> DataFrame:
    groups = rows.where("sha__ IS NOT NULL").groupBy("n_bytes__", "sha__").agg(F.max("id__").alias("keep__"), F.count("*").alias("size__"))
    return groups.where("size__ > 1")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256) -> DataFrame:
    """Groups of two or more rows of equal text: n_bytes, sha (hex), keep_id (largest id), group_size.

    Null text counts as empty. Nulls among ids never win; a group of null ids alone keeps null.
    """
    g = _groups(_digested(docs, id_col, text_col, prefix))
    return g.select(F.col("n_bytes__").alias("n_bytes"), F.col("sha__").alias("sha"), F.col("keep__").alias("keep_id"), F.col("size__").alias("group_size"))


def _judged(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    """(row__, id__, sha__, keep__, size__): keep__ and size__ are null for texts that no other row has.

    A small table of groups is broadcast. A larger one is joined by a shuffle in which only rows with a
    digest take part.
    """
    rows = _digested(docs, id_col, text_col, prefix)
    groups, keys = written(_groups(rows)), ["n_bytes__", "sha__"]
    if groups.count() <= shared.BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), keys, "left")
    alone = rows.where("sha__ IS NULL")
    return rows.where("sha__ IS NOT NULL").join(groups, keys, "left").unionByName(alone, allowMissingColumns=True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256) -> DataFrame:
    """All columns of docs, and keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Rows that repeat id and text count in
    group_size and are all marked kept if they hold the largest id. Null text counts as empty, long
    texts are compared whole. A column of docs with one of the four new names gives way to the new one;
    others may have any name. An empty table gives an empty table.
    """
    df = _judged(docs, id_col, text_col, prefix)
    own = [F.col(f"row__.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("keep_id", "group_size", "kept", "text_sha256")]
    keep = F.when(F.col("size__").isNull(), F.col("id__")).otherwise(F.col("keep__"))
    sha = F.coalesce("sha__", F.sha2(F.coalesce(F.col(f"row__.`{text_col}`"), F.lit("")), 256))
    return df.select(*own, keep.alias("keep_id"), F.coalesce("size__", F.lit(1)).cast("long").alias("group_size"), F.col("id__").eqNullSafe(keep).alias("kept"), sha.alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their own columns; only possible copies are digested."""
    df = _judged(docs, id_col, text_col, prefix)
    return df.where(F.col("size__").isNull() | F.col("id__").eqNullSafe(F.col("keep__"))).select("row__.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
