"""Token counts with a digest cache.

The cache is a Parquet folder of (digest, version, n_tokens): the digest of the content and the
digest of the tokenizer that counted it. Contents are looked up by digest, only distinct misses are
encoded, and what they give is appended for later calls. Normalising is the identity (null counts as
empty), since any other rule could change a count.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, shared_dir, slices, texts_of

SCHEMA = "digest binary, version string, n_tokens long"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_of(path: str) -> str:
    """Digest of the tokenizer's file and of the library's version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


_LOADED: dict[str, tokenizers.Tokenizer] = {}


def loaded(name: str) -> tokenizers.Tokenizer:
    """The tokenizer of a public vocabulary file, loaded once in each worker, on one thread."""
    if name not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = tokenizers.Tokenizer.from_file(tokenizer_path(name))
        t.no_truncation()
        t.no_padding()
        _LOADED[name] = t
    return _LOADED[name]


def counter(name: str):
    """A column function: the number of tokens of each text, whole, without added specials."""

    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        texts, out, t = texts_of(text), [], loaded(name)
        for lo, hi in slices(texts, 1 << 19):
            out += [len(e) for e in t.encode_batch_fast([x.decode() for x in texts[lo:hi]], add_special_tokens=False)]
        return pa.array(out, pa.int64())

    return count


def token_counts(docs: DataFrame, cache: str, name: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_bytes (UTF-8), n_tokens. Misses are appended to `cache`.

    `cache` is a folder that driver and executors share; it need not exist. Null text counts as
    empty and has 0 tokens. Rows with a null id are counted like others. Repeated contents, and
    repeated ids, are encoded once or (a repeated id) a few times, and counted alike. An empty table
    gives no rows. Columns other than the two named ones aren't read.
    """
    spark = docs.sparkSession
    version = version_of(tokenizer_path(name))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(cache)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), text.alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    stored = spark.read.schema(SCHEMA).parquet(cache).where(F.col("version") == version).select("digest", "n_tokens")
    seen = rows.select("id", digest).groupBy("digest").agg(F.min("id").alias("id"))
    misses = seen.join(stored, "digest", "left_anti").hint("shuffle_hash")
    # Texts move by their id, so copies of one text never meet in a task; only misses are encoded.
    todo = rows.select("id", digest, "text").join(misses.select("id", F.col("digest").alias("miss")), "id").where("digest = miss")
    found = todo.select("digest", F.lit(version).alias("version"), counter(name)("text").alias("n_tokens"))
    found.write.mode("append").parquet(cache)
    known = spark.read.schema(SCHEMA).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    return docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest__")).join(known.withColumnRenamed("digest", "digest__"), "digest__").select(id_col, "n_bytes", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that every distinct text is encoded in this call."""
    cache = f"{shared_dir(spark).rstrip('/')}/token-cache/{uuid.uuid4().hex}"
    return token_counts(documents(spark, sf_dir), cache).withColumn("over_limit", F.col("n_tokens") > 512)
