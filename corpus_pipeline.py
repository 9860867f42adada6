"""A training corpus from `documents`: five stages, each written as Parquet and read again.

Toxic documents go, then exact copies, then near copies; passages that an earlier document has are
cut out of the texts; what is left is packed into sequences of 2048 tokens. Stages 3 and 5 have no SQL
form (a trained network, an online algorithm), so the result is tested against a brute-force version.

Every stage takes any documents: a null text counts as empty, a text of any length is read whole, rows
with a null id are judged like others, and an empty table gives an empty one. Columns beyond those of
`documents` are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.exact_dedup import without_copies
from quillstone.llm.minhash_dedup import near_duplicates
from quillstone.llm.packing import pack
from quillstone.llm.shared import documents, dropped, written
from quillstone.llm.substring_dedup import substring_dedup
from quillstone.llm.toxicity import fit, score_toxicity
from quillstone.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold of their language; repeated rows are judged alike."""
    ship(spark)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where(~F.col("rejected")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; rows that repeat it stay together. Only texts that
    may have a copy are digested."""
    return without_copies(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more. Rows with a null
    id or without words are in no group and stay; rows that repeat an id are one document."""
    ship(spark)
    stay = near_duplicates(docs, n=5, percent=80).where("kept").select("doc_id")
    return docs.join(stay, docs.doc_id.eqNullSafe(stay.doc_id), "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of 13-word windows that a document with a smaller id has. A null id
    is smaller than all others; rows that repeat an id are one document."""
    ship(spark)
    cut = substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a packed sequence, with its token ids; every row of docs has a piece."""
    ship(spark)
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", into_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    before = None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        dropped(before)
        before = docs
    return docs
