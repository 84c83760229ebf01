"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the one before kept, is written as Parquet and read again for the next one.
All but the last return the columns of ``documents``.

Null and empty texts pass all stages but mixing, which takes no document without words; equal rows stay
once from the third stage on, and stand as often as mixing takes them after it; texts of any length are
treated whole; columns beside those of ``documents`` end with the first stage; empty tables give empty
results. A stage's folder is deleted once the next one is written, the last one holds the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import linededup, mixing, packing, setjoin, toxicity
from threadloom.llm.common import discard, n_words, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine calls toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return columns(toxicity.score(docs, model).where("predicted = 0"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in the last of them only."""
    out = linededup.dedup_lines(columns(docs))
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return columns(out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose sets of 5-word shingles have Jaccard >= 0.8 are linked; one of each component
    stays, the one with the smallest id, which names the component.

    Documents without words are in no component and stay. Rows equal in id and text stay once.
    """
    parts = setjoin.components(docs, n=5, num=80, den=100)
    named = parts.where(F.col("component").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row_key").alias("_key")).select("_key")
    kept = named.unionByName(parts.where("component is null").select(F.col("row_key").alias("_key")).distinct())
    rows = columns(docs).withColumn("_key", setjoin.row_key())
    return columns(rows.join(kept, "_key").dropDuplicates(["_key"]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources near their target weights, in curriculum order; documents taken twice stand twice."""
    sized = columns(docs).withColumn("size", n_words()).withColumn("_mixing_tie_", F.xxhash64("text"))
    return columns(mixing.stream(sized))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            discard(f"{folder}/{k - 1}")
    return docs


#: Hashed order, a fitted model and tokenization are beyond SQL; run() is held against plain stages in the tests.
ORACLE_SQL = None
