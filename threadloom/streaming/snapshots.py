"""Saving sessions' states from a stream: once for each batch, and only what has changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.persistence import serialized


def state_payloads(states: DataFrame) -> DataFrame:
    """(session_id, schema_version, payload) of states as ``replay`` and ``replay_stream`` give them: turns, pruned
    results, what was saved for good, and blocks."""
    s = states.select("session_id", F.unix_millis(F.current_timestamp()).alias("saved_at"), F.col("turns").alias("current_turn"), "last_nudge_turn", "last_compress_turn", "pruned_tool_ids", F.col("lifetime_saved").cast("long").alias("lifetime_saved"), "next_block_id")
    return serialized(s, states.select("session_id", F.explode("blocks").alias("b")).select("session_id", "b.*"))


def snapshot_sink(folder: str, payloads: Callable[[DataFrame], DataFrame] = state_payloads) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that appends state entries to ``folder``, a part for each batch.

    Of a batch's sessions those with ``pending_save`` are saved, of rows with one session the last
    (by n_messages). A batch's part is written under its number and is complete once Spark has put its
    success mark there; a batch that comes again, after a failure or restart, finds the mark and writes nothing,
    or finds none and replaces what is there. So every state is saved once. ``saved`` reads the folder.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark, part = batch.sparkSession, f"{folder}/batch={number}"
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{part}/_SUCCESS")
        if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            return
        last = batch.where("pending_save").groupBy("session_id").agg(F.max_by(F.struct(*batch.columns), "n_messages").alias("s")).select("s.*")
        made = payloads(last)
        kind = made.select("session_id", F.lit("custom").alias("type"), F.lit("dcp-state").alias("custom_type"), F.col("payload").alias("data"))
        kind.write.mode("overwrite").parquet(part)

    return save


def saved(spark, folder: str) -> DataFrame:
    """(session_id, type, custom_type, data, pos) of all entries, pos being the batch: complete parts only."""
    parts = spark.read.option("basePath", folder).schema("session_id string, type string, custom_type string, data string, batch long").parquet(f"{folder}/batch=*")
    return parts.withColumnRenamed("batch", "pos")
