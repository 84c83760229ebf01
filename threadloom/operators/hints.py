"""Hints for planning summaries: the protected tail, what may not end a range, and what could be summarised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.refs import parse_message_ref
from threadloom.functions.text import listed

#: Ids that are listed at most.
SHOWN_MESSAGES, SHOWN_BLOCKS = 8, 6


def protected(tails: DataFrame, refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(session_id, tail_start_id, message_ids, block_ids): references at or after the start of the tail, one for
    each number, in order of numbers; active blocks that end there; the reference of the tail's first row, or
    else the first protected one. ``tails``: session_id, tail_start; ``refs``: session_id, ref, ts; ``blocks``:
    session_id, block_id, active, end_ts."""
    number = parse_message_ref(F.col("ref"))
    late = refs.join(tails, "session_id").where("ts >= tail_start").groupBy("session_id", number.alias("_n")).agg(F.min_by("ref", F.length("ref")).alias("ref"), F.min(F.when(F.col("ts") == F.col("tail_start"), F.col("ref"))).alias("_at"))
    ids = late.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "ref"))), lambda x: x["ref"]).alias("message_ids"), F.min_by("_at", F.when(F.col("_at").isNotNull(), F.col("_n"))).alias("_first"))
    finite = ~F.isnan("end_ts") & (F.abs("end_ts") < float("inf"))
    held = blocks.where("active").join(tails, "session_id").where(finite & (F.col("end_ts") >= F.col("tail_start"))).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list("block_id")), lambda i: F.concat(F.lit("b"), i.cast("string"))).alias("block_ids"))
    none = F.array().cast("array<string>")
    out = tails.join(ids, "session_id", "left").join(held, "session_id", "left")
    return out.select("session_id", F.coalesce("_first", F.get("message_ids", F.lit(0))).alias("tail_start_id"), F.coalesce("message_ids", none).alias("message_ids"), F.coalesce("block_ids", none).alias("block_ids"))


def candidate_line() -> Column:
    span = F.when(F.col("start_ref") == F.col("end_ref"), F.col("start_ref")).otherwise(F.concat_ws("..", "start_ref", "end_ref"))
    return F.concat(F.lit("- "), span, F.lit(" (~"), F.col("tokens").cast("string"), F.lit(" tokens)"))


def rendered(protected_: DataFrame, candidates: DataFrame, *, tail_start: bool = True, protected_ids: bool = False) -> DataFrame:
    """(session_id, text): the tail's start, what may not end a range, and the candidates of
    ``coverage.candidate_ranges`` with their totals, as far as there are any."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", candidate_line().alias("t")))), lambda x: x["t"])
    found = candidates.groupBy("session_id").agg(lines.alias("_lines"), F.first("all_tokens").alias("_tokens"), F.first("all_ranges").alias("_all"))
    out = protected_.join(found, "session_id", "full")
    kept = [
        F.when(F.size("message_ids") > 0, F.concat(F.lit("messages "), listed(F.col("message_ids"), SHOWN_MESSAGES))),
        F.when(F.size("block_ids") > 0, F.concat(F.lit("blocks "), listed(F.col("block_ids"), SHOWN_BLOCKS))),
    ]
    shown = F.size("_lines")
    total = F.concat(F.lit("~"), F.col("_tokens").cast("string"), F.lit(" tokens total across "), F.col("_all").cast("string"), F.when(F.col("_all") == 1, " stretch").otherwise(" stretches"))
    cut = F.when(F.col("_all") > shown, F.concat(F.lit("; showing top "), shown.cast("string"), F.lit(" by size"))).otherwise("")
    first = F.when(F.col("tail_start_id").isNotNull(), F.concat(F.lit("Protected hot tail starts at "), F.col("tail_start_id"), F.lit("."))) if tail_start else F.lit(None).cast("string")
    second = F.when((F.size("message_ids") > 0) | (F.size("block_ids") > 0), F.concat(F.lit("Do not use these as endId right now: "), F.concat_ws("; ", *kept), F.lit("."))) if protected_ids else F.lit(None).cast("string")
    third = F.when(shown > 0, F.concat(F.lit("Stale and compressible now ("), total, cut, F.lit("):\n"), F.array_join("_lines", "\n")))
    return out.select("session_id", F.concat_ws("\n", first, second, third).alias("text"))


def latest_block(blocks: DataFrame) -> DataFrame:
    """(session_id, block_id) of the active block with the largest id."""
    return blocks.where("active").groupBy("session_id").agg(F.max("block_id").alias("block_id"))


def in_time(rows: DataFrame) -> DataFrame:
    """Rows with new ordinals in order of time (none: 0), those of one time as they were."""
    return rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy("session_id").orderBy(F.coalesce("ts", F.lit(0.0)), "ordinal")) - 1).cast("long"))
