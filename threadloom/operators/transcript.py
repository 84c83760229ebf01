"""Source keys, spans, turns and visible references of a session's rows.

Rows have session_id and ordinal; every window is partitioned by session, so one shuffle on session_id
serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.refs import format_ref

#: Classes of roles.
PASSTHROUGH = ("compaction", "branch_summary", "custom_message")
TURN_ROLES = ("user", "assistant", "toolResult", "bashExecution")
REF_ROLES = ("user", "toolResult", "bashExecution")
RESULT_ROLES = ("toolResult", "bashExecution")


def js_number(n: Column) -> Column:
    """A number as text, integral ones without a fraction."""
    return F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))


def source_key(raw_id: Column, ts: Column, role: Column, tool_call_id: Column, ordinal: Column, nudge_turn: Column | None = None, block_id: Column | None = None) -> Column:
    """raw:<id>, a synthetic key for nudges and blocks, else one made of time, role, call and place."""
    made = F.concat_ws(":", F.lit("msg"), F.coalesce(js_number(ts), F.lit("na")), role, F.when(tool_call_id != "", tool_call_id), ordinal.cast("string"))
    choices = [F.when(raw_id != "", F.concat(F.lit("raw:"), raw_id))]
    if nudge_turn is not None:
        choices.append(F.concat(F.lit("synth:nudge:"), nudge_turn.cast("string")))
    if block_id is not None:
        choices.append(F.concat(F.lit("synth:block:b"), block_id.cast("string")))
    return F.coalesce(*choices, made)


def owner_key(ordinal: Column, block_id: Column | None = None) -> Column:
    own = F.concat(F.lit("s"), ordinal.cast("string"))
    return own if block_id is None else F.when(block_id.isNotNull(), F.concat(F.lit("block:b"), block_id.cast("string"))).otherwise(own)


def upto(*partition: str) -> Window:
    return Window.partitionBy(*partition).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)


def with_spans(rows: DataFrame) -> DataFrame:
    """Add span_head: the ordinal of the row that begins a row's span.

    A row with calls takes the rows that follow it as long as they are results of its calls or
    passthrough; it makes an exchange if there is at least one result. All other rows stand alone.
    ``rows`` need role, calls (array<string>, call ids of an assistant row) and tool_call_id.
    """
    calls = (F.col("role") == "assistant") & (F.size("calls") > 0)
    w = upto("session_id")
    rows = rows.withColumns({"_h": F.last(F.when(calls, F.col("ordinal")), True).over(w), "_hc": F.last(F.when(calls, F.col("calls")), True).over(w)})
    result = F.coalesce(F.col("role").isin(*RESULT_ROLES) & F.array_contains("_hc", F.col("tool_call_id")), F.lit(False))
    rows = rows.withColumn("_match", result)
    stays = (F.col("ordinal") == F.col("_h")) | F.col("_match") | F.col("role").isin(*PASSTHROUGH)
    rows = rows.withColumn("_break", F.sum(F.when(stays, 0).otherwise(1)).over(upto("session_id", "_h")))
    rows = rows.withColumn("_hit", F.max(F.when((F.col("_break") == 0) & F.col("_match"), 1).otherwise(0)).over(Window.partitionBy("session_id", "_h")))
    head = F.when(F.col("_h").isNotNull() & (F.col("_break") == 0) & (F.col("_hit") == 1), F.col("_h")).otherwise(F.col("ordinal"))
    return rows.withColumn("span_head", head).drop("_h", "_hc", "_match", "_break", "_hit")


def spans(rows: DataFrame) -> DataFrame:
    """One row for each span of ``with_spans``: kind, bounds, whether it is a turn, source keys in order."""
    out = with_spans(rows).groupBy("session_id", "span_head").agg(
        F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count("*").alias("n_rows"), F.max("ts").alias("end_ts"), F.min("ts").alias("start_ts"),
        F.bool_or(F.col("role").isin(*TURN_ROLES)).alias("is_turn"), F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "source_key"))), lambda x: x["source_key"]).alias("source_keys"),
    )
    kind = F.when(F.col("n_rows") > 1, "tool-exchange").otherwise("message")
    return out.withColumn("kind", kind).withColumn("span_key", F.concat(F.lit("span:"), F.element_at("source_keys", 1), F.lit(".."), F.element_at("source_keys", -1)))


def logical_turns(spans_: DataFrame) -> DataFrame:
    return spans_.groupBy("session_id").agg(F.count_if("is_turn").alias("turns"))


def tail_start(turns: DataFrame, protect: int) -> DataFrame:
    """(session_id, tail_start): time of the ``protect``-th last turn; of the first one if there are
    fewer. Rows: session_id, ordinal, ts of turns. Nothing is protected by 0."""
    if protect <= 0:
        return turns.select("session_id").distinct().withColumn("tail_start", F.lit(None).cast("double"))
    last = Window.partitionBy("session_id").orderBy(F.col("ordinal").desc())
    timed = turns.where(F.col("ts").isNotNull() & ~F.isnan("ts")).withColumn("_n", F.row_number().over(last))
    return timed.groupBy("session_id").agg(F.coalesce(F.max(F.when(F.col("_n") == protect, F.col("ts"))), F.min_by("ts", "ordinal")).alias("tail_start"))


def visible_refs(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(session_id, source_key, ref_index, ref) for rows with a reference: known ones keep theirs, the
    others get the next free numbers in order of first sight. ``known``: session_id, source_key,
    ref_index."""
    first = rows.where(F.col("role").isin(*REF_ROLES)).groupBy("session_id", "source_key").agg(F.min("ordinal").alias("ordinal"))
    if known is None:
        first, base = first.withColumn("ref_index", F.lit(None).cast("long")), F.lit(0)
    else:
        top = known.groupBy("session_id").agg(F.max("ref_index").alias("_top"))
        first = first.join(known, ["session_id", "source_key"], "left").join(top, "session_id", "left")
        base = F.coalesce(F.col("_top"), F.lit(0))
    order = Window.partitionBy("session_id", F.col("ref_index").isNull()).orderBy("ordinal")
    number = F.coalesce(F.col("ref_index"), base + F.row_number().over(order))
    return first.select("session_id", "source_key", "ordinal", number.alias("ref_index")).withColumn("ref", format_ref(F.col("ref_index")))


def calls_since_user(rows: DataFrame) -> DataFrame:
    """Results after a session's last user row."""
    w = Window.partitionBy("session_id")
    last = F.max(F.when(F.col("role") == "user", F.col("ordinal"))).over(w)
    late = F.col("role").isin(*RESULT_ROLES) & (F.col("ordinal") > F.coalesce("_last", F.lit(-1)))
    return rows.withColumn("_last", last).groupBy("session_id").agg(F.count_if(late).alias("calls_since_user"))
