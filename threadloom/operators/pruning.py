"""Duplicate and stale tool outputs, orphans, and the text that stands for what is removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import strip_hallucinated
from threadloom.functions.tools import fingerprint

#: Tools never pruned, and the texts of removed outputs.
PROTECTED = ("compress", "write", "edit")
GENERIC_TOMBSTONE = "[Output removed to save context - information superseded or no longer needed]"
ERROR_TOMBSTONE = "[Error output removed - tool failed more than N turns ago]"


def bucket(turn: Column, cadence: int) -> Column:
    """The turn at which the open bucket of ``cadence`` turns began; outputs change once a bucket."""
    return turn if cadence <= 1 else (F.floor(turn / cadence) * cadence).cast("long")


def duplicates(log: DataFrame, *, cadence: int = 1, protected: tuple[str, ...] = ()) -> DataFrame:
    """Add ``duplicate``: an earlier result of a call repeated later with equal name and arguments.

    Only results before the open bucket count, so a pass in the same bucket changes nothing.
    ``log``: session_id, turn_index, tool_name, arguments, current_turn.
    """
    may = (F.col("turn_index") < bucket(F.col("current_turn"), cadence)) & ~F.col("tool_name").isin(*PROTECTED, *protected)
    rows = log.withColumns({"_fp": fingerprint(F.col("tool_name"), F.col("arguments")), "_may": may})
    later = Window.partitionBy("session_id", "_fp", "_may").orderBy(F.col("turn_index").desc(), F.col("tool_call_id").desc())
    return rows.withColumn("duplicate", F.col("_may") & (F.row_number().over(later) > 1)).drop("_fp", "_may")


def stale_error(turns: int, cadence: int = 1, protected: tuple[str, ...] = ()) -> Column:
    """A failed result whose turn lies ``turns`` or more before the open bucket. Only the tools in ``protected``
    are spared: those that are never duplicates do go stale."""
    old = bucket(F.col("current_turn"), cadence) - F.col("turn_index") >= turns
    return F.col("is_error") & old & (~F.col("tool_name").isin(*protected) if protected else F.lit(True))


def tombstone(content: Column, pruned: Column, is_error: Column) -> Column:
    return F.when(pruned & is_error, ERROR_TOMBSTONE).when(pruned, GENERIC_TOMBSTONE).otherwise(content)


def prune_log(log: DataFrame, *, cadence: int = 1, error_turns: int = 4, dedup: bool = True, purge: bool = True, prior: DataFrame | None = None, protected: tuple[str, ...] = ()) -> DataFrame:
    """Add current_turn, duplicate, stale and the visible content. ``prior`` (session_id, tool_call_id):
    results pruned by earlier passes; they stay pruned. ``protected``: tools that are neither."""
    turns = F.count("*").over(Window.partitionBy("session_id"))
    rows = log.withColumn("current_turn", turns)
    rows = duplicates(rows, cadence=cadence, protected=protected) if dedup else rows.withColumn("duplicate", F.lit(False))
    rows = rows.withColumn("stale", stale_error(error_turns, cadence, protected) if purge else F.lit(False))
    pruned = F.col("duplicate") | F.col("stale")
    if prior is not None:
        rows = rows.join(prior.select("session_id", "tool_call_id").distinct().withColumn("_prior", F.lit(True)), ["session_id", "tool_call_id"], "left")
        pruned = pruned | F.coalesce("_prior", F.lit(False))
    return rows.withColumn("pruned", pruned).withColumn("visible", tombstone(F.col("content"), F.col("pruned"), F.col("is_error"))).drop("_prior")


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose call is not in their session. Results without a call id are no orphans."""
    return results.where("call_id is not null").join(calls.select("session_id", "call_id"), ["session_id", "call_id"], "left_anti")


def orphan_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    return calls.join(results.select("session_id", "call_id"), ["session_id", "call_id"], "left_anti")


def without_orphans(rows: DataFrame) -> DataFrame:
    """Rows with results without call removed, and assistants' call parts without result stripped.

    Both look at the rows as they came. ``rows``: session_id, ordinal, role, tool_call_id, parts. An
    assistant that is left without any part stays, with none. Calls and results meet by session and id; a
    call without id has no result, a result without call id stays.
    """
    called = rows.where("role = 'assistant'").select("session_id", F.explode(F.filter("parts", lambda p: p["type"] == "toolCall")).alias("p")).select("session_id", F.col("p.id").alias("tool_call_id")).distinct().withColumn("_called", F.lit(True))
    answers = rows.where(F.col("role").isin("toolResult", "bashExecution") & F.col("tool_call_id").isNotNull()).select("session_id", F.col("tool_call_id").alias("id")).distinct()
    asked = rows.where("role = 'assistant'").select("session_id", "ordinal", F.explode(F.filter("parts", lambda p: p["type"] == "toolCall")["id"]).alias("id"))
    lost = asked.join(answers, ["session_id", "id"], "left_anti").groupBy("session_id", "ordinal").agg(F.collect_set("id").alias("_lost"))
    kept = rows.join(called, ["session_id", "tool_call_id"], "left").where(~F.col("role").isin("toolResult", "bashExecution") | F.col("tool_call_id").isNull() | F.col("_called"))
    kept = kept.join(lost, ["session_id", "ordinal"], "left")
    none = F.array().cast("array<string>")
    parts = F.filter("parts", lambda p: F.coalesce(p["type"] != "toolCall", F.lit(True)) | (p["id"].isNotNull() & ~F.array_contains(F.coalesce("_lost", none), p["id"])))
    return kept.withColumn("parts", F.when(F.col("role") == "assistant", parts).otherwise(F.col("parts"))).drop("_called", "_lost")


def stripped_parts(parts: Column) -> Column:
    """Made-up tags removed from the text and input of each part."""
    clean = lambda s: F.when(s.isNotNull(), strip_hallucinated(s))
    return F.transform(parts, lambda p: p.withField("text", clean(p["text"])).withField("input", clean(p["input"])))


def savings(pruned: DataFrame) -> DataFrame:
    """Tokens saved in each session by what is pruned."""
    from threadloom.functions.tokens import estimate

    saved = F.greatest(estimate(F.col("content")) - estimate(F.col("visible")), F.lit(0))
    return pruned.groupBy("session_id").agg(F.count_if("duplicate").alias("n_duplicate"), F.count_if("stale").alias("n_stale"), F.sum(estimate(F.col("content"))).alias("tokens"), F.sum(F.when(F.col("pruned"), saved).otherwise(0)).alias("tokens_saved"))
