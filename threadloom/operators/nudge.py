"""Reminders: whether a context pass asks for a summary, and which one, debounced by turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.tokens import exceeds_max, reaches_min, short_number


def nudge_type(percent: Column, tokens: Column, turn: Column, last_nudge: Column, last_compress: Column, calls: Column, config: dict) -> Column:
    """context-strong / context-soft / iteration / turn, or null. ``config``: the compress section."""
    debounce = max(1, config["nudgeDebounceTurns"])
    quiet = ~reaches_min(percent, tokens, config) | (turn <= last_compress) | ((last_nudge >= 0) & (turn - last_nudge < debounce))
    context = "context-strong" if config["nudgeForce"] == "strong" else "context-soft"
    return F.when(quiet, F.lit(None).cast("string")).when(exceeds_max(percent, tokens, config), context).when(calls >= config["iterationNudgeThreshold"], "iteration").otherwise("turn")


def nudge_reason(kind: Column, percent: Column, tokens: Column, turn: Column, last_nudge: Column, last_compress: Column, config: dict) -> Column:
    """Why a reminder goes out or not. ``kind``: of ``nudge_type``."""
    recent = (last_nudge >= 0) & (turn - last_nudge < max(1, config["nudgeDebounceTurns"]))
    debounced_ = F.when(last_compress >= last_nudge, "same_turn_or_post_compress_debounce").otherwise("turn_debounce")
    return (
        F.when(percent.isNull(), "no_context_usage")
        .when(kind.isNotNull(), "emitted")
        .when(~reaches_min(percent, tokens, config), "below_min_threshold")
        .when(turn <= last_compress, "same_turn_or_post_compress_debounce")
        .when(recent, debounced_)
        .otherwise("not_evaluated")
    )


#: How reminders begin.
OVER_TARGET = "Compress now: over DCP cleanup target{0}. Compress every eligible stretch below — not just the biggest. The list is a suggestion: you may also re-compress across existing `bN` blocks (merging or rewriting prior summaries) when that better serves the live task. `bN` summaries stay citable; carrying closed work raw degrades retrieval."
AFTER_TOOLS = "DCP checkpoint{0}. After a long tool run, compress every eligible stretch below — not just the biggest. The list is a suggestion: you may also re-compress across existing `bN` blocks when that better serves the live task. `bN` summaries stay citable; carrying closed work raw degrades retrieval."
CHECKPOINT = "DCP checkpoint{0}. Compress every eligible stretch below — not just the biggest. The list is a suggestion: you may also re-compress across existing `bN` blocks when that better serves the live task. `bN` summaries stay citable; carrying closed work raw degrades retrieval."


def header(kind: Column, percent: Column, tokens: Column, config: dict) -> Column:
    """A reminder's first line, with the limits in tokens that are configured."""
    least, most = (short_number(F.lit(config[c]).cast("long")) if isinstance(config.get(c), (int, float)) else None for c in ("minContextTokens", "maxContextTokens"))
    if least is not None and most is not None:
        target = F.concat(F.lit(" ("), least, F.lit("-"), most, F.lit(" tokens)"))
    elif most is not None:
        target = F.concat(F.lit(" ("), most, F.lit(" tokens)"))
    elif least is not None:
        target = F.concat(F.lit(" (starts around "), least, F.lit(" tokens)"))
    else:
        target = F.lit("")

    def text(form: str) -> Column:
        before, after = form.split("{0}")
        return F.concat(F.lit(before), target, F.lit(after))

    over = F.coalesce(exceeds_max(percent, tokens, config), F.lit(False)) | (kind == "context-strong")
    return F.when(kind.isNull(), F.lit(None).cast("string")).when(over, text(OVER_TARGET)).when(kind == "iteration", text(AFTER_TOOLS)).otherwise(text(CHECKPOINT))


#: How urgent each kind is.
PRIORITY = {"context-strong": 100, "context-soft": 80, "iteration": 60, "turn": 40}


def priority(kind: Column) -> Column:
    case = F.lit(None).cast("int")
    for name, p in PRIORITY.items():
        case = F.when(kind == name, p).otherwise(case)
    return case


def debounced(passes: DataFrame, debounce: int) -> DataFrame:
    """(session_id, turns): the turns at which reminders go out, greedily, at least ``debounce`` apart.

    ``passes``: session_id, turn, wanted. Each sent reminder resets the count, so a session is folded in
    order over its array of wanted turns.
    """
    step = max(1, debounce)
    turns = F.sort_array(F.collect_set(F.when(F.col("wanted"), F.col("turn"))))
    none = F.array().cast("array<bigint>")
    sent = F.aggregate("_w", none, lambda out, t: F.when((F.size(out) == 0) | (t - F.element_at(out, -1) >= step), F.array_append(out, t.cast("bigint"))).otherwise(out))
    # element_at of an empty array is not reached: the first test holds then
    return passes.groupBy("session_id").agg(turns.alias("_w")).select("session_id", sent.alias("turns"))
