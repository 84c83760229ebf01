"""Which rows summary blocks cover, who is still live, and how blocks take the place of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import normalize_inline, strip_metadata, trimmed, truncate
from threadloom.functions.tokens import estimate
from threadloom.sources.folders import shared_folder

#: Sizes of rendered blocks.
COMPACT_CHARS, MINIMAL_CHARS, LOG_LINES, LOG_CHARS = 640, 240, 96, 800
#: Places of a stretch by which ranges and rows are joined.
STRETCH = 64


def _blocked(ranges: DataFrame) -> DataFrame:
    """Ranges (lo <= hi) once for each stretch of ``STRETCH`` places that they touch, as _s."""
    first, last = (F.floor(F.col(c) / STRETCH) for c in ("lo", "hi"))
    return ranges.where("lo <= hi").withColumn("_s", F.explode(F.sequence(first, last)))


def within(rows: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(session_id, key, ordinal) of the rows in each range (session_id, key, lo, hi); an equi-join on the session
    and a stretch of ordinals, so a long session's rows meet only ranges nearby."""
    b = _blocked(ranges.select("session_id", key, "lo", "hi"))
    return rows.select("session_id", "ordinal", F.floor(F.col("ordinal") / STRETCH).alias("_s")).join(b, ["session_id", "_s"]).where(F.col("ordinal").between(F.col("lo"), F.col("hi"))).select("session_id", key, "ordinal")


def covered_rows(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(session_id, block_id, ordinal) by ordinal range."""
    return within(rows, blocks, "block_id")


def exact_coverage(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(session_id, block_id, resolved, ordinals) from blocks' covered_source_keys; a block is resolved
    only if every key is found, else its ordinals are null and times must decide."""
    keys = blocks.select("session_id", "block_id", F.explode_outer("covered_source_keys").alias("source_key"))
    found = keys.join(rows.select("session_id", "source_key", "ordinal"), ["session_id", "source_key"], "left")
    out = found.groupBy("session_id", "block_id").agg(F.bool_and(F.col("ordinal").isNotNull()).alias("resolved"), F.sort_array(F.collect_set("ordinal")).alias("ordinals"))
    return out.withColumn("ordinals", F.when(F.col("resolved"), F.col("ordinals")))


def time_coverage(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Coverage by start and end time, for blocks without keys. Rows without a time and blocks that lack one
    cover nothing; times become places in order of time, then it goes as in ``covered_rows``."""
    timed = rows.where("ts is not null").select("session_id", F.col("ts").alias("_t"), F.lit(1).alias("_kind"), "ordinal", F.lit(None).cast(blocks.schema["block_id"].dataType).alias("block_id"))
    whole = blocks.where("start_ts is not null and end_ts is not null")
    edges = [whole.select("session_id", F.col(c).cast("double").alias("_t"), F.lit(kind).alias("_kind"), F.lit(None).cast(rows.schema["ordinal"].dataType).alias("ordinal"), "block_id") for c, kind in (("start_ts", 0), ("end_ts", 2))]
    upto = Window.partitionBy("session_id").orderBy("_t", "_kind", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    placed = timed.withColumn("_t", F.col("_t").cast("double")).unionByName(edges[0]).unionByName(edges[1]).withColumn("_at", F.count_if(F.col("_kind") == 1).over(upto))
    lo, hi = (F.max(F.when(F.col("_kind") == k, F.col("_at"))) for k in (0, 2))
    spans = placed.where("_kind <> 1").groupBy("session_id", "block_id").agg((lo + 1).alias("lo"), hi.alias("hi"))
    own = placed.where("_kind = 1").select("session_id", F.col("_at").alias("ordinal"), F.col("ordinal").alias("_o"))
    found = covered_rows(own, spans)
    return found.join(own, ["session_id", "ordinal"]).select("session_id", "block_id", F.col("_o").alias("ordinal"))


def live_owners(rows: DataFrame, covered: DataFrame, blocks: DataFrame, eligible: Column) -> DataFrame:
    """(session_id, owner): eligible rows that no active block covers, and those blocks."""
    own = rows.where(eligible).join(covered.select("session_id", "ordinal").distinct(), ["session_id", "ordinal"], "left_anti")
    own = own.select("session_id", F.concat(F.lit("s"), F.col("ordinal").cast("string")).alias("owner"))
    return own.unionByName(blocks.where("active").select("session_id", F.concat(F.lit("block:b"), F.col("block_id").cast("string")).alias("owner")))


def detail_levels(blocks: DataFrame, full: int = 4, compact: int = 8) -> DataFrame:
    """Add detail: the newest blocks in full, the next compact, the rest minimal."""
    newest = Window.partitionBy("session_id").orderBy(F.coalesce("created_at", F.col("block_id").cast("double")).desc(), "block_id")
    n = F.row_number().over(newest)
    return blocks.where("active").withColumn("detail", F.when(n <= full, "full").when(n <= full + compact, "compact").otherwise("minimal"))


def log_line(entry: Column) -> Column:
    prefix = F.when(entry["kind"] == "user_excerpt", "u: ").when(entry["kind"] == "assistant_excerpt", "a: ").when(entry["kind"] == "command", "cmd: ").otherwise(F.concat(entry["kind"], F.lit(": ")))
    return F.concat(prefix, truncate(normalize_inline(strip_metadata(entry["text"])), LOG_CHARS))


def rendered(topic: Column, summary: Column, detail: Column, activity_log: Column | None = None) -> Column:
    """A block as text: header, summary in the given detail, and in full detail its activity log."""
    head, gap = F.concat(F.lit("[Compressed section: "), topic, F.lit("]")), F.lit("\n\n")
    bare = trimmed(summary)
    tagged = lambda s: F.concat(F.lit("<agent-summary>\n"), s, F.lit("\n</agent-summary>"))
    full = bare
    if activity_log is not None:
        lines = F.array_join(F.transform(F.slice(activity_log, 1, LOG_LINES), log_line), "\n")
        full = F.when(F.size(activity_log) > 0, F.concat(tagged(bare), gap, F.lit("<activity-log>\n"), lines, F.lit("\n</activity-log>"))).otherwise(bare)
    body = F.when(detail == "minimal", truncate(normalize_inline(bare), MINIMAL_CHARS)).when(detail == "compact", tagged(truncate(bare, COMPACT_CHARS))).otherwise(full)
    return F.concat(head, gap, F.lit(""), gap, body, gap, F.lit(""))


def spliced(rows: DataFrame, blocks: DataFrame, carried: tuple[str, ...] = (), *, full: int = 4, compact: int = 8) -> DataFrame:
    """Rows with each block's range replaced by one user row in its place, and a new dense ordinal.
    Columns ``carried`` along are null in rows of blocks.

    For blocks of a session that do not overlap (``overlapping`` finds the others).
    """
    levels = detail_levels(blocks, full, compact)
    covered = covered_rows(rows, levels)
    left = rows.join(covered.select("session_id", "ordinal"), ["session_id", "ordinal"], "left_anti").select("session_id", F.col("ordinal").cast("double").alias("_at"), "role", "content", F.lit(None).cast("int").alias("block_id"), *carried)
    made = levels.select("session_id", F.col("lo").cast("double").alias("_at"), F.lit("user").alias("role"), rendered(F.col("topic"), F.col("summary"), F.col("detail")).alias("content"), "block_id")
    order = Window.partitionBy("session_id").orderBy("_at")
    return left.unionByName(made, allowMissingColumns=True).withColumn("ordinal", F.row_number().over(order) - 1).drop("_at")


def block_savings(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tokens removed, added and saved (not below 0) by each active block."""
    levels = detail_levels(blocks)
    removed = covered_rows(rows, levels).join(rows.select("session_id", "ordinal", "content"), ["session_id", "ordinal"]).groupBy("session_id", "block_id").agg(F.sum(estimate(F.col("content"))).alias("removed"))
    out = levels.join(removed, ["session_id", "block_id"], "left").select("session_id", "block_id", F.coalesce("removed", F.lit(0)).alias("removed"), estimate(rendered(F.col("topic"), F.col("summary"), F.col("detail"))).alias("added"))
    return out.withColumn("saved", F.greatest(F.col("removed") - F.col("added"), F.lit(0)))


def overlapping(new: DataFrame, blocks: DataFrame) -> DataFrame:
    """Active blocks that a new range touches: whether it holds all their rows (then it supersedes them)
    or only some (then it is refused). ``new``: session_id, range_id, lo, hi, with lo <= hi.

    A range and a block meet in the first stretch that both have, so each pair comes once.
    """
    a, b = _blocked(new.select("session_id", "range_id", "lo", "hi")).alias("a"), _blocked(blocks.where("active").select("session_id", "block_id", "lo", "hi")).alias("b")
    first = F.col("a._s") == F.floor(F.greatest("a.lo", "b.lo") / STRETCH)
    hit = a.join(b, (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a._s") == F.col("b._s"))).where((F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi")) & first)
    inside = (F.col("a.lo") <= F.col("b.lo")) & (F.col("b.hi") <= F.col("a.hi"))
    return hit.select("a.session_id", "range_id", "block_id", F.when(inside, "supersedes").otherwise("partial-overlap").alias("relation"))


def anchors(ranges: DataFrame, refs: DataFrame) -> DataFrame:
    """The first reference strictly after each range's end, tail:<end key> if there is none.

    ``ranges``: session_id, range_id, hi, end_key; ``refs``: session_id, ordinal, source_key. One pass from
    a session's end to its start, in which each range takes the last reference passed.
    """
    r = ranges.select("session_id", F.col("hi").alias("_at"), F.lit(0).alias("_ref"), "range_id", "end_key")
    k = refs.select("session_id", F.col("ordinal").alias("_at"), F.lit(1).alias("_ref"), F.col("source_key").alias("_key"))
    down = Window.partitionBy("session_id").orderBy(F.col("_at").desc(), "_ref", F.col("_key").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(k, allowMissingColumns=True).withColumn("_next", F.last("_key", True).over(down))
    return both.where("_ref = 0").select("session_id", "range_id", F.coalesce("_next", F.concat(F.lit("tail:"), F.col("end_key"))).alias("anchor"))


def closed(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges widened so that no call is parted from its results.

    Backward: if the row before the range, results and passthrough rows left out, is an assistant with a
    call whose result lies in the range, the range begins with it; this repeats as long as a range moves.
    Forward: following results of calls in the range and passthrough rows are taken in. ``rows``:
    session_id, ordinal, role, calls, tool_call_id; ``ranges``: session_id, range_id, lo, hi. All joins are
    by equality: rows that can be taken in stand in one run after a row that can't.
    """
    shared_folder(rows.sparkSession)
    result, soft = F.col("role").isin("toolResult", "bashExecution"), F.col("role").isin("toolResult", "bashExecution", "compaction", "branch_summary", "custom_message")
    upto = Window.partitionBy("session_id").orderBy("ordinal")
    solid = F.when(~soft, F.struct("ordinal", "role"))
    placed = rows.withColumns({"_run": F.last(F.when(~soft, F.col("ordinal")), True).over(upto), "_head": F.last(solid, True).over(upto.rowsBetween(Window.unboundedPreceding, -1))})
    calls = rows.where("role = 'assistant'").select("session_id", F.col("ordinal").alias("at"), F.explode("calls").alias("call_id"))
    results = rows.where(result & F.col("tool_call_id").isNotNull()).select("session_id", F.col("ordinal").alias("answered"), F.col("tool_call_id").alias("call_id"))
    pairs = calls.join(results, ["session_id", "call_id"]).select("session_id", "at", "answered")
    heads = placed.where("_head.role = 'assistant'").select("session_id", F.col("ordinal").alias("lo"), F.col("_head.ordinal").alias("at"))
    while True:
        wider = ranges.join(heads, ["session_id", "lo"]).join(pairs, ["session_id", "at"]).where(F.col("answered").between(F.col("lo"), F.col("hi"))).groupBy("session_id", "range_id").agg(F.min("at").alias("_lo")).checkpoint()
        if not wider.take(1):
            break
        ranges = ranges.join(wider, ["session_id", "range_id"], "left").select("session_id", "range_id", F.coalesce("_lo", "lo").alias("lo"), "hi").checkpoint()
    run = placed.select("session_id", F.col("ordinal").alias("hi"), F.coalesce("_run", F.lit(-1)).alias("_run"))
    after = placed.where(soft).select("session_id", F.coalesce("_run", F.lit(-1)).alias("_run"), F.col("ordinal").alias("_next"), result.alias("_result"))
    near = ranges.join(run, ["session_id", "hi"]).join(after, ["session_id", "_run"]).where("_next > hi")
    own = pairs.select("session_id", F.col("answered").alias("_next"), F.col("at").alias("_at"))
    near = near.join(own, ["session_id", "_next"], "left").groupBy("session_id", "range_id", "hi", "_next").agg(F.bool_or(~F.col("_result") | F.coalesce(F.col("_at").between(F.col("lo"), F.col("hi")), F.lit(False))).alias("_ours"))
    ends = near.groupBy("session_id", "range_id").agg(F.min(F.when(~F.col("_ours"), F.col("_next"))).alias("_stop"), F.max("_next").alias("_last"))
    return ranges.join(ends, ["session_id", "range_id"], "left").select("session_id", "range_id", "lo", F.coalesce(F.col("_stop") - 1, "_last", "hi").alias("hi"))


def candidate_ranges(spans_: DataFrame, top: int = 10) -> DataFrame:
    """Stretches that could be summarised, the largest first.

    ``spans_``: session_id, ordinal, kind ('F' ends a stretch, 'R' has a reference, 'T' is transparent and
    counts only between references), ref, tokens. Adds the totals over all stretches of a session.
    """
    w = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = spans_.withColumn("_i", F.sum(F.when(F.col("kind") == "F", 1).otherwise(0)).over(w)).where("kind <> 'F'")
    usable = (F.col("kind") == "R") & (F.col("tokens") > 0)
    isle = Window.partitionBy("session_id", "_i")
    rows = rows.withColumns({"_lo": F.min(F.when(usable, F.col("ordinal"))).over(isle), "_hi": F.max(F.when(usable, F.col("ordinal"))).over(isle)}).where("ordinal between _lo and _hi")
    out = rows.groupBy("session_id", "_i").agg(
        F.min_by("ref", F.when(usable, F.col("ordinal"))).alias("start_ref"), F.max_by("ref", F.when(usable, F.col("ordinal"))).alias("end_ref"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_spans")
    ).where("tokens > 0")
    every = Window.partitionBy("session_id")
    rank = F.row_number().over(every.orderBy(F.col("tokens").desc(), "start_ref"))
    out = out.withColumns({"all_tokens": F.sum("tokens").over(every), "all_ranges": F.count("*").over(every), "rank": rank})
    return out.where(F.col("rank") <= top).drop("_i")
