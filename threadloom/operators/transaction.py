"""Requests to summarise ranges: boundaries, checks, what they replace; all ranges of a request or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.refs import expand_placeholders, format_ref, parse_block_ref, parse_message_ref
from threadloom.functions.tokens import estimate
from threadloom.operators import artifacts, coverage, transcript
from threadloom.sources.folders import shared_folder


def boundaries(requests: DataFrame, refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add lo, hi (ordinals) and error of each range.

    A message reference stands for its row, a block reference for the block's first or last row. Errors,
    in this order: no-topic, invalid-start, invalid-end, inside-block (a known row that a block covers),
    unknown-start, unknown-end, only-block (both ends the same block), reversed. ``requests``:
    session_id, request_id, range_id, start_ref, end_ref, topic, summary; ``refs``: session_id, ref,
    ordinal, block_id (of the active block that covers the row, else null); ``blocks``: session_id,
    block_id, active, lo, hi.
    """
    active = blocks.where("active")
    out = requests
    for side, edge in (("start", "lo"), ("end", "hi")):
        number, block = parse_message_ref(F.col(f"{side}_ref")), parse_block_ref(F.col(f"{side}_ref"))
        out = out.withColumns({f"_m_{side}": F.when(number.isNotNull(), format_ref(number)), f"_b_{side}": block})
        known = refs.select("session_id", F.col("ref").alias(f"_m_{side}"), F.col("ordinal").alias(f"_at_{side}"), F.col("block_id").alias(f"_in_{side}"))
        spans = active.select("session_id", F.col("block_id").alias(f"_b_{side}"), F.col(edge).alias(f"_edge_{side}"))
        out = out.join(known, ["session_id", f"_m_{side}"], "left").join(spans, ["session_id", f"_b_{side}"], "left")
        free = F.when(F.col(f"_in_{side}").isNull(), F.col(f"_at_{side}"))
        out = out.withColumn(edge, F.coalesce(free, F.col(f"_edge_{side}")))

    def invalid(side: str) -> Column:
        return F.col(f"_m_{side}").isNull() & F.col(f"_b_{side}").isNull()

    error = (
        F.when(F.trim(F.coalesce("topic", F.lit(""))) == "", "no-topic")
        .when(invalid("start"), "invalid-start")
        .when(invalid("end"), "invalid-end")
        .when(F.col("_in_start").isNotNull() | F.col("_in_end").isNotNull(), "inside-block")
        .when(F.col("lo").isNull(), "unknown-start")
        .when(F.col("hi").isNull(), "unknown-end")
        .when(F.col("_b_start") == F.col("_b_end"), "only-block")
        .when(F.col("lo") > F.col("hi"), "reversed")
    )
    return out.withColumn("error", error).select(*requests.columns, "lo", "hi", "error")


def superseded(ranges: DataFrame, covered: DataFrame, blocks: DataFrame) -> DataFrame:
    """(session_id, range_id, block_id, relation) of active blocks that a range meets: ``supersedes`` if
    all rows the block covers lie in it, else ``partial-overlap``; also if its coverage isn't known
    (no rows in ``covered``: session_id, block_id, ordinal) but its bounds meet the range."""
    active = blocks.where("active")
    held = covered.join(active.select("session_id", "block_id"), ["session_id", "block_id"], "left_semi").distinct()
    places = coverage.within(held.select("session_id", "ordinal").distinct(), ranges, "range_id")
    sizes = held.groupBy("session_id", "block_id").agg(F.count("*").alias("_n"))
    met = held.join(places, ["session_id", "ordinal"]).groupBy("session_id", "range_id", "block_id").agg(F.count("*").alias("_k")).join(sizes, ["session_id", "block_id"])
    known = met.select("session_id", "range_id", "block_id", F.when(F.col("_k") == F.col("_n"), "supersedes").otherwise("partial-overlap").alias("relation"))
    vague = coverage.overlapping(ranges, active.join(sizes, ["session_id", "block_id"], "left_anti"))
    return known.unionByName(vague.withColumn("relation", F.lit("partial-overlap")))


def commit(checked: DataFrame, relations: DataFrame, next_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New blocks, and (session_id, block_id) of those they replace.

    A request with any error, any partial overlap, or two ranges that meet makes nothing. Block ids go on
    from ``next_ids`` (session_id, next_block_id) in order of request and range.
    """
    by = ["session_id", "request_id"]
    bad = checked.where("error is not null").select(*by)
    clash = relations.where("relation = 'partial-overlap'").join(checked.select("session_id", "range_id", "request_id"), ["session_id", "range_id"]).select(*by)
    before = F.max("hi").over(Window.partitionBy(*by).orderBy("lo", "range_id").rowsBetween(Window.unboundedPreceding, -1))
    twice = checked.where("error is null").withColumn("_before", before).where("lo <= _before").select(*by)
    good = checked.join(bad.unionByName(clash).unionByName(twice).distinct(), by, "left_anti")
    order = Window.partitionBy("session_id").orderBy("request_id", "range_id")
    made = good.join(next_ids, "session_id", "left").withColumn("block_id", (F.coalesce("next_block_id", F.lit(1)) + F.row_number().over(order) - 1).cast("long")).drop("next_block_id", "error")
    gone = relations.where("relation = 'supersedes'").join(good.select("session_id", "range_id"), ["session_id", "range_id"], "left_semi").select("session_id", "block_id").distinct()
    return made.withColumn("active", F.lit(True)), gone


def nearest_refs(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """(session_id, block_id, start_ref, end_ref): the first and last reference of rows within a block's
    bounds, null if it has none; of references to one row the one with the smallest number."""
    number = parse_message_ref(F.col("ref"))
    one = refs.groupBy("session_id", "ordinal").agg(F.min_by("ref", number).alias("ref"))
    places = coverage.within(one, blocks, "block_id")
    found = places.join(one, ["session_id", "ordinal"]).groupBy("session_id", "block_id").agg(F.min_by("ref", "ordinal").alias("start_ref"), F.max_by("ref", "ordinal").alias("end_ref"))
    return blocks.select("session_id", "block_id").join(found, ["session_id", "block_id"], "left")


def in_tail(checked: DataFrame, rows: DataFrame, tails: DataFrame) -> DataFrame:
    """Ranges of ``boundaries`` with the error protected-tail where nothing else is wrong, the range ends at or after
    its session's protected tail, and the context isn't over its limit. ``tails``: session_id, tail_start (time),
    emergency."""
    at = rows.select("session_id", F.col("ordinal").alias("hi"), F.col("ts").alias("_end"))
    out = checked.join(at, ["session_id", "hi"], "left").join(tails.select("session_id", "tail_start", "emergency"), "session_id", "left")
    late = F.coalesce((F.col("_end") >= F.col("tail_start")) & ~F.coalesce("emergency", F.lit(False)), F.lit(False))
    return out.withColumn("error", F.when(F.col("error").isNotNull(), F.col("error")).when(late, "protected-tail")).select(*checked.columns)


def complete(made: DataFrame, gone: DataFrame, rows: DataFrame, calls: DataFrame, refs: DataFrame, blocks: DataFrame, *, created_at: Column | None = None) -> DataFrame:
    """New blocks of ``commit`` with all that a block holds, in the columns of ``persistence.restored_blocks``, and
    lo, hi, request_id, range_id.

    Bounds are the range's, widened to whole exchanges; the anchor is the first reference after the range as asked
    for. What the rows told is kept as log, files, commands and keys, placeholders in the summary are
    expanded, and savings are the rows' tokens less those of the block as it is rendered. ``made`` has asked_hi,
    the end before widening, and call_id; ``rows``: as for ``artifacts``, with calls; ``refs``: session_id, ref,
    ordinal; ``blocks``: the session's blocks so far; ``gone``: session_id, range_id, block_id of those replaced.
    """
    key = ["session_id", "range_id"]
    ranges = made.select(*key, "lo", "hi")
    inside = coverage.within(rows, ranges, "range_id").checkpoint()
    touched = rows.join(made.select("session_id").distinct(), "session_id", "left_semi")
    own = rows.join(inside, ["session_id", "ordinal"])
    tools = artifacts.with_tools(touched, calls).checkpoint()
    mine = tools.join(inside, ["session_id", "ordinal"])

    def listed(df: DataFrame, name: str, order: list[str], **fields: Column) -> DataFrame:
        entry = F.struct(*(F.col(c).alias(f"_{k}") for k, c in enumerate(order)), F.struct(*(c.alias(n) for n, c in fields.items())).alias("e"))
        return df.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias(name))

    log = artifacts.activity_log(touched, tools).join(inside, ["session_id", "ordinal"])
    number = lambda c: F.col(c).cast("double")
    parts = [
        listed(log, "activity_log", ["ordinal"], kind=F.col("kind"), text=F.col("text")),
        listed(artifacts.file_reads(mine, *key), "file_reads", ["path"], path=F.col("path"), count=number("count"), line_spans=F.col("line_spans")),
        listed(artifacts.file_writes(mine, *key), "file_writes", ["path"], path=F.col("path"), edit_count=number("edit_count"), added_lines=number("added_lines"), removed_lines=number("removed_lines")),
        listed(artifacts.commands(tools).join(inside, ["session_id", "ordinal"]), "commands", ["ordinal"], command=F.col("command"), status=F.col("status")),
        artifacts.covered(rows, transcript.spans(touched), ranges).select(*key, *(F.col(c).alias(f"covered_{c}") for c in ("source_keys", "span_keys", "tool_ids", "artifact_refs"))),
        own.groupBy(*key).agg(F.sum(estimate(F.col("content"))).alias("removed"), F.min_by("ts", "ordinal").alias("start_ts"), F.max_by("ts", "ordinal").alias("end_ts")),
        gone.groupBy(*key).agg(F.array_sort(F.collect_set(F.col("block_id").cast("long"))).alias("superseded_block_ids")),
    ]
    known = rows.select("session_id", "ordinal", "source_key", "ts").join(refs.select("session_id", "ordinal").distinct(), ["session_id", "ordinal"])
    asked = made.select(*key, F.col("asked_hi").alias("hi")).join(rows.join(ranges.select(*key, F.col("hi").alias("ordinal")), ["session_id", "ordinal"]).select(*key, F.col("source_key").alias("end_key")), key)
    anchor = coverage.anchors(asked, known).withColumnRenamed("anchor", "anchor_source_key")
    anchor = anchor.join(known.select("session_id", F.col("source_key").alias("anchor_source_key"), F.col("ts").alias("anchor_ts")), ["session_id", "anchor_source_key"], "left")
    told = blocks.groupBy("session_id").agg(F.collect_list(F.struct(F.col("block_id").alias("id"), "topic", "summary")).alias("_told"))
    out = made.join(told, "session_id", "left").join(anchor, key, "left")
    for part in parts:
        out = out.join(part, key, "left")
    empty = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("activity_log", "file_reads", "file_writes", "commands", "superseded_block_ids")}
    out = out.withColumns(empty).withColumn("summary", F.when(F.col("_told").isNull(), F.col("summary")).otherwise(expand_placeholders(F.col("summary"), F.col("_told"))))
    text = coverage.rendered(F.col("topic"), F.col("summary"), F.lit("full"), F.col("activity_log"))
    inf = F.lit(float("inf"))
    return out.select(
        "session_id", "request_id", "range_id", "block_id", F.trim("topic").alias("topic"), "summary", F.lit(True).alias("active"), "lo", "hi", "start_ts", "end_ts", F.coalesce("anchor_ts", inf).alias("anchor_ts"),
        F.element_at("covered_source_keys", 1).alias("start_source_key"), F.element_at("covered_source_keys", -1).alias("end_source_key"), "anchor_source_key", estimate(F.col("summary")).cast("double").alias("summary_tokens"),
        F.greatest(F.col("removed") - estimate(text), F.lit(0)).cast("double").alias("saved_tokens"), (F.lit(None).cast("double") if created_at is None else created_at.cast("double")).alias("created_at"), F.col("call_id").alias("compress_call_id"),
        "superseded_block_ids", "covered_source_keys", "covered_span_keys", "covered_artifact_refs", "covered_tool_ids", "activity_log", "file_reads", "file_writes", "commands",
    )


def compress(requests: DataFrame, rows: DataFrame, calls: DataFrame, refs: DataFrame, blocks: DataFrame, *, tails: DataFrame | None = None, next_ids: DataFrame | None = None, created_at: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests to summarise, as one transaction each: the new blocks (``complete``), (session_id, block_id) of
    those that they replace, and the outcome of every range (session_id, request_id, range_id, error).

    All ranges of a request or none: a range that is wrong, ends in the protected tail (``tails``), parts an active
    block or meets another range of its request makes its request void. ``requests``: as for ``boundaries``, with
    call_id; ``rows``: session_id, ordinal, role, content, ts, source_key, calls, tool_call_id, tool_name, is_error;
    ``blocks``: session_id, block_id, active, lo, hi, topic, summary.
    """
    shared_folder(rows.sparkSession)
    checked = boundaries(requests, refs, blocks)
    if tails is not None:
        checked = in_tail(checked, rows, tails)
    good = checked.where("error is null")
    wide = coverage.closed(rows, good.select("session_id", "range_id", "lo", "hi")).select("session_id", "range_id", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    checked = checked.join(wide, ["session_id", "range_id"], "left").withColumns({"asked_hi": F.col("hi"), "lo": F.coalesce("_lo", "lo"), "hi": F.coalesce("_hi", "hi")}).drop("_lo", "_hi").checkpoint()
    relations = superseded(checked.where("error is null").select("session_id", "range_id", "lo", "hi"), coverage.covered_rows(rows, blocks), blocks).checkpoint()
    top = blocks.groupBy("session_id").agg((F.max("block_id") + 1).cast("long").alias("next_block_id")) if next_ids is None else next_ids
    made, replaced = commit(checked, relations, top)
    made = made.checkpoint()
    void = checked.join(made.select("session_id", "range_id", F.lit(True).alias("_made")), ["session_id", "range_id"], "left")
    outcome = void.select("session_id", "request_id", "range_id", F.when(F.col("_made").isNull(), F.coalesce("error", F.lit("request-refused"))).alias("error"))
    gone = relations.where("relation = 'supersedes'").join(made.select("session_id", "range_id"), ["session_id", "range_id"], "left_semi")
    return complete(made, gone, rows, calls, refs, blocks, created_at=created_at), replaced, outcome
