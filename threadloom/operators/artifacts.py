"""Tool records, and what a block keeps of the rows it stands for: log, files, commands, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import line_count, normalize_inline, strip_metadata, truncate
from threadloom.functions.tokens import estimate
from threadloom.functions.tools import EXCERPT_CHARS, argument_summary, command_kind, edit_stats, fingerprint, line_span, number_argument, shown_command, text_argument
from threadloom.operators.coverage import within

RESULT_ROLES = ("toolResult", "bashExecution")
EDITS = "array<struct<oldText:string,newText:string>>"


def tool_records(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(session_id, tool_call_id, tool_name, arguments, fingerprint, turn_index, is_error, tokens).

    Of a call id the first call counts and the last result. A result without call makes a record with
    empty arguments in its own turn. ``calls``: session_id, tool_call_id, pos, tool_name, arguments,
    turn_index; ``results``: session_id, tool_call_id, pos, tool_name, turn_index, is_error, content.
    """
    key = ["session_id", "tool_call_id"]
    first = calls.groupBy(key).agg(F.min_by(F.struct("tool_name", "arguments", "turn_index"), "pos").alias("_call"))
    last = results.groupBy(key).agg(F.max_by(F.struct("is_error", "content"), "pos").alias("_last"), F.min_by(F.struct("tool_name", F.lit("{}").alias("arguments"), "turn_index"), "pos").alias("_made"))
    out = first.join(last, key, "full").withColumn("_c", F.coalesce("_call", "_made"))
    return out.select(*key, "_c.tool_name", "_c.arguments", fingerprint(F.col("_c.tool_name"), F.col("_c.arguments")).alias("fingerprint"), "_c.turn_index", F.coalesce("_last.is_error", F.lit(False)).alias("is_error"), estimate(F.col("_last.content")).alias("tokens"))


def excerpted(text: Column) -> Column:
    """A row's text on one line without tags, in quotes; null if nothing is left."""
    own = normalize_inline(strip_metadata(text))
    return F.when(own != "", F.concat(F.lit('"'), truncate(own, EXCERPT_CHARS), F.lit('"')))


def with_tools(rows: DataFrame, calls: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Result rows with ``name`` and ``args``: the row's own name, else that of the last call of this id in
    the transcript, else the record's; arguments of the call, else of the record."""
    key = ["session_id", "tool_call_id"]
    last = calls.groupBy(key).agg(F.max_by(F.struct("tool_name", "arguments"), "ordinal").alias("_call"))
    out = rows.where(F.col("role").isin(*RESULT_ROLES)).join(last, key, "left")
    if records is None:
        out = out.withColumn("_record", F.lit(None).cast("struct<tool_name:string,arguments:string>"))
    else:
        out = out.join(records.select(*key, F.struct("tool_name", "arguments").alias("_record")), key, "left")
    return out.withColumns({"name": F.coalesce("tool_name", "_call.tool_name", "_record.tool_name"), "args": F.coalesce("_call.arguments", "_record.arguments", F.lit("{}"))}).drop("_call", "_record")


def _path() -> Column:
    return F.coalesce(text_argument(F.col("args"), "path"), F.lit("(unknown path)"))


def _edits() -> Column:
    held = F.from_json(F.get_json_object("args", "$.edits"), EDITS)
    none = F.lit("")
    pairs = F.transform(F.coalesce(held, F.array().cast(EDITS)), lambda e: F.struct(F.coalesce(e["oldText"], none).alias("old"), F.coalesce(e["newText"], none).alias("new")))
    return edit_stats(pairs)


def activity_log(rows: DataFrame, tools: DataFrame) -> DataFrame:
    """(session_id, ordinal, kind, text): one entry for each row that has something to tell. ``rows``:
    session_id, ordinal, role, content; ``tools``: from ``with_tools``."""
    said = rows.where(F.col("role").isin("user", "assistant")).select("session_id", "ordinal", F.concat("role", F.lit("_excerpt")).alias("kind"), excerpted(F.col("content")).alias("text")).where("text is not null")
    name, span, e = F.col("name"), line_span(number_argument(F.col("args"), "offset"), number_argument(F.col("args"), "limit")), _edits()
    command = F.coalesce(text_argument(F.col("args"), "command"), F.lit("(unknown command)"))
    status = F.when(F.coalesce("is_error", F.lit(False)), "error").otherwise("ok")
    written = line_count(F.coalesce(text_argument(F.col("args"), "content"), F.lit("")))
    edited = F.concat(_path(), F.lit(" ("), e["edit_count"].cast("string"), F.when(e["edit_count"] == 1, " edit, +").otherwise(" edits, +"), e["added_lines"].cast("string"), F.lit("/-"), e["removed_lines"].cast("string"), F.lit(")"))
    suffix = argument_summary(F.col("args"))
    kind = F.when(name.isin("read", "edit", "write"), name).when(name == "bash", command_kind(command)).otherwise("tool")
    text = (
        F.when(name == "read", F.concat_ws("#", _path(), span))
        .when(name == "edit", edited)
        .when(name == "write", F.concat(_path(), F.lit(" ("), written.cast("string"), F.lit(" lines)")))
        .when(name == "bash", F.concat(shown_command(command), F.lit(" -> "), status))
        .otherwise(F.concat_ws(" ", name, F.nullif(suffix, F.lit(""))))
    )
    return said.unionByName(tools.where("name is not null").select("session_id", "ordinal", kind.alias("kind"), text.alias("text")))


def _first_seen(value: Column) -> Column:
    """Distinct values that aren't null, in order of place."""
    ordered = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct("ordinal", value.alias("v")))))
    return F.array_distinct(F.transform(ordered, lambda x: x["v"]))


def file_reads(tools: DataFrame, *by: str) -> DataFrame:
    """(by, path, count, line_spans) of reads; spans in order of first sight."""
    span = line_span(number_argument(F.col("args"), "offset"), number_argument(F.col("args"), "limit"))
    return tools.where("name = 'read'").withColumns({"path": _path(), "_span": span}).groupBy(*by, "path").agg(F.count("*").alias("count"), _first_seen(F.col("_span")).alias("line_spans"))


def file_writes(tools: DataFrame, *by: str) -> DataFrame:
    """(by, path, edit_count, added_lines, removed_lines) of edits and writes; a write is one edit that adds
    all its lines."""
    written = F.struct(F.lit(1).alias("edit_count"), line_count(F.coalesce(text_argument(F.col("args"), "content"), F.lit(""))).alias("added_lines"), F.lit(0).alias("removed_lines"))
    one = tools.where("name in ('edit', 'write')").withColumns({"path": _path(), "_s": F.when(F.col("name") == "edit", _edits()).otherwise(written)})
    return one.groupBy(*by, "path").agg(*(F.sum(f"_s.{c}").alias(c) for c in ("edit_count", "added_lines", "removed_lines")))


def commands(tools: DataFrame) -> DataFrame:
    """(session_id, ordinal, command, status) of shell calls."""
    command = F.coalesce(text_argument(F.col("args"), "command"), F.lit("(unknown command)"))
    return tools.where("name = 'bash'").select("session_id", "ordinal", command.alias("command"), F.when(F.coalesce("is_error", F.lit(False)), "error").otherwise("ok").alias("status"))


def covered(rows: DataFrame, spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """(session_id, range_id, source_keys, span_keys, tool_ids, artifact_refs) of ranges.

    Spans count if they lie in the range whole; ids and references are distinct, in order of first sight.
    ``rows``: session_id, ordinal, role, ts, source_key, tool_call_id; ``ranges``: session_id, range_id,
    lo, hi. Rows and ranges meet by stretches of ordinals.
    """
    places = within(rows, ranges, "range_id")
    tool = F.when(F.col("role").isin(*RESULT_ROLES), F.col("tool_call_id"))
    own = rows.join(places, ["session_id", "ordinal"]).withColumn("_tool", tool)
    refs = F.array_compact(F.array(F.concat(F.lit("message:"), F.col("ts").cast("long").cast("string")), F.concat(F.lit("tool:"), F.col("_tool"))))
    in_order = F.sort_array(F.collect_list(F.struct("ordinal", F.col("source_key").alias("k"), refs.alias("r"))))
    out = own.groupBy("session_id", "range_id").agg(in_order.alias("_o"), _first_seen(F.col("_tool")).alias("tool_ids"))
    whole = spans.select("session_id", F.col("lo").alias("ordinal"), F.col("hi").alias("_to"), "span_key").join(places.join(ranges, ["session_id", "range_id"]), ["session_id", "ordinal"]).where("_to <= hi")
    keys = whole.groupBy("session_id", "range_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "span_key"))), lambda x: x["span_key"]).alias("span_keys"))
    return out.join(keys, ["session_id", "range_id"], "left").select(
        "session_id", "range_id", F.transform("_o", lambda x: x["k"]).alias("source_keys"), F.coalesce("span_keys", F.array().cast("array<string>")).alias("span_keys"), "tool_ids", F.array_distinct(F.flatten(F.transform("_o", lambda x: x["r"]))).alias("artifact_refs")
    )
