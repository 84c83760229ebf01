"""Session logs: append-only JSON lines, one file a session.

A line keeps its place and its raw bytes; what isn't JSON is left out. The same projection works on a
stream of files.
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def field(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def entries(lines: DataFrame) -> DataFrame:
    """(session_id, pos, raw, v, id, parent_id, type, custom_type, ts) from (session_id, pos, raw)."""
    parsed = lines.withColumn("v", F.try_parse_json("raw")).where(F.col("v").isNotNull())
    stamp = F.coalesce(F.try_variant_get("v", "$.timestamp", "double"), F.unix_millis(F.try_to_timestamp(field("v", "timestamp"))).cast("double"))
    return parsed.select(
        "session_id", "pos", "raw", "v", field("v", "id").alias("id"), field("v", "parentId").alias("parent_id"), field("v", "type").alias("type"), field("v", "customType").alias("custom_type"), F.coalesce(stamp, F.lit(0.0)).alias("ts")
    )


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.jsonl`` below a folder. A file is read whole, as only its own order numbers its lines."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    lines = files.select(F.col("_metadata.file_path").alias("session_id"), F.posexplode(F.split("value", "\n")).alias("pos", "raw"))
    return entries(lines.where(F.trim("raw") != ""))


def stream_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The streaming twin: new files as they come; places within a file as in the batch."""
    files = spark.readStream.option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    lines = files.select(F.col("_metadata.file_path").alias("session_id"), F.posexplode(F.split("value", "\n")).alias("pos", "raw"))
    return entries(lines.where(F.trim("raw") != ""))


def write_sessions(rows: DataFrame, path: str) -> None:
    """Raw lines back to text, a folder for each session, in order; bytes as they were."""
    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", "pos")
    ordered.select(F.regexp_replace("session_id", r"[^A-Za-z0-9._-]", "_").alias("session"), F.col("raw").alias("value")).write.partitionBy("session").mode("errorifexists").text(path)


#: A part of a message's content.
PART = "struct<type:string,text:string,thinking:string,input:string,id:string,name:string,arguments:string>"


def as_messages(rows: DataFrame) -> DataFrame:
    """Message rows of a branch's entries: messages as they are, custom messages, branch summaries and
    compactions under their own roles; other kinds are left out.

    Content that is text is in ``content``, content in parts in ``parts`` (in the form of ``PART``); a summary is
    one part of text.
    """
    m = lambda path, kind="string": F.try_variant_get("v", f"$.message.{path}", kind)
    said = F.col("type") == "message"
    role = F.when(said, m("role")).when(F.col("type").isin("custom_message", "branch_summary", "compaction"), F.col("type"))
    own = F.when(said, m("content", "variant")).when(F.col("type") == "custom_message", F.try_variant_get("v", "$.content", "variant"))
    listed = F.coalesce(F.schema_of_variant(own).startswith("ARRAY"), F.lit(False))
    summary = F.when(F.col("type").isin("branch_summary", "compaction"), field("v", "summary"))
    none = F.lit(None).cast("string")
    one = F.array(F.struct(F.lit("text").alias("type"), summary.alias("text"), *(none.alias(c) for c in ("thinking", "input", "id", "name", "arguments"))).cast(PART))
    parts = F.when(summary.isNotNull(), one).when(listed, F.from_json(F.to_json(own), f"array<{PART}>"))
    content = F.when(~listed, F.try_variant_get(own, "$", "string"))
    ts = F.when(said, F.coalesce(m("timestamp", "double"), F.col("ts"))).otherwise(F.col("ts"))
    more = {"message_ts": ts, "tool_call_id": m("toolCallId"), "tool_name": m("toolName"), "is_error": F.coalesce(m("isError", "boolean"), F.lit(False))}
    return rows.withColumns({"role": role, "content": content, "parts": F.coalesce(parts, F.array().cast(f"array<{PART}>")), **more}).where("role is not null")


def sse_payloads(bodies: DataFrame) -> DataFrame:
    """(capture_id, seq, v) of the data lines of event-stream bodies (capture_id, body); [DONE] and what
    isn't JSON are left out."""
    lines = bodies.select("capture_id", F.posexplode(F.split("body", "\r?\n")).alias("seq", "line")).where(F.col("line").startswith("data:"))
    data = lines.withColumn("data", F.trim(F.substring("line", 6, 1 << 30))).where("data <> '[DONE]'")
    return data.select("capture_id", "seq", F.try_parse_json("data").alias("v")).where("v is not null")


def debug_lines(events: DataFrame, payload: list[str]) -> DataFrame:
    """(value): a JSON line for each of ``events`` (ts, event and the columns of ``payload``). Numbers that
    aren't finite are written as text, nulls are kept."""
    stamp = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    entry = F.struct(stamp.alias("timestamp"), "event", F.struct(*payload).alias("payload"))
    return events.select(F.to_json(entry, {"ignoreNullFields": "false"}).alias("value"))


def write_debug(events: DataFrame, payload: list[str], path: str) -> None:
    """Append the lines of ``debug_lines`` to a folder."""
    debug_lines(events, payload).write.mode("append").text(path)


def decoded(body: Column, encoding: Column) -> Column:
    """A captured body (binary) without its gzip or deflate encoding. One that doesn't decode, or has another
    encoding, comes back as it was."""

    @F.pandas_udf("binary")
    def decode(bodies: pd.Series, encodings: pd.Series) -> pd.Series:
        def one(data: bytes | None, name: str | None) -> bytes | None:
            name = (name or "").lower()
            way = gzip.decompress if "gzip" in name else zlib.decompress if "deflate" in name and "br" not in name else None
            try:
                return way(data) if way and data is not None else data
            except (OSError, EOFError, zlib.error):
                return data

        return pd.Series([one(*x) for x in zip(bodies, encodings, strict=True)])

    return decode(body, encoding)
