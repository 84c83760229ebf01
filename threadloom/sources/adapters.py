"""The star-schema test tables read as messages, tool logs, call pairs and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as (session_id, ordinal, role, content, ts)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), (F.row_number().over(order) - 1).alias("ordinal"), "role", F.col("text").alias("content"), ((F.col("turn") + 1) * 1000).cast("double").alias("ts")
    )


def tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of tool results, each an exchange and turn of its own."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), (F.row_number().over(order) - 1).alias("turn_index"), F.col("event_id").cast("string").alias("tool_call_id"), F.col("event_type").alias("tool_name"),
        F.col("props").alias("arguments"), (F.col("event_type") == "error").alias("is_error"), F.col("props").alias("content"),
    )


def call_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders that are not final as calls, lineitems as results; some results have lost their call.
    Call ids come again in other sessions."""
    calls = read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select((F.col("o_orderkey") % 50).alias("session_id"), (F.col("o_orderkey") % 1000).alias("call_id"))
    results = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("session_id"), (F.col("l_orderkey") % 1000 + F.when(F.col("l_linenumber") == 7, 500).otherwise(0)).alias("call_id"), F.col("l_linenumber").alias("line"))
    return calls, results


def blocks(messages_: DataFrame) -> DataFrame:
    """For each session one active block over ordinals 1 to 3, and a later one over 5 to 6."""
    spans = F.array(F.struct(F.lit(1).alias("id"), F.lit(1).alias("lo"), F.lit(3).alias("hi")), F.struct(F.lit(2).alias("id"), F.lit(5).alias("lo"), F.lit(6).alias("hi")))
    ends = messages_.groupBy("session_id").agg(F.max("ordinal").alias("last"))
    return ends.select("session_id", "last", F.explode(spans).alias("b")).where("b.hi <= last").select(
        "session_id", F.col("b.id").alias("block_id"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), F.concat(F.lit("topic "), F.col("b.id")).alias("topic"),
        F.concat(F.lit("Summary of section "), F.col("b.id"), F.lit(".")).alias("summary"), F.lit(True).alias("active"), F.lit(None).cast("double").alias("created_at"),
    )


def agent_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """events as an agent's transcript, two rows each, and its calls.

    A signup is a user row and a custom message. All others are a call and its result; of some errors the
    result has another call id. Columns: session_id, ordinal, role, content, ts, source_key, call ids in
    calls, tool_call_id, tool_name and is_error of results; calls: session_id, ordinal, tool_call_id,
    tool_name, arguments.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k, none = F.col("event_id") % 97, F.lit(None).cast("string")
    path, shell = F.concat(F.lit("f"), (k % 7).cast("string")), ("git commit -m x", "cd a && git commit", "npm test", "bun run build", "  npx  tsc", "GIT COMMIT")
    lines = lambda n: F.repeat(F.lit("x\n"), n.cast("int"))
    edits = F.array(F.struct(lines(k % 3).alias("oldText"), lines(k % 5).alias("newText")), F.struct(F.lit("a").alias("oldText"), F.lit("").alias("newText")))
    arguments = (
        F.when(F.col("event_type") == "view", F.to_json(F.struct(path.alias("path"), F.when(k % 3 != 0, k).alias("offset"), (k % 4).alias("limit"))))
        .when(F.col("event_type") == "click", F.to_json(F.struct(F.element_at(F.array(*map(F.lit, shell)), (k % 6 + 1).cast("int")).alias("command"))))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(path.alias("path"), edits.alias("edits"))))
        .otherwise(F.to_json(F.struct(F.when(k % 2 == 1, path).alias("path"), F.concat(F.lit("p"), k.cast("string")).alias("pattern"))))
    )
    tool = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "bash").when(F.col("event_type") == "purchase", "edit").otherwise("grep")
    call = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    lost = (F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)
    e = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), (F.row_number().over(order) - 1).alias("i"), (F.col("event_type") == "signup").alias("user"), tool.alias("tool"), call.alias("call"), lost.alias("lost"), arguments.alias("arguments"), "props", (F.col("event_type") == "error").alias("failed")
    )
    one = F.struct((2 * F.col("i")).alias("ordinal"), F.when(F.col("user"), "user").otherwise("assistant").alias("role"), F.when(F.col("user"), F.col("props")).alias("content"), F.when(~F.col("user"), F.array("call")).otherwise(F.array().cast("array<string>")).alias("calls"), none.alias("tool_call_id"), none.alias("tool_name"), F.lit(None).cast("boolean").alias("is_error"))
    other = F.struct((2 * F.col("i") + 1).alias("ordinal"), F.when(F.col("user"), "custom_message").otherwise("toolResult").alias("role"), F.col("props").alias("content"), F.array().cast("array<string>").alias("calls"), F.when(~F.col("user"), F.when(F.col("lost"), F.concat(F.lit("x"), "call")).otherwise(F.col("call"))).alias("tool_call_id"), none.alias("tool_name"), F.when(~F.col("user"), F.col("failed")).alias("is_error"))
    rows = e.select("session_id", F.explode(F.array(one, other)).alias("r")).select("session_id", "r.*").withColumns({"ts": (F.col("ordinal") * 10).cast("double"), "source_key": F.concat(F.lit("s"), F.col("ordinal").cast("string"))})
    calls = e.where("not user").select("session_id", (2 * F.col("i")).alias("ordinal"), F.col("call").alias("tool_call_id"), F.col("tool").alias("tool_name"), "arguments")
    return rows, calls
