"""Reports on captured requests: sizes by component, and token usage merged from event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def component_report(parts: DataFrame) -> DataFrame:
    """(capture_id, component, chars, tokens, percent) from parts (capture_id, component, json)."""
    sized = parts.groupBy("capture_id", "component").agg(F.sum(F.char_length("json")).alias("chars"))
    total = F.sum("chars").over(Window.partitionBy("capture_id"))
    return sized.select("capture_id", "component", "chars", F.floor(F.col("chars") / 4 + 0.5).cast("long").alias("tokens"), F.round(F.try_divide(100 * F.col("chars"), total), 1).alias("percent"))


def merged_usage(events: DataFrame) -> DataFrame:
    """Token usage of each capture. Of a field-wise provider the last value given of each field counts,
    of others the last object as a whole. ``events``: capture_id, seq, provider, input_tokens,
    output_tokens, cache_read_tokens, cache_write_tokens."""
    fields = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
    any_ = F.coalesce(*(F.col(f) for f in fields)).isNotNull()
    each = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_each_{f}") for f in fields]
    whole = F.max_by(F.struct(*fields), F.when(any_, F.col("seq"))).alias("_whole")
    out = events.groupBy("capture_id").agg(F.max("provider").alias("provider"), whole, *each)
    return out.select("capture_id", "provider", *(F.when(F.col("provider") == "anthropic", F.col(f"_each_{f}")).otherwise(F.col(f"_whole.{f}")).alias(f) for f in fields))
