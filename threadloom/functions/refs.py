"""References to messages (m0001) and blocks (b1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_ref(index: Column) -> Column:
    """m and four digits at least; more where the number needs them."""
    digits = index.cast("string")
    return F.concat(F.lit("m"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def legacy_ref(index: Column) -> Column:
    """Three digits, for the numbers 1 to 999."""
    return F.when(index.between(1, 999), F.concat(F.lit("m"), F.lpad(index.cast("string"), 3, "0")))


def parse_message_ref(s: Column) -> Column:
    found = F.regexp_extract(F.lower(F.trim(s)), r"^m(\d{3,})$", 1)
    return F.when(found != "", found.cast("long"))


def parse_block_ref(s: Column) -> Column:
    found = F.regexp_extract(F.lower(F.trim(s)), r"^b(\d+)$", 1)
    return F.when(found != "", found.cast("long"))


def last_block_owner(text: Column) -> Column:
    tags = F.regexp_extract_all(text, F.lit(r"(?i)<dcp-block-id>(b\d+)</dcp-block-id>"), F.lit(1))
    return F.when(F.size(tags) > 0, F.concat(F.lit("block:"), F.lower(F.element_at(tags, -1))))


def last_message_ref(text: Column) -> Column:
    tags = F.regexp_extract_all(text, F.lit(r"(?i)<dcp-id>(m\d{3,4})</dcp-id>"), F.lit(1))
    return F.when(F.size(tags) > 0, F.lower(F.element_at(tags, -1)))


def ref_tag(ref: Column) -> Column:
    return F.concat(F.lit("<dcp-id>"), ref, F.lit("</dcp-id>"))


def with_ref(role: Column, text: Column, ref: Column) -> Column:
    """A message's text followed by its tag: after a blank line for users, on the next line for others."""
    gap = F.when(role == "user", F.lit("\n\n")).otherwise(F.lit("\n"))
    return F.when(ref.isNull(), text).otherwise(F.concat(text, gap, ref_tag(ref)))


def expand_placeholders(text: Column, summaries: Column) -> Column:
    """(bN) replaced by the stored summary of block N from array<struct<id, topic, summary>>, once;
    unknown ones stay. The text is cut at its placeholders, so there are as many pieces as these and one more."""
    pieces, tags = F.split(text, r"\(b\d+\)", -1), F.regexp_extract_all(text, F.lit(r"(\(b\d+\))"), F.lit(1))

    def shown(tag: Column) -> Column:
        body = F.get(F.filter(summaries, lambda s: tag == F.concat(F.lit("(b"), s["id"].cast("string"), F.lit(")"))), F.lit(0))
        return F.when(body.isNotNull(), F.concat(F.lit("[Previously compressed: "), body["topic"], F.lit("]\n"), body["summary"])).otherwise(tag)

    return F.array_join(F.zip_with(pieces, tags, lambda p, t: F.concat(p, F.when(t.isNotNull(), shown(t)).otherwise(""))), "")
