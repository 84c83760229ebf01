"""Outbound payloads: items whose owner is no longer live are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.refs import last_block_owner, last_message_ref
from threadloom.functions.text import is_metadata_only, normalize_inline

#: Fixed value: how a summary of compacted history begins.
SUMMARY_PREFIX = "The conversation history before this point was compacted into the following summary:"
#: What stands for the arguments and the output of a compress call whose blocks are shown.
RECEIPT_NOTE = "Original compress arguments are represented by the created block(s). Previous visible message ids may now be stale."
RECEIPT_TEXT = "Compression succeeded. Created {0}.\nThis compact receipt is kept so you know your compress call just succeeded; the compressed content is represented by the live block(s).\nDo not call compress again in this assistant turn. If more compression is needed, wait for refreshed visible boundaries."
MESSAGE_ROLES = ("user", "assistant", "system", "developer")


def is_message(role: Column, type_: Column) -> Column:
    return role.isNotNull() & F.coalesce((type_ == "message") | type_.isNull(), F.lit(True))


def direct_owners(items: DataFrame, refs: DataFrame) -> DataFrame:
    """Add owner of message rows: the one stamped on assistants, else the last block tag in the text,
    else the row that the last reference tag names; else that of a following row of the same role which
    holds nothing but tags."""
    text = normalize_inline(F.col("text"))
    rows = items.withColumns({"_block": last_block_owner(text), "_ref": last_message_ref(text)})
    rows = rows.join(refs.select("session_id", F.lower("ref").alias("_ref"), F.col("owner").alias("_by_ref")), ["session_id", "_ref"], "left")
    stamped = F.when(F.col("role") == "assistant", F.col("internal_owner"))
    rows = rows.withColumn("_own", F.when(is_message(F.col("role"), F.col("type")), F.coalesce(stamped, "_block", "_by_ref")))
    w = Window.partitionBy("session_id").orderBy("idx")
    borrowed = F.when((F.lead("role").over(w) == F.col("role")) & F.lead(is_metadata_only(F.col("text"))).over(w), F.lead("_own").over(w))
    own = F.when(is_message(F.col("role"), F.col("type")), F.coalesce("_own", borrowed))
    return rows.withColumn("owner", own).drop("_block", "_ref", "_by_ref", "_own")


def with_assistants(rows: DataFrame) -> DataFrame:
    """Add the owners of the assistant before and after each row, not looking past a user row."""
    before = Window.partitionBy("session_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_seg", F.coalesce(F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(before), F.lit(0)))
    seg = Window.partitionBy("session_id", "_seg").orderBy("idx")
    own = F.when(F.col("role") == "assistant", F.col("owner"))
    previous = F.last(own, True).over(seg.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first(own, True).over(seg.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumns({"previous_owner": previous, "next_owner": following}).drop("_seg")


def receipts(blocks: DataFrame, live: DataFrame) -> DataFrame:
    """(session_id, call_id, is_newest, created, arguments) of calls whose blocks are live, also by the part of the
    call id before a bar: the created blocks as text, and the call's arguments that stand for its own."""
    own = blocks.where("active and compress_call_id is not null").withColumn("owner", F.concat(F.lit("block:b"), F.col("block_id").cast("string")))
    own = own.join(live, ["session_id", "owner"], "left_semi")
    name = F.when(F.trim(F.coalesce("topic", F.lit(""))) != "", F.col("topic")).otherwise("untitled")
    entry = F.struct("block_id", F.concat(F.lit("b"), F.col("block_id").cast("string")).alias("id"), name.alias("topic"))
    calls = own.groupBy("session_id", "compress_call_id").agg(F.max("block_id").alias("newest"), F.sort_array(F.collect_list(entry)).alias("_b"))
    calls = calls.withColumn("is_newest", F.col("newest") == F.max("newest").over(Window.partitionBy("session_id")))
    created = F.array_join(F.transform("_b", lambda e: F.concat(e["id"], F.lit(": "), e["topic"])), ", ")
    made = F.struct(F.lit(True).alias("receiptOnly"), F.lit("succeeded").alias("status"), F.transform("_b", lambda e: F.struct(e["id"].alias("id"), e["topic"].alias("topic"))).alias("createdBlocks"), F.lit(RECEIPT_NOTE).alias("note"))
    calls = calls.withColumns({"created": created, "arguments": F.to_json(made)})
    alias = F.array_distinct(F.array("compress_call_id", F.when(F.instr("compress_call_id", "|") > 1, F.substring_index("compress_call_id", "|", 1)).otherwise(F.col("compress_call_id"))))
    each = calls.select("session_id", F.explode(alias).alias("call_id"), F.struct("newest", "is_newest", "created", "arguments").alias("r"))
    return each.groupBy("session_id", "call_id").agg(F.max("r").alias("r")).select("session_id", "call_id", "r.is_newest", "r.created", "r.arguments")


def filtered(items: DataFrame, live: DataFrame, refs: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Items that stay, with owner. A session without live owners passes unchanged.

    ``items``: session_id, idx, role, type, name, call_id, text, internal_owner; ``live``: session_id,
    owner; ``refs``: session_id, ref, owner; ``blocks``: session_id, block_id, active, topic,
    compress_call_id. Of represented compress calls only the newest stays; ``receipt`` is then what stands for the
    arguments of the call and for its output.
    """
    rows = with_assistants(direct_owners(items, refs))
    deciding = F.when(is_message(F.col("role"), F.col("type")), F.col("owner")).when(F.col("type") == "reasoning", F.coalesce("next_owner", "previous_owner")).when(F.col("type").isin("function_call", "function_call_output"), F.coalesce("previous_owner", "next_owner"))
    rows = rows.withColumn("deciding", deciding)
    rows = rows.join(live.select("session_id", F.col("owner").alias("deciding")).distinct().withColumn("_live", F.lit(True)), ["session_id", "deciding"], "left")
    rows = rows.join(live.select("session_id").distinct().withColumn("_any", F.lit(True)), "session_id", "left")
    summary = is_message(F.col("role"), F.col("type")) & (F.col("role") == "user") & F.coalesce(F.col("text").startswith(SUMMARY_PREFIX), F.lit(False))
    stays = F.col("_any").isNull() | summary | F.col("deciding").isNull() | F.col("_live").isNotNull()
    receipt = F.lit(None).cast("string")
    if blocks is not None:
        rows = rows.join(receipts(blocks, live), ["session_id", "call_id"], "left")
        mine = F.col("created").isNotNull() & ((F.col("type") == "function_call_output") | ((F.col("type") == "function_call") & (F.col("name") == "compress")))
        stays = F.when(F.coalesce(mine, F.lit(False)), F.col("is_newest")).otherwise(stays)
        before, after = RECEIPT_TEXT.split("{0}")
        text = F.when(F.col("type") == "function_call", F.col("arguments")).otherwise(F.concat(F.lit(before), F.col("created"), F.lit(after)))
        receipt = F.when(mine & F.col("is_newest"), text)
    return rows.withColumn("receipt", receipt).where(stays).drop("_live", "_any", "created", "is_newest", "arguments")
