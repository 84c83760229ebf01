"""Whether two ways to a state lead to the same one: replay against restore, before against after a vacuum.

A state's observables are a set of rows (field, value): active blocks and pruned results one each, numbers one.
Both sides are first reduced to an order-free digest for each key (how many rows, two independent sums of their
hashes), which is all that is joined for keys that agree; only where digests differ are the rows compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators import branches, persistence, replay
from threadloom.operators.persistence import STATE_TYPE

FIELDS = ("activeBlockIds", "nextBlockId", "tokensSaved", "prunedToolIds")


def observables(state: DataFrame, active: Column, key: str = "session_id") -> DataFrame:
    """(key, field, value) of states with next_block_id, tokens_saved and pruned_tool_ids; ``active``: ids of
    active blocks."""
    text = lambda c: F.col(c).cast("long").cast("string")

    def named(field: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))

    parts = F.flatten(F.array(*map(named, FIELDS, (F.transform(active, lambda i: i.cast("string")), F.array(text("next_block_id")), F.array(text("tokens_saved")), F.col("pruned_tool_ids")))))
    return state.select(key, F.explode(parts).alias("o")).select(key, "o.*")


def digests(rows: DataFrame, key: str) -> DataFrame:
    """(key, _n, _a, _b): a digest of a key's rows that doesn't depend on their order, but on how often each is there."""
    own = sorted(c for c in rows.columns if c != key)
    one = F.xxhash64(*own)
    other = F.xxhash64(F.lit("other"), *reversed(own))
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    return rows.groupBy(key).agg(F.count("*").alias("_n"), total(one).alias("_a"), total(other).alias("_b"))


def mismatches(one: DataFrame, other: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, field, one, other): fields whose values differ, sorted, null where a side has none. ``one`` and
    ``other``: (key, field, value)."""
    a, b = digests(one, key), digests(other, key)
    same = a.join(b.select(key, *(F.col(c).alias(f"{c}2") for c in ("_n", "_a", "_b"))), key).where("_n = _n2 and _a = _a2 and _b = _b2").select(key)
    side = lambda rows, name: rows.join(same, key, "left_anti").groupBy(key, "field").agg(F.array_sort(F.collect_list("value")).alias(name))
    both = side(one, "one").join(side(other, "other"), [key, "field"], "full")
    return both.where(~F.col("one").eqNullSafe(F.col("other")))


def contracts(entries: DataFrame) -> DataFrame:
    """(session_id, contract): v3 if any snapshot of the session is of version 3 or 5, else legacy."""
    held = (F.col("type") == "custom") & (F.col("custom_type") == STATE_TYPE)
    version = F.try_variant_get("v", "$.data.schemaVersion", "int")
    return entries.groupBy("session_id").agg(F.when(F.bool_or(F.coalesce(held & version.isin(3, 5), F.lit(False))), "v3").otherwise("legacy").alias("contract"))


def on_branches(entries: DataFrame) -> DataFrame:
    """Entries of every branch: ``entries`` with branch_id, and session_id naming session and branch by a struct's
    JSON. Sessions without ids are one branch in order of place."""
    nodes = entries.select("session_id", "id", "parent_id", "pos")
    with_ids = nodes.groupBy("session_id").agg(F.bool_or(F.col("id").isNotNull()).alias("_named"))
    paths = branches.branch_entries(nodes.where("id is not null")).select("session_id", "branch_id", "id", "depth")
    own = entries.join(paths, ["session_id", "id"]).withColumn("pos", F.col("depth")).drop("depth")
    flat = entries.join(with_ids.where("not _named").select("session_id"), "session_id", "left_semi").withColumn("branch_id", F.lit(None).cast("string"))
    every = own.unionByName(flat)
    return every.withColumns({"of": F.col("session_id"), "session_id": F.to_json(F.struct("session_id", "branch_id"), {"ignoreNullFields": "false"})})


def replay_check(entries: DataFrame, rules: replay.Rules = replay.Rules()) -> tuple[DataFrame, DataFrame]:
    """What replay gives against what is restored from it once persisted, for each branch of each session:
    (session_id, branch_id, contract, status) with status equivalent, mismatch or skip (not replayable), and the
    differing fields (session_id, branch_id, field, replayed, restored)."""
    rows = on_branches(entries).checkpoint()
    names = rows.select("session_id", "of", "branch_id").distinct()
    kind = rows.select(
        F.col("session_id"), F.lit(None).cast("string").alias("branch_id"), "type", F.try_variant_get("v", "$.message.role", "string").alias("role"), F.try_variant_get("v", "$.message.toolName", "string").alias("tool_name"), F.try_variant_get("v", "$.message.isError", "boolean").alias("is_error"),
        F.try_variant_get("v", "$.details.source", "string").alias("compaction_source"), F.try_variant_get("v", "$.details.representedBlockIds", "array<variant>").alias("represented"),
    )
    able = branches.replayable(kind).where("replayable").select("session_id")
    states = replay.replay(replay.entry_events(rows.join(able, "session_id", "left_semi")), rules).checkpoint()
    blocks = states.select("session_id", F.explode("blocks").alias("b")).select("session_id", "b.*")
    persisted = states.select("session_id", F.lit(0).alias("saved_at"), F.col("turns").alias("current_turn"), "last_nudge_turn", "last_compress_turn", "pruned_tool_ids", F.col("lifetime_saved").cast("long").alias("lifetime_saved"), "next_block_id")
    back = persistence.serialized(persisted, blocks).select("session_id", F.lit(1).cast("long").alias("pos"), F.parse_json("payload").alias("v"))
    restored = persistence.restored_scalars(back).join(persistence.restored_blocks(back).where("active").groupBy("session_id").agg(F.array_sort(F.collect_list("block_id")).alias("_active")), "session_id", "left")
    found = mismatches(observables(states, F.col("active_blocks")), observables(restored, F.coalesce("_active", F.array().cast("array<bigint>")))).checkpoint()
    wrong = found.select("session_id").distinct().withColumn("_wrong", F.lit(True))
    status = F.when(F.col("_able").isNull(), "skip").when(F.col("_wrong"), "mismatch").otherwise("equivalent")
    outcome = names.join(able.withColumn("_able", F.lit(True)), "session_id", "left").join(wrong, "session_id", "left")
    outcome = outcome.select(F.col("of").alias("session_id"), "branch_id", status.alias("status")).join(contracts(entries), "session_id")
    fields = found.join(names, "session_id").select(F.col("of").alias("session_id"), "branch_id", "field", F.col("one").alias("replayed"), F.col("other").alias("restored"))
    return outcome, fields


def restore_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """(session_id, field, one, other): what sessions restore to differently from ``before`` and ``after``, each
    the entries of one branch a session, as a vacuum must not change it."""

    def seen(entries: DataFrame) -> DataFrame:
        state, blocks = persistence.restored(entries, entries)
        active = blocks.where("active").groupBy("session_id").agg(F.array_sort(F.collect_list("block_id")).alias("_active"))
        return observables(state.join(active, "session_id", "left"), F.coalesce("_active", F.array().cast("array<bigint>")))

    return mismatches(seen(before), seen(after))
