"""Persisted state: serialising, classifying, restoring, shrinking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.branches import NATIVE_SOURCE

#: Kinds of activity-log rows that are restored; what marks an entry that holds a snapshot.
LOG_KINDS = ("user_excerpt", "assistant_excerpt", "read", "edit", "write", "command", "test", "commit", "tool")
STATE_TYPE = "dcp-state"


def material_key(v: Column) -> Column:
    """A snapshot without its own time of saving, its keys in order; one further inside counts."""
    return F.to_json(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: k != "savedAt"))


def material_text(json: Column) -> Column:
    """As ``material_key`` of JSON text, with the members in the order in which they stand: text that differs in
    order is not the same. One pass of the parser splits off the top members; what is inside is only copied."""
    texts, values = F.from_json(json, "map<string,string>"), F.from_json(json, "map<string,variant>")
    kinds = F.transform(F.map_values(values), lambda x: F.schema_of_variant(x).isin("STRING"))
    rows = F.zip_with(F.map_entries(texts), kinds, lambda e, is_text: F.struct(e["key"].alias("k"), e["value"].alias("v"), is_text.alias("t")))
    return F.to_json(F.filter(rows, lambda r: r["k"] != "savedAt"), {"ignoreNullFields": "false"})


def schema_kind(v: Column) -> Column:
    """restored-v5, restored-v1, reset-legacy-v4, scalar-v3 or unchanged; scalar-legacy for all the rest."""
    version = F.try_variant_get(v, "$.schemaVersion", "int")
    has = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY"), F.lit(False))
    blocks, old = has("$.blocks"), has("$.compressionBlocks")
    return (
        F.when(F.try_variant_get(v, "$.unchanged", "boolean"), "unchanged")
        .when((version == 5) & blocks, "restored-v5")
        .when((version.isNull() | (version == 1)) & old, "restored-v1")
        .when(version == 4, "reset-legacy-v4")
        .when(version == 3, "scalar-v3")
        .otherwise("scalar-legacy")
    )


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Each session's last snapshot that isn't a marker, with its kind. ``snapshots``: session_id, pos, v."""
    kinds = snapshots.withColumn("kind", schema_kind(F.col("v"))).where("kind <> 'unchanged'")
    return kinds.groupBy("session_id").agg(F.max("pos").alias("pos"), F.max_by("kind", "pos").alias("kind"), F.max_by(F.to_json("v"), "pos").alias("snapshot"))


#: Names under which a block's columns are persisted, and those of its coverage.
BLOCK_KEYS = {
    "block_id": "id", "topic": "topic", "summary": "summary", "start_ts": "startTimestamp", "end_ts": "endTimestamp", "anchor_ts": "anchorTimestamp", "start_source_key": "startSourceKey", "end_source_key": "endSourceKey", "anchor_source_key": "anchorSourceKey",
    "active": "active", "summary_tokens": "summaryTokenEstimate", "saved_tokens": "savedTokenEstimate", "created_at": "createdAt", "compress_call_id": "compressCallId", "activity_log": "activityLog",
}
METADATA_KEYS = {
    "covered_source_keys": "coveredSourceKeys", "covered_span_keys": "coveredSpanKeys", "covered_artifact_refs": "coveredArtifactRefs", "covered_tool_ids": "coveredToolIds", "superseded_block_ids": "supersededBlockIds",
    "file_reads": "fileReadStats", "file_writes": "fileWriteStats", "commands": "commandStats",
}
STAT_KEYS = {"line_spans": "lineSpans", "edit_count": "editCount", "added_lines": "addedLines", "removed_lines": "removedLines"}
KEPT_WHEN_INACTIVE = ("block_id", "topic", "summary", "start_ts", "end_ts", "anchor_ts", "active", "summary_tokens", "saved_tokens", "created_at")


def _whole(c: Column) -> Column:
    """A number as JSON writes it: integral ones without a fraction."""
    return F.when(c == F.floor(c), F.parse_json(F.floor(c).cast("string"))).otherwise(F.parse_json(c.cast("string")))


def persisted_block(blocks: DataFrame) -> Column:
    """A block of ``restored_blocks`` (or with some of its columns) as it is persisted: its own key names, times that
    aren't finite set to 0 and a missing anchor to one after the end, inactive ones slimmed."""
    kinds = dict(blocks.dtypes)
    finite = lambda c: F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), c.cast("double"))

    def value(name: str) -> Column:
        c = F.col(name)
        if name in ("start_ts", "end_ts", "anchor_ts"):
            # an inactive block's times stay; JSON has null for those that aren't finite
            end = finite(F.col("end_ts")) if "end_ts" in kinds else F.lit(None).cast("double")
            rest = F.coalesce(finite(c), end + 1, F.lit(0.0)) if name == "anchor_ts" else F.coalesce(finite(c), F.lit(0.0))
            return _whole(F.when(F.col("active"), rest).otherwise(finite(c)))
        if kinds[name] == "double":
            return _whole(c)
        if kinds[name].startswith("array<struct"):
            return renamed(c, name)
        return F.when(F.col("active"), c).otherwise("") if name in ("topic", "summary") else c

    def renamed(c: Column, name: str) -> Column:
        """The statistics of a block under their persisted names."""
        if not kinds[name].startswith("array<struct"):
            return c
        fields = [(f.name, f.dataType.simpleString()) for f in blocks.schema[name].dataType.elementType.fields]
        return F.transform(c, lambda x: F.struct(*((_whole(x[f]) if kind == "double" else x[f]).alias(STAT_KEYS.get(f, f)) for f, kind in fields)))

    def covered(name: str) -> Column:
        none = F.array().cast(kinds[name])
        kept = F.coalesce(F.col(name), none)
        return renamed(kept if name == "superseded_block_ids" else F.when(F.col("active"), kept).otherwise(none), name)

    own = [(F.when(F.col("active"), value(c)) if c not in KEPT_WHEN_INACTIVE else value(c)).alias(key) for c, key in BLOCK_KEYS.items() if c in kinds]
    metadata = [covered(c).alias(key) for c, key in METADATA_KEYS.items() if c in kinds]
    return F.struct(*own, *([F.struct(*metadata).alias("metadata")] if metadata else []))


def serialized(state: DataFrame, blocks: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """(session_id or ``by``, schema_version, payload): version 5 with blocks, 3 without any, as ``restored`` reads them.
    ``state``: session_id, saved_at, current_turn, last_nudge_turn, last_compress_turn, pruned_tool_ids,
    lifetime_saved, next_block_id; ``blocks``: columns of ``restored_blocks``. Blocks stand in order of
    place, if they have one, else of id."""
    place = F.col("place" if "place" in blocks.columns else "block_id").alias("_at")
    rows = blocks.select(*by, F.struct(place, F.to_json(persisted_block(blocks)).alias("_b")).alias("_b"))
    held = rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("_b")), lambda x: x["_b"]).alias("blocks"))
    out = state.join(held, list(by), "left")
    head = F.to_json(F.struct(
        F.when(F.col("blocks").isNull(), 3).otherwise(5).alias("schemaVersion"), F.col("saved_at").alias("savedAt"), F.col("current_turn").alias("currentTurn"), F.col("last_nudge_turn").alias("lastNudgeTurn"), F.col("last_compress_turn").alias("lastCompressTurn"),
        F.col("pruned_tool_ids").alias("prunedToolIds"), F.col("lifetime_saved").alias("lifetimeTokensSavedRealized"),
    ))
    whole = F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"blocks":['), F.concat_ws(",", "blocks"), F.lit('],"nextBlockId":'), F.col("next_block_id").cast("string"), F.lit("}"))
    return out.select(*by, F.when(F.col("blocks").isNull(), 3).otherwise(5).alias("schema_version"), F.when(F.col("blocks").isNull(), head).otherwise(whole).alias("payload"))


def collapsed(snapshots: DataFrame) -> DataFrame:
    """Snapshots equal to the one before them in their chain become markers. ``snapshots``: session_id,
    chain, pos, v. Adds payload and is_marker."""
    key = material_key(F.col("v"))
    before = F.lag("_key").over(Window.partitionBy("session_id", "chain").orderBy("pos"))
    rows = snapshots.withColumn("_key", key).withColumn("is_marker", F.coalesce(F.col("_key") == before, F.lit(False)))
    marker = F.to_json(F.struct(F.try_variant_get("v", "$.schemaVersion", "int").alias("schemaVersion"), F.lit(True).alias("unchanged")))
    return rows.withColumn("payload", F.when(F.col("is_marker"), marker).otherwise(F.to_json("v"))).drop("_key")


def shrink_report(collapsed_: DataFrame) -> DataFrame:
    """Lines, markers and bytes before and after for each session."""
    return collapsed_.groupBy("session_id").agg(F.count("*").alias("snapshots"), F.count_if("is_marker").alias("markers"), F.sum(F.octet_length(F.to_json("v"))).alias("bytes_before"), F.sum(F.octet_length("payload")).alias("bytes_after"))


def corpus_summary(lines: DataFrame) -> DataFrame:
    """Counts, bytes and the share saved by a vacuum, of each session, of each folder and of all, in one pass:
    (level, folder, session_id, n_sessions, n_lines, n_snapshots, n_changed, n_markers, bytes_before, bytes_after,
    saved_percent). ``lines``: folder, session_id, raw, new_raw, is_snapshot, is_marker. Percentages have two
    places."""
    changed = F.count_if(~F.col("raw").eqNullSafe(F.col("new_raw")))
    one = lines.groupBy("folder", "session_id").agg(
        F.count("*").alias("n_lines"), F.count_if("is_snapshot").alias("n_snapshots"), changed.alias("n_changed"), F.count_if("is_marker").alias("n_markers"), F.sum(F.octet_length("raw") + 1).alias("bytes_before"), F.sum(F.octet_length("new_raw") + 1).alias("bytes_after"),
    )
    sums = [F.sum(c).alias(c) for c in ("n_lines", "n_snapshots", "n_changed", "n_markers", "bytes_before", "bytes_after")]
    out = one.rollup("folder", "session_id").agg(F.grouping_id().alias("_g"), F.count("*").alias("n_sessions"), *sums)
    level = F.when(F.col("_g") == 0, "session").when(F.col("_g") == 1, "folder").otherwise("corpus")
    share = F.round((F.col("bytes_before") - F.col("bytes_after")).cast("decimal(20,0)") * 100 / F.col("bytes_before"), 2)
    return out.withColumns({"level": level, "saved_percent": share.cast("double")}).drop("_g")


def serialized_v1(state: DataFrame, blocks: DataFrame) -> DataFrame:
    """(session_id, payload): the first format, with all blocks in compressionBlocks. ``state`` as for
    ``serialized``, with tokens_saved and total_prunes."""
    place = F.col("place" if "place" in blocks.columns else "block_id").alias("_at")
    rows = blocks.select("session_id", F.struct(place, F.to_json(persisted_block(blocks)).alias("_b")).alias("_b"))
    held = rows.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list("_b")), lambda x: x["_b"]).alias("blocks"))
    out = state.join(held, "session_id", "left")
    tail = F.to_json(F.struct(
        F.col("next_block_id").alias("nextBlockId"), F.col("pruned_tool_ids").alias("prunedToolIds"), F.col("tokens_saved").alias("tokensSaved"), F.col("lifetime_saved").alias("lifetimeTokensSavedRealized"), F.col("total_prunes").alias("totalPruneCount"),
        F.col("current_turn").alias("currentTurn"), F.col("last_nudge_turn").alias("lastNudgeTurn"), F.col("last_compress_turn").alias("lastCompressTurn"),
    ))
    listed = F.concat_ws(",", F.coalesce("blocks", F.array().cast("array<string>")))
    return out.select("session_id", F.concat(F.lit('{"schemaVersion":1,"compressionBlocks":['), listed, F.lit("],"), tail.substr(F.lit(2), F.length(tail))).alias("payload"))


def marked_by_ancestor(snapshots: DataFrame, nearest: DataFrame) -> DataFrame:
    """Snapshots equal, but for their time, to that of their nearest ancestor become markers. ``nearest``:
    (session_id, id, ancestor) of ``branches.nearest_marked``; ``snapshots``: session_id, id, pos, v, and
    text, by which they are compared if it is given, so that the order of keys counts."""
    keyed = snapshots.withColumn("_key", material_text(F.col("text")) if "text" in snapshots.columns else material_key(F.col("v")))
    above = nearest.join(keyed.select("session_id", F.col("id").alias("ancestor"), F.col("_key").alias("_above")), ["session_id", "ancestor"]).select("session_id", "id", "_above")
    rows = keyed.join(above, ["session_id", "id"], "left").withColumn("is_marker", F.coalesce(F.col("_key") == F.col("_above"), F.lit(False)))
    marker = F.to_json(F.struct(F.try_variant_get("v", "$.schemaVersion", "int").alias("schemaVersion"), F.lit(True).alias("unchanged")))
    return rows.withColumn("payload", F.when(F.col("is_marker"), marker).otherwise(F.to_json("v"))).drop("_key", "_above")


def repaired(blocks: DataFrame, branch_native: DataFrame, all_native: DataFrame, history: DataFrame) -> DataFrame:
    """Blocks that a compaction outside the branch switched off, as they last were on the branch.

    ``blocks``, ``history``: session_id, block_id, active and more, history also pos of the snapshot on
    the branch; ``branch_native``, ``all_native``: session_id, block_id of compacted blocks. Adds repaired.
    """
    key = ["session_id", "block_id"]
    off = all_native.select(*key).distinct().join(branch_native.select(*key), key, "left_anti")
    wanted = blocks.where("not active").join(off, key, "left_semi").select(*key)
    held = [c for c in blocks.columns if c not in key]
    last = history.where("active").join(wanted, key, "left_semi").groupBy(*key).agg(F.max_by(F.struct(*held), "pos").alias("_old"))
    out = blocks.join(last, key, "left")
    return out.select(*key, *(F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c) for c in held), F.col("_old").isNotNull().alias("repaired"))


def watermarks(state: DataFrame, native: DataFrame) -> DataFrame:
    """Turns of the last reminder and summary, set back to -1 in sessions whose branch has a compaction made
    of blocks. ``native``: session_id."""
    out = state.join(native.select("session_id").distinct().withColumn("_n", F.lit(True)), "session_id", "left")
    stale = F.col("_n").isNotNull() & ((F.col("last_compress_turn") > 0) | (F.col("last_nudge_turn") > 0))
    return out.withColumns({c: F.when(stale, -1).otherwise(F.col(c)) for c in ("last_compress_turn", "last_nudge_turn")}).drop("_n")


def restored_scalars(snapshots: DataFrame) -> DataFrame:
    """What a session's last snapshot restores to besides its blocks, a row each: kind, schema_version,
    next_block_id, tokens_saved, n_blocks, pruned_tool_ids, lifetime_saved, current_turn, last_nudge_turn,
    last_compress_turn.

    Only version 5 and the first format have blocks to resume with; of all others scalars alone are taken, with
    no tokens saved and 1 as the next id. The next id is the one given, else one more than the largest; tokens
    saved are those given in the first format, of active blocks in the fifth. Values of a wrong type or
    missing take the defaults of an empty state: 0, and turns of -1.
    """
    last = latest_snapshot(snapshots).withColumn("v", F.parse_json("snapshot"))
    own = restored_blocks(snapshots).groupBy("session_id").agg(F.max("block_id").alias("_top"), F.sum(F.when(F.col("active"), F.col("saved_tokens")).otherwise(0.0)).alias("_saved"), F.count("*").cast("int").alias("n_blocks"))
    number = lambda key, default: F.coalesce(_typed(F.col("v"), f"$.{key}", "double"), F.lit(float(default)))
    saved = F.when(F.col("kind") == "restored-v5", F.coalesce("_saved", F.lit(0.0))).when(F.col("kind") == "restored-v1", number("tokensSaved", 0)).otherwise(0.0)
    given = F.when(F.col("kind").isin("restored-v5", "restored-v1"), _typed(F.col("v"), "$.nextBlockId", "double"))
    version = F.coalesce(_typed(F.col("v"), "$.schemaVersion", "double"), F.when(F.col("kind") == "restored-v1", 1.0))
    turns = {"current_turn": number("currentTurn", 0), "last_nudge_turn": number("lastNudgeTurn", -1), "last_compress_turn": number("lastCompressTurn", -1)}
    return last.join(own, "session_id", "left").select(
        "session_id", "kind", version.cast("int").alias("schema_version"), F.coalesce(given.cast("long"), F.greatest("_top", F.lit(0)) + 1, F.lit(1)).alias("next_block_id"), saved.cast("long").alias("tokens_saved"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
        F.array_distinct(_values(F.col("v"), "$.prunedToolIds", "string")).alias("pruned_tool_ids"), number("lifetimeTokensSavedRealized", 0).cast("long").alias("lifetime_saved"), *(c.cast("long").alias(name) for name, c in turns.items()),
    )


def native_block_ids(entries: DataFrame) -> DataFrame:
    """(session_id, block_id) of blocks that compactions took over. ``entries``: session_id, type, v."""
    native = (F.col("type") == "compaction") & (F.try_variant_get("v", "$.details.source", "string") == NATIVE_SOURCE)
    ids = F.explode(_values(F.col("v"), "$.details.representedBlockIds", "double"))
    return entries.where(native).select("session_id", ids.alias("block_id")).select("session_id", F.col("block_id").cast("long").alias("block_id")).distinct()


def restored(branch: DataFrame, all_entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state that a session resumes with, and its blocks: (session_id, outcome, ..., repaired_block_ids,
    repaired_turns) and the columns of ``restored_blocks`` with repaired.

    ``branch``: the entries of each session's branch, ``all_entries``: those of all its branches, both as
    ``sources.jsonl.entries``. The last snapshot on the branch decides. Blocks that a compaction outside the
    branch switched off come back as they last were on the branch, and tokens saved are added up anew; a
    branch with a compaction of its own starts its reminders afresh. A session without snapshot is empty.
    """
    snapshots = snapshots_of(branch).select("session_id", "pos", "v")
    blocks, mine = restored_blocks(snapshots).drop("kind"), native_block_ids(branch)
    fixed = repaired(blocks, mine, native_block_ids(all_entries), single_blocks(snapshots).drop("kind"))
    back = fixed.groupBy("session_id").agg(F.array_sort(F.collect_list(F.when(F.col("repaired"), F.col("block_id")))).alias("repaired_block_ids"), F.sum(F.when(F.col("active"), F.col("saved_tokens")).otherwise(0.0)).cast("long").alias("_saved"))
    state = branch.select("session_id").distinct().join(restored_scalars(snapshots), "session_id", "left").join(back, "session_id", "left")
    none = {"next_block_id": 1, "tokens_saved": 0, "n_blocks": 0, "lifetime_saved": 0, "current_turn": 0, "last_nudge_turn": -1, "last_compress_turn": -1}
    state = state.withColumns({c: F.coalesce(c, F.lit(x)) for c, x in none.items()}).withColumns({
        "outcome": F.coalesce("kind", F.lit("empty")), "pruned_tool_ids": F.coalesce("pruned_tool_ids", F.array().cast("array<string>")), "repaired_block_ids": F.coalesce("repaired_block_ids", F.array().cast("array<bigint>")),
    })
    state = state.withColumn("tokens_saved", F.when(F.size("repaired_block_ids") > 0, F.col("_saved")).otherwise(F.col("tokens_saved"))).drop("kind", "_saved")
    turned = watermarks(state.withColumn("_before", F.struct("last_nudge_turn", "last_compress_turn")), mine)
    return turned.withColumn("repaired_turns", F.col("_before") != F.struct("last_nudge_turn", "last_compress_turn")).drop("_before"), fixed


def _typed(v: Column, path: str, kind: str) -> Column:
    """The value at a path if it has that type already; nothing is converted from text."""
    pattern = {"double": "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)", "string": "^STRING$", "boolean": "^BOOLEAN$"}[kind]
    found = F.try_variant_get(v, path, kind)
    fits = F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike(pattern)
    return F.when(fits & ~F.isnan(found) & (F.abs(found) < float("inf")) if kind == "double" else fits, found)


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _values(v: Column, path: str, kind: str) -> Column:
    """The values of that type in the list at a path."""
    return F.filter(F.transform(_items(v, path), lambda x: _typed(x, "$", kind)), lambda x: x.isNotNull())


def _rows(v: Column, path: str, need: str, **fields: tuple[str, str, object]) -> Column:
    """Structs of the list at a path that have text under ``need``; other fields: (key, type, default)."""
    kept = F.filter(_items(v, path), lambda x: _typed(x, f"$.{need}", "string").isNotNull())
    return F.transform(kept, lambda x: F.struct(_typed(x, f"$.{need}", "string").alias(need), *(F.coalesce(_typed(x, f"$.{key}", kind), F.lit(default)).alias(name) for name, (key, kind, default) in fields.items())))


def restored_blocks(snapshots: DataFrame) -> DataFrame:
    """Blocks that a session's last snapshot restores to, a row each, with ``kind`` of the snapshot. A last
    snapshot of version 4 has lost its blocks' coverage: a session resumes without any."""
    last = latest_snapshot(snapshots).where("kind in ('restored-v5', 'restored-v1')")
    return _blocks_of(last.withColumn("v", F.parse_json("snapshot")).drop("snapshot", "pos"))


def single_blocks(snapshots: DataFrame) -> DataFrame:
    """Blocks of every snapshot read for itself, with its ``pos``, as repairs and shrinking need them; here those
    of version 4 count, too. ``snapshots``: session_id, pos, v."""
    return _blocks_of(snapshots.withColumn("kind", schema_kind(F.col("v"))).where("kind <> 'unchanged'").select("session_id", "pos", "kind", "v"))


def _blocks_of(last: DataFrame) -> DataFrame:
    """Blocks of snapshots (session_id, kind, v and more).

    Version 5 and the first format need id, topic, summary and both times, version 4 only the first three
    and has no times, coverage or log; others have no blocks. Malformed blocks are dropped, malformed rows
    of their lists too; values of a wrong type take the default: active true, estimates 0, created_at null,
    anchor and missing times infinite.
    """
    inf = F.lit(float("inf"))
    more = [c for c in last.columns if c not in ("session_id", "kind", "v")]
    listed = F.when(F.col("kind") == "restored-v1", _items(F.col("v"), "$.compressionBlocks")).when(F.col("kind").isin("restored-v5", "reset-legacy-v4"), _items(F.col("v"), "$.blocks"))
    rows = last.withColumn("whole", F.col("kind") != "reset-legacy-v4").select("session_id", *more, "kind", "whole", F.posexplode(listed).alias("place", "b"))
    b, whole = F.col("b"), F.col("whole")
    own = {c: F.when(whole, _typed(b, f"$.{key}", "double")) for c, key in (("start_ts", "startTimestamp"), ("end_ts", "endTimestamp"))}
    valid = _typed(b, "$.id", "double").isNotNull() & _typed(b, "$.topic", "string").isNotNull() & _typed(b, "$.summary", "string").isNotNull() & (~whole | (own["start_ts"].isNotNull() & own["end_ts"].isNotNull()))
    log = F.filter(_rows(b, "$.activityLog", "text", kind=("kind", "string", "")), lambda x: x["kind"].isin(*LOG_KINDS))
    covered = {c: F.when(whole, _values(b, f"$.metadata.{key}", "string")).otherwise(F.array().cast("array<string>")) for c, key in (("covered_source_keys", "coveredSourceKeys"), ("covered_span_keys", "coveredSpanKeys"), ("covered_artifact_refs", "coveredArtifactRefs"), ("covered_tool_ids", "coveredToolIds"))}
    status = F.transform(_rows(b, "$.metadata.commandStats", "command", status=("status", "string", "other")), lambda x: F.struct(x["command"].alias("command"), F.when(x["status"].isin("ok", "error"), x["status"]).otherwise("other").alias("status")))
    reads = F.transform(F.filter(_items(b, "$.metadata.fileReadStats"), lambda x: _typed(x, "$.path", "string").isNotNull()), lambda x: F.struct(_typed(x, "$.path", "string").alias("path"), F.coalesce(_typed(x, "$.count", "double"), F.lit(0.0)).alias("count"), _values(x, "$.lineSpans", "string").alias("line_spans")))
    writes = _rows(b, "$.metadata.fileWriteStats", "path", edit_count=("editCount", "double", 0.0), added_lines=("addedLines", "double", 0.0), removed_lines=("removedLines", "double", 0.0))
    return rows.where(valid).select(
        "session_id", *more, "kind", "place", _typed(b, "$.id", "double").cast("long").alias("block_id"), _typed(b, "$.topic", "string").alias("topic"), _typed(b, "$.summary", "string").alias("summary"), F.coalesce(_typed(b, "$.active", "boolean"), F.lit(True)).alias("active"),
        *(F.coalesce(x, inf).alias(c) for c, x in own.items()), F.coalesce(F.when(whole, _typed(b, "$.anchorTimestamp", "double")), inf).alias("anchor_ts"),
        *(F.when(whole, _typed(b, f"$.{key}", "string")).alias(c) for c, key in (("start_source_key", "startSourceKey"), ("end_source_key", "endSourceKey"), ("anchor_source_key", "anchorSourceKey"))),
        F.coalesce(_typed(b, "$.savedTokenEstimate", "double"), F.lit(0.0)).alias("saved_tokens"), F.coalesce(_typed(b, "$.summaryTokenEstimate", "double"), F.lit(0.0)).alias("summary_tokens"), _typed(b, "$.createdAt", "double").alias("created_at"), _typed(b, "$.compressCallId", "string").alias("compress_call_id"),
        F.transform(F.when(whole, _values(b, "$.metadata.supersededBlockIds", "double")).otherwise(_values(b, "$.supersededBlockIds", "double")), lambda x: x.cast("long")).alias("superseded_block_ids"),
        *(x.alias(c) for c, x in covered.items()), *(F.when(whole, x).alias(c) for c, x in (("activity_log", log), ("file_reads", reads), ("file_writes", writes), ("commands", status))),
    )


def rewritten(snapshots: DataFrame, saved_at: Column | None = None) -> DataFrame:
    """(session_id, pos, schema_version, payload): every snapshot read for itself and persisted anew, in version
    5 if it has blocks, else in version 3. What isn't valid and what inactive blocks no longer need is gone.
    Markers are left out. ``saved_at``: the new time of saving, by default the old one."""
    rows = snapshots.withColumn("kind", schema_kind(F.col("v"))).where("kind <> 'unchanged'")
    number = lambda key, default=None: F.coalesce(_typed(F.col("v"), f"$.{key}", "double").cast("long"), F.lit(default))
    blocks = single_blocks(snapshots).drop("kind")
    top = blocks.groupBy("session_id", "pos").agg(F.max("block_id").alias("_top"))
    state = rows.join(top, ["session_id", "pos"], "left").select(
        "session_id", "pos", (number("savedAt") if saved_at is None else saved_at).alias("saved_at"), number("currentTurn", 0).alias("current_turn"), number("lastNudgeTurn", -1).alias("last_nudge_turn"), number("lastCompressTurn", -1).alias("last_compress_turn"),
        F.array_distinct(_values(F.col("v"), "$.prunedToolIds", "string")).alias("pruned_tool_ids"), number("lifetimeTokensSavedRealized", 0).alias("lifetime_saved"), F.coalesce(number("nextBlockId"), F.greatest("_top", F.lit(0)) + 1, F.lit(1)).alias("next_block_id"),
    )
    return serialized(state, blocks, ("session_id", "pos"))


def with_member(raw: Column, name: str, payload: Column) -> Column:
    """JSON text with the member ``name`` replaced; the others keep their order and what is inside them."""
    values = F.from_json(raw, "map<string,variant>")
    texts = F.map_entries(F.from_json(raw, "map<string,string>"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    own = F.transform(F.map_values(values), lambda x: F.to_json(x))
    is_text = F.transform(F.map_values(values), lambda x: F.schema_of_variant(x).isin("STRING", "VOID"))
    parts = F.zip_with(texts, F.arrays_zip(own.alias("own"), is_text.alias("is_text")), lambda e, o: F.concat(quoted(e["key"]), F.lit(":"), F.when(e["key"] == name, payload).when(o["is_text"] | e["value"].isNull(), F.coalesce(o["own"], F.lit("null"))).otherwise(e["value"])))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def vacuumed(entries: DataFrame, nearest: DataFrame, *, markers: bool = True, saved_at: Column | None = None) -> DataFrame:
    """Lines of session logs with their snapshots shrunk: (session_id, pos, raw, is_marker).

    A snapshot is persisted anew (``rewritten``); one that then equals, but for its time, that of its nearest
    ancestor (``nearest`` of ``branches.nearest_marked``) gets a marker in its place, unless ``markers`` is
    false. Markers that are there and all other lines stay byte for byte. ``entries``: those of
    ``sources.jsonl.entries``.
    """
    held = snapshots_of(entries)
    fresh = held.select("session_id", "id", "pos").join(rewritten(held.select("session_id", "pos", "v"), saved_at), ["session_id", "pos"])
    named = fresh.select("session_id", "id", "pos", F.parse_json("payload").alias("v"), F.col("payload").alias("text"))
    marked = marked_by_ancestor(named.where("id is not null"), nearest).where("is_marker").select("session_id", "pos", F.col("payload").alias("_marker")) if markers else None
    out = entries.select("session_id", "pos", "raw").join(fresh.select("session_id", "pos", "payload"), ["session_id", "pos"], "left")
    out = out.join(marked, ["session_id", "pos"], "left") if markers else out.withColumn("_marker", F.lit(None).cast("string"))
    data = F.coalesce("_marker", "payload")
    return out.select("session_id", "pos", F.when(data.isNotNull(), with_member(F.col("raw"), "data", data)).otherwise(F.col("raw")).alias("raw"), F.col("_marker").isNotNull().alias("is_marker"))


def snapshots_of(entries: DataFrame) -> DataFrame:
    """(session_id, id, parent_id, pos, v) of entries that hold a snapshot."""
    held = entries.where((F.col("type") == "custom") & (F.col("custom_type") == STATE_TYPE))
    return held.select("session_id", "id", "parent_id", "pos", F.try_variant_get("v", "$.data", "variant").alias("v"))
