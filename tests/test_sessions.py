"""Session logs from their files: reading, replaying, restoring, shrinking, and the streams of them."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import branches, persistence, replay, transcript
from threadloom.sources import jsonl
from threadloom.streaming import sessions

TEXT = "x" * 400  # 100 tokens


def message(role, content, **more):
    return {"type": "message", "message": {"role": role, "content": content, **more}}


def call(i, name="read", **arguments):
    return message("assistant", [{"type": "toolCall", "id": i, "name": name, "arguments": arguments}])


def result(i, text, name="read", **more):
    return message("toolResult", [{"type": "text", "text": text}], toolCallId=i, toolName=name, **more)


def ranges(*given):
    return {"topic": "t", "ranges": [{"startId": a, "endId": b, "summary": s} for a, b, s in given]}


def snapshot(saved_at, turn):
    return {"type": "custom", "customType": "dcp-state", "data": {"schemaVersion": 3, "savedAt": saved_at, "currentTurn": turn}}


ENTRIES = [
    message("user", TEXT), call("a"), result("a", TEXT), message("user", TEXT), snapshot(1, 4),  # refs m0001, m0002 (the result), m0003
    call("k1", "compress", **ranges(("m0001", "m0002", "s" * 40))), result("k1", "done", "compress"),  # rows 0 to 2
    snapshot(2, 4), message("user", TEXT),
    call("k2", "compress", **ranges(("m0002", "m0003", "no"))), result("k2", "done", "compress"),  # starts inside the block: none
    call("k3", "compress", **ranges(("b1", "m0003", "s" * 80))), result("k3", "failed", "compress", isError=True),
    call("k4", "compress", **ranges(("b1", "m0003", "s" * 80))), result("k4", "done", "compress"),  # rows 0 to 3, block 1 superseded
    snapshot(3, 9), {"type": "compaction", "summary": "all", "details": {"source": "dcp-native-compaction", "representedBlockIds": [2]}},
    message("user", TEXT), call("k5", "compress", **ranges(("m0009", "m0010", "s"), ("m0099", "m0099", "s"))), result("k5", "done", "compress"),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    lines = [json.dumps({"id": f"e{i}", "parentId": f"e{i - 1}" if i else None, "timestamp": i, **e}) for i, e in enumerate(ENTRIES)]
    (path / "one.jsonl").write_text("\n".join([*lines[:3], "not json", "", *lines[3:]]) + "\n")
    (path / "two.jsonl").write_text(json.dumps(message("user", "hi")) + "\n")
    (path / "other.txt").write_text("no log")
    return str(path)


def test_reading(spark, folder):
    rows = jsonl.read_sessions(spark, folder)
    assert sorted(r["count"] for r in rows.groupBy("session_id").count().collect()) == [1, len(ENTRIES)]
    one = jsonl.as_messages(rows.where("session_id like '%one.jsonl'")).orderBy("pos").collect()
    assert [r.role for r in one][:4] == ["user", "assistant", "toolResult", "user"] and [r.role for r in one].count("compaction") == 1
    assert [r.pos for r in one] == [i + 2 * (i >= 3) for i, e in enumerate(ENTRIES) if e["type"] != "custom"]  # places count the lines left out
    assert one[0].content == TEXT and one[0].parts == [] and one[2].tool_call_id == "a"
    assert one[2].content is None and [(p.type, p.text) for p in one[2].parts] == [("text", TEXT)]
    assert [(p.type, p.id, p.name) for p in one[1].parts] == [("toolCall", "a", "read")] and json.loads(one[1].parts[0].arguments) == {}
    assert [[(p.type, p.text) for p in r.parts] for r in one if r.role == "compaction"] == [[("text", "all")]]


def states(df):
    return {r.session_id.split("/")[-1]: r for r in df.collect()}


def test_replay_of_entries(spark, folder):
    events = replay.entry_events(jsonl.read_sessions(spark, folder))
    got = states(replay.replay(events))
    one, two = got["one.jsonl"], got["two.jsonl"]
    assert (two.n_messages, two.turns, two.active_blocks, two.last_compress_turn) == (1, 1, [], -1)
    assert one.n_messages == len(ENTRIES) - 3 and one.n_tool_calls == 6
    # users 4, exchanges 6, the compaction none
    assert one.turns == 10
    # block 1: 200 rows' tokens less 10; block 2: 300 less 20, realized; block 3: the rows of m0009 and m0010
    # (block 1 was shown at the second pass and took m0004, before the rows that were new then; block 2 never was)
    assert one.active_blocks == [3] and one.next_block_id == 4 and one.lifetime_saved == 280.0
    # its rows: the exchange of k4 with the compaction after it, 0 + 1 + 1, and the user's 100; the summary 0
    assert one.tokens_saved == 102.0
    assert one.last_compress_turn == one.last_nudge_turn == 10  # the calling row is a turn before its result comes
    assert one.pruned_tool_ids == ["k3"]  # failed more than four turns ago


def replayed(spark, entries, **rules):
    return replay.replay(replay.entry_events(entries_of(spark, {"s": entries})), replay.Rules(**rules)).first()


def test_replay_prunes_and_names_blocks(spark):
    reads = [e for k in range(6) for e in (call(f"r{k}", path="f" if k % 2 else f"g{k}"), result(f"r{k}", TEXT))]
    failed = [call("bad", "edit", path="x"), result("bad", "no", "edit", isError=True), call("bad2", "edit", path="x"), result("bad2", "no", "edit", isError=True)]
    compress = lambda i, *given: [call(i, "compress", **ranges(*given)), result(i, "done", "compress")]
    # all calls are dated by the last pass, at turn 0; r1 and r3 are repeated by r5, edits never count as repeated
    got = replayed(spark, [message("user", TEXT), *reads, *failed])
    assert got.turns == 9 and got.pruned_tool_ids == ["bad", "bad2", "r1", "r3"]
    assert replayed(spark, [message("user", TEXT), *reads, *failed], dedup=False).pruned_tool_ids == ["bad", "bad2"]
    assert replayed(spark, [message("user", TEXT), *reads, *failed], purge=False, cadence=20).pruned_tool_ids == []
    # what is covered is shown no more: with r5 in a block r3 is the last one; what a pass has pruned stays so
    got = replayed(spark, [message("user", TEXT), *reads, *compress("k", ("m0007", "m0007", "s"))])
    assert got.active_blocks == [1] and got.pruned_tool_ids == ["r1", "r3"]
    # a block's own row has a reference: m0003 after m0001 and m0002, shown before the new rows; a range from it begins at the block
    own = [message("user", TEXT), message("user", TEXT), *compress("k1", ("m0001", "m0001", "s")), message("user", TEXT)]
    got = replayed(spark, [*own, *compress("k2", ("m0003", "m0005", "s"))])
    assert got.active_blocks == [2] and got.next_block_id == 3 and got.tokens_saved == 301.0  # three users' rows and the result of k1, less 0
    # a block at the end of all rows is named after the new ones
    late = [message("user", TEXT), *compress("k1", ("m0001", "m0001", "s")), message("user", TEXT)]
    assert replayed(spark, [*late, *compress("k2", ("m0004", "m0004", "s"))]).active_blocks == [2]
    assert replayed(spark, [*late, *compress("k2", ("m0003", "m0003", "s"))]).active_blocks == [1, 2]
    # compaction forgets the turns of block and reminder
    got = replayed(spark, [*own, taken(1)])
    assert (got.active_blocks, got.lifetime_saved, got.last_compress_turn, got.last_nudge_turn) == ([], 100.0, -1, -1)


def batches_of(spark, df, cuts, tmp_path, made, mode):
    """Run the stream that ``made`` builds over ``df``, which arrives in parts by ``cuts``."""
    out, source = [], str(tmp_path / "in")
    for cut in cuts:
        df.where(cut).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        made(stream).writeStream.outputMode(mode).foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return out


@pytest.mark.parametrize("cuts", [["ordinal < 100"], ["ordinal < 3", "ordinal = 3", "ordinal between 4 and 8", "ordinal between 9 and 99"]])
def test_spans_of_a_stream(spark, tmp_path, cuts):
    roles = {
        "a": [("user",), ("assistant", "c1", "c2"), ("custom_message",), ("toolResult", "c1"), ("compaction",), ("toolResult", "c2"), ("custom_message",), ("user",), ("assistant", "c3"), ("custom_message",), ("toolResult", "other"), ("assistant",), ("assistant", "c4"), ("toolResult", "c4")],
        "b": [("assistant", "x"), ("assistant", "x"), ("toolResult", "x"), ("toolResult", "y"), ("branch_summary",), ("assistant", "z"), ("custom_message",)],
    }
    rows = []
    for session, own in roles.items():
        for k, (role, *ids) in enumerate(own):
            rows.append((session, k, role, ids if role == "assistant" else [], ids[0] if ids and role != "assistant" else None, 1000 + k))
    rows.append(("clock", 99, "user", [], None, 100_000))  # time goes on: what is open is closed
    df = spark.createDataFrame(rows, "session_id string, ordinal long, role string, calls array<string>, tool_call_id string, at long").withColumn("event_time", F.timestamp_seconds("at")).drop("at")
    got = batches_of(spark, df, cuts, tmp_path, sessions.spans_stream, "append")
    want = transcript.spans(df.withColumns({"ts": F.lit(0.0), "source_key": F.col("ordinal").cast("string")})).select("session_id", "span_head", "lo", "hi", "n_rows", "kind", "is_turn").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and any(r.kind == "tool-exchange" for r in got)


def test_a_stream_replays_alike(spark, folder, tmp_path):
    events = replay.entry_events(jsonl.read_sessions(spark, folder)).select("session_id", F.col("pos").cast("long").alias("pos"), "event")
    want = states(replay.replay(events))
    source = str(tmp_path / "in")
    for at in ("pos < 7", "pos >= 7"):  # two batches in turn
        events.where(at).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(events.schema).json(source)
        query = sessions.replay_stream(stream).drop("pending_save").writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update(states(df))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        seen = globals().setdefault("seen", {})
        query.start().awaitTermination()
    assert seen == want


def test_streamed_files_are_read_alike(spark, folder, tmp_path):
    columns = ["pos", "raw", "id", "type"]
    query = jsonl.stream_sessions(spark, folder).select(*columns).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, jsonl.read_sessions(spark, folder).select(*columns).collect()))


def test_shrinking_leaves_other_lines_as_they_were(spark, folder, tmp_path):
    rows = jsonl.read_sessions(spark, folder).cache()
    nodes = rows.select("session_id", "id", "parent_id", "pos")
    out = persistence.vacuumed(rows, branches.nearest_marked(nodes, persistence.snapshots_of(rows))).cache()
    made = out.where("is_marker").collect()
    assert [r.raw for r in made] == ['{"id":"e7","parentId":"e6","timestamp":7,"type":"custom","customType":"dcp-state","data":{"schemaVersion":3,"unchanged":true}}']
    kept = out.join(rows.select("session_id", "pos", "custom_type", F.col("raw").alias("before")), ["session_id", "pos"])
    assert kept.count() == len(ENTRIES) + 1 and kept.where("custom_type is null and raw <> before").count() == 0
    fresh = json.loads(kept.where("custom_type is not null and not is_marker").orderBy("pos").first().raw)["data"]
    assert fresh == {"schemaVersion": 3, "savedAt": 1, "currentTurn": 4, "lastNudgeTurn": -1, "lastCompressTurn": -1, "prunedToolIds": [], "lifetimeTokensSavedRealized": 0}
    # what is restored is the same before and after
    again = jsonl.entries(out.select("session_id", "pos", "raw"))
    before, after = (persistence.restored(x, x)[0].orderBy("session_id").collect() for x in (rows, again))
    assert before == after and len(before) == 2
    jsonl.write_sessions(out, str(tmp_path / "new"))
    assert spark.read.text(str(tmp_path / "new")).count() == len(ENTRIES) + 1


BLOCK = {
    "id": 1, "topic": "a", "summary": "s", "startTimestamp": 10, "endTimestamp": 15.5, "anchorTimestamp": 16, "startSourceKey": "k1", "endSourceKey": "k2", "anchorSourceKey": "tail:k2", "active": True, "summaryTokenEstimate": 1, "savedTokenEstimate": 40, "createdAt": 99,
    "compressCallId": "c", "activityLog": [{"kind": "read", "text": "t"}], "metadata": {"coveredSourceKeys": ["k1", "k2"], "coveredSpanKeys": ["x"], "coveredArtifactRefs": [], "coveredToolIds": ["c1"], "supersededBlockIds": [7],
    "fileReadStats": [{"path": "f", "count": 3, "lineSpans": ["L1"]}], "fileWriteStats": [{"path": "g", "editCount": 1, "addedLines": 2, "removedLines": 0}], "commandStats": [{"command": "ls", "status": "ok"}]},
}


def entries_of(spark, sessions):
    rows = [(s, k, json.dumps({"id": f"{s}{k}", "parentId": f"{s}{k - 1}" if k else None, **e}, separators=(",", ":"))) for s, own in sessions.items() for k, e in enumerate(own)]
    return jsonl.entries(spark.createDataFrame(rows, "session_id string, pos long, raw string"))


def state_entry(**data):
    return {"type": "custom", "customType": "dcp-state", "data": data}


def taken(*ids):
    return {"type": "compaction", "summary": "x", "details": {"source": "dcp-native-compaction", "representedBlockIds": list(ids)}}


def test_restoring_whole_sessions(spark):
    off = {**BLOCK, "active": False, "topic": "", "summary": ""}
    two = {**BLOCK, "id": 2, "savedTokenEstimate": 5}
    turns = {"currentTurn": 9, "lastNudgeTurn": 8, "lastCompressTurn": 7, "prunedToolIds": ["c1"], "lifetimeTokensSavedRealized": 3}
    branch = {
        "none": [message("user", "hi")],
        "v5": [state_entry(schemaVersion=3, currentTurn=1), state_entry(schemaVersion=5, blocks=[BLOCK, two], nextBlockId=5, **turns), state_entry(unchanged=True, schemaVersion=5)],
        "repair": [state_entry(schemaVersion=5, blocks=[{**BLOCK, "topic": "old"}]), state_entry(schemaVersion=5, blocks=[BLOCK, two], **turns), state_entry(schemaVersion=5, blocks=[off, {**two, "active": False}], **turns)],
        "taken": [state_entry(schemaVersion=5, blocks=[off, two], **turns), taken(1)],
        "v4": [state_entry(schemaVersion=5, blocks=[BLOCK]), state_entry(schemaVersion=4, blocks=[BLOCK], **turns)],
        "v1": [state_entry(compressionBlocks=[BLOCK], tokensSaved=77, **turns)],
    }
    off_branch = {s: [*own, taken(1)] if s == "repair" else own for s, own in branch.items()}
    state, blocks = persistence.restored(entries_of(spark, branch), entries_of(spark, off_branch))
    got = {r.session_id: r for r in state.collect()}
    facts = {s: (r.outcome, r.next_block_id, r.tokens_saved, r.current_turn, r.last_nudge_turn, r.last_compress_turn, r.lifetime_saved, r.repaired_block_ids, r.repaired_turns) for s, r in got.items()}
    assert facts == {
        "none": ("empty", 1, 0, 0, -1, -1, 0, [], False), "v5": ("restored-v5", 5, 45, 9, 8, 7, 3, [], False), "repair": ("restored-v5", 3, 40, 9, 8, 7, 3, [1], False),
        "taken": ("restored-v5", 3, 5, 9, -1, -1, 3, [], True), "v4": ("reset-legacy-v4", 1, 0, 9, 8, 7, 3, [], False), "v1": ("restored-v1", 2, 77, 9, 8, 7, 3, [], False),
    }
    assert sorted((r.session_id, r.block_id, r.active, r.topic, r.repaired) for r in blocks.collect()) == [
        ("repair", 1, True, "a", True), ("repair", 2, False, "a", False), ("taken", 1, False, "", False), ("taken", 2, True, "a", False), ("v1", 1, True, "a", False), ("v5", 1, True, "a", False), ("v5", 2, True, "a", False)
    ]


def test_what_is_persisted_is_restored(spark):
    """Blocks go to their persisted names and come back alike, in both formats; inactive ones are slim."""
    odd = {**BLOCK, "id": 2, "anchorTimestamp": None, "active": True}
    slim = {**BLOCK, "id": 3, "active": False}
    df = entries_of(spark, {"s": [state_entry(schemaVersion=5, blocks=[BLOCK, odd, slim], nextBlockId=9, currentTurn=2, prunedToolIds=["c9", "c1"])], "t": [state_entry(schemaVersion=3, currentTurn=2)]})
    state, blocks = persistence.restored(df, df)
    state = state.withColumns({"saved_at": F.lit(5), "total_prunes": F.lit(2)})
    out = {r.session_id: r for r in persistence.serialized(state, blocks.drop("repaired")).collect()}
    assert json.loads(out["t"].payload) == {"schemaVersion": 3, "savedAt": 5, "currentTurn": 2, "lastNudgeTurn": -1, "lastCompressTurn": -1, "prunedToolIds": [], "lifetimeTokensSavedRealized": 0}
    given = json.loads(out["s"].payload)
    assert given["blocks"][0] == BLOCK and given["blocks"][1] == {**odd, "anchorTimestamp": 16.5} and given["nextBlockId"] == 9
    bare = {"coveredSourceKeys": [], "coveredSpanKeys": [], "coveredArtifactRefs": [], "coveredToolIds": [], "supersededBlockIds": [7], "fileReadStats": [], "fileWriteStats": [], "commandStats": []}
    assert given["blocks"][2] == {"id": 3, "topic": "", "summary": "", "startTimestamp": 10, "endTimestamp": 15.5, "anchorTimestamp": 16, "active": False, "summaryTokenEstimate": 1, "savedTokenEstimate": 40, "createdAt": 99, "metadata": bare}
    for made in (persistence.serialized(state, blocks.drop("repaired")), persistence.serialized_v1(state, blocks.drop("repaired"))):
        back = made.select("session_id", F.lit(1).cast("long").alias("pos"), F.parse_json("payload").alias("v"))
        once = persistence.restored_blocks(back)
        want = blocks.drop("repaired").withColumns({"anchor_ts": F.when(F.col("block_id") == 2, 16.5).otherwise(F.col("anchor_ts"))}).where("active")
        assert sorted(map(str, once.where("active").select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_shrinking_rewrites_snapshots(spark):
    """Old formats become version 5; a snapshot equal to its ancestor's, whatever their format and time, a marker."""
    old = state_entry(savedAt=1, compressionBlocks=[BLOCK], nextBlockId=2, messageAliases={"a": 1}, manualMode=True)
    new = state_entry(schemaVersion=5, savedAt=2, currentTurn=0, lastNudgeTurn=-1, lastCompressTurn=-1, prunedToolIds=[], lifetimeTokensSavedRealized=0, blocks=[BLOCK], nextBlockId=2)
    rows = entries_of(spark, {"s": [old, message("user", "a  b"), new, state_entry(unchanged=True, schemaVersion=5), state_entry(**{**new["data"], "nextBlockId": 3})]})
    nodes = rows.select("session_id", "id", "parent_id", "pos")
    near = branches.nearest_marked(nodes, persistence.snapshots_of(rows))
    out = {r.pos: (json.loads(r.raw).get("data"), r.is_marker) for r in persistence.vacuumed(rows, near).collect()}
    assert out[0] == ({**new["data"], "savedAt": 1}, False) and out[2] == ({"schemaVersion": 5, "unchanged": True}, True)
    assert out[3] == ({"unchanged": True, "schemaVersion": 5}, False) and out[4][0]["nextBlockId"] == 3 and not out[4][1]
    plain = {r.pos: r.is_marker for r in persistence.vacuumed(rows, near, markers=False).collect()}
    assert not any(plain.values())


def test_debug_lines_are_appended(spark, tmp_path):
    e = spark.sql("select timestamp'2026-01-01 10:00:00' as ts, 'start' as event, double('nan') as n")
    for _ in range(2):
        jsonl.write_debug(e, ["n"], str(tmp_path / "d"))
    assert [r.value for r in spark.read.text(str(tmp_path / "d")).collect()] == ['{"timestamp":"2026-01-01T10:00:00.000Z","event":"start","payload":{"n":"NaN"}}'] * 2


def test_bodies_that_do_not_decode_stay(spark):
    df = spark.createDataFrame([(bytearray(b"plain"), "gzip"), (bytearray(b"plain"), None), (None, "deflate")], "b binary, e string")
    assert [r[0] and bytes(r[0]) for r in df.select(jsonl.decoded(F.col("b"), F.col("e"))).collect()] == [b"plain", b"plain", None]


def test_replay_equals_what_is_restored_from_it(spark, folder):
    from threadloom.operators import equivalence

    rows = jsonl.read_sessions(spark, folder)
    forked = entries_of(spark, {"fork": [message("user", TEXT), message("user", TEXT), call("k", "compress", **ranges(("m0001", "m0001", "s"))), result("k", "done", "compress"), message("user", TEXT)], "legacy": [message("user", "x"), state_entry(schemaVersion=4)]})
    other = forked.where("session_id = 'fork' and pos = 4").withColumns({"pos": F.lit(5).cast("long"), "id": F.lit("side"), "parent_id": F.lit("fork1")})
    outcome, fields = equivalence.replay_check(rows.unionByName(forked).unionByName(other))
    got = {(r.session_id.split("/")[-1], r.branch_id): (r.contract, r.status) for r in outcome.collect()}
    assert got == {("one.jsonl", f"e{len(ENTRIES) - 1}"): ("v3", "equivalent"), ("two.jsonl", None): ("legacy", "skip"), ("fork", "fork4"): ("legacy", "equivalent"), ("fork", "side"): ("legacy", "skip"), ("legacy", "legacy1"): ("legacy", "skip")}
    assert fields.count() == 0


def test_mismatches_are_found(spark):
    from threadloom.operators import equivalence

    block = lambda i, **more: {**BLOCK, "id": i, **more}
    same = [state_entry(schemaVersion=5, blocks=[block(1), block(2)], prunedToolIds=["b", "a"])]
    before = {"same": same, "order": same, "one": same, "gone": same}
    after = {
        "same": same, "order": [state_entry(schemaVersion=5, blocks=[block(2), block(1)], prunedToolIds=["a", "b"])], "one": [state_entry(schemaVersion=5, blocks=[block(1), block(2, active=False)], prunedToolIds=["b", "a", "c"], nextBlockId=9)],
        "gone": [message("user", "x")],
    }
    found = equivalence.restore_check(entries_of(spark, before), entries_of(spark, after))
    got = {(r.session_id, r.field): (r.one, r.other) for r in found.collect()}
    assert {k: v for k, v in got.items() if k[0] == "one"} == {("one", "activeBlockIds"): (["1", "2"], ["1"]), ("one", "tokensSaved"): (["80"], ["40"]), ("one", "prunedToolIds"): (["a", "b"], ["a", "b", "c"]), ("one", "nextBlockId"): (["3"], ["9"])}
    assert {k for k in got if k[0] != "one"} == {("gone", f) for f in equivalence.FIELDS}
    assert got["gone", "prunedToolIds"] == (["a", "b"], None)
