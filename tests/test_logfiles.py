"""The data source of session files, and saving states from a stream."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from threadloom.operators import branches, persistence, replay
from threadloom.sources import logfiles
from threadloom.streaming import sessions, snapshots

FILES = {
    "one.jsonl": b'{"id":"a","type":"message"}\n\n  \r\nnot json\n{"id":"b", "parentId":"a"}\n',
    "deep/er/two.jsonl": '{"id":"é漢😀"}\r\n{"id":"y"}'.encode(),
    "odd.jsonl": b'\xff\xfe broken \x00 bytes\n{"id":"z"}\n\n\n',
    "empty.jsonl": b"",
    "long.jsonl": b"\n".join(b'{"id":"%d","x":"%s"}' % (k, b"x" * (k % 97)) for k in range(3000)) + b"\n",
}


@pytest.fixture
def folder(spark, tmp_path):
    logfiles.use_session_logs(spark)
    for name, data in FILES.items():
        (tmp_path / "logs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "logs" / name).write_bytes(data)
    (tmp_path / "logs" / "other.txt").write_bytes(b"no log\n")
    return str(tmp_path / "logs")


def bytes_below(path):
    found = {}
    for at, _, names in os.walk(path):
        for n in names:
            with open(f"{at}/{n}", "rb") as f:
                found[os.path.relpath(f"{at}/{n}", path)] = f.read()
    return found


def lines_of(data):
    own, at = [], 0
    parts = data.split(b"\n")
    for k, line in enumerate(parts):
        if k + 1 < len(parts) or line:
            own.append((at, line, k + 1 < len(parts)))
        at += len(line) + 1
    return own


@pytest.mark.parametrize("size", [1 << 20, 1000, 7, 1])
def test_lines_of_splits(spark, folder, size):
    names = [n for n in FILES if size > 100 or n != "long.jsonl"]
    want = {(n, *line) for n in names for line in lines_of(FILES[n])}
    if size <= 7:  # the same code without a task for every split
        ranges = {n: (0, len(FILES[n])) for n in names}
        got = [(s.name, *line) for s in logfiles._splits(ranges, size) for line in logfiles._lines(folder, s)]
    else:
        got = [(r.session_id, r.pos, bytes(r.raw), r.ended) for r in spark.read.format(logfiles.NAME).option("splitBytes", size).load(folder).collect()]
    assert len(got) == len(want) and set(got) == want


def test_round_trip_is_equal_byte_for_byte(spark, folder, tmp_path):
    lines = spark.read.format(logfiles.NAME).load(folder)
    logfiles.laid_out(lines).write.format(logfiles.NAME).mode("overwrite").save(str(tmp_path / "copy"))
    assert bytes_below(tmp_path / "copy") == {n: d for n, d in FILES.items() if d}
    got = logfiles.log_entries(lines).where("session_id = 'one.jsonl'").orderBy("pos").collect()
    assert [(r.id, r.parent_id) for r in got] == [("a", None), ("b", "a")]


def test_overwriting_keeps_the_first_version(spark, folder):
    before = bytes_below(folder)
    for text in (b"first", b"second"):
        lines = spark.read.format(logfiles.NAME).load(folder).where("session_id = 'one.jsonl'").withColumn("raw", F.lit(bytearray(text)))
        logfiles.laid_out(lines).write.format(logfiles.NAME).mode("overwrite").save(folder)
    after = bytes_below(folder)
    assert after.pop("one.jsonl") == b"second\n" * 5 and after.pop("one.jsonl.bak") == before.pop("one.jsonl")
    assert after == before


def test_a_failed_job_leaves_the_old_files(spark, folder):
    before = bytes_below(folder)
    lines = spark.read.format(logfiles.NAME).load(folder)
    for bad, name in ((lines, "validate"), (lines.repartition(3), "one task a session")):
        with pytest.raises(Exception, match="(?s)JSON|Expecting|several tasks|codec"):
            (logfiles.laid_out(bad) if name == "validate" else bad).write.format(logfiles.NAME).option("validate", str(name == "validate")).mode("overwrite").save(folder)
        assert bytes_below(folder) == before


def test_what_is_appended_comes_as_a_stream(spark, folder, tmp_path):
    out, got = str(tmp_path / "check"), []

    def run():
        stream = spark.readStream.format(logfiles.NAME).load(folder)
        stream.writeStream.foreachBatch(lambda b, _: got.extend((r.session_id, r.pos, bytes(r.raw)) for r in b.collect())).option("checkpointLocation", out).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()

    run()
    begun = {(n, pos, line) for n, data in FILES.items() for pos, line, ended in lines_of(data) if ended}
    assert set(got) == begun and len(got) == len(begun)
    got.clear()
    with open(f"{folder}/deep/er/two.jsonl", "ab") as f:
        f.write(b'\n{"id":"new"}\nhalf')
    with open(f"{folder}/fresh.jsonl", "wb") as f:
        f.write(b"one\n")
    run()
    two = len(FILES["deep/er/two.jsonl"])
    assert sorted(got) == [("deep/er/two.jsonl", two - 10, b'{"id":"y"}'), ("deep/er/two.jsonl", two + 1, b'{"id":"new"}'), ("fresh.jsonl", 0, b"one")]


def test_vacuum_in_place(spark, tmp_path):
    """Snapshots are shrunk in their files; every other byte stays."""
    logfiles.use_session_logs(spark)
    state = '{"type":"custom","customType":"dcp-state","id":"%s","parentId":%s,"data":{"schemaVersion":3,"savedAt":%d,"currentTurn":4,"lastNudgeTurn":-1,"lastCompressTurn":-1,"prunedToolIds":[],"lifetimeTokensSavedRealized":0}}'
    own = [state % ("a", "null", 1), '{"id":"m",  "parentId":"a", "type":"message"}', "not json", state % ("b", '"m"', 2), ""]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "s.jsonl").write_bytes("\n".join(own).encode())
    lines = spark.read.format(logfiles.NAME).load(str(tmp_path / "l"))
    rows = logfiles.log_entries(lines)
    near = branches.nearest_marked(rows.select("session_id", "id", "parent_id", "pos"), persistence.snapshots_of(rows))
    logfiles.laid_out(logfiles.with_lines(lines, persistence.vacuumed(rows, near))).write.format(logfiles.NAME).mode("overwrite").save(str(tmp_path / "l"))
    marker = '{"type":"custom","customType":"dcp-state","id":"b","parentId":"m","data":{"schemaVersion":3,"unchanged":true}}'
    assert bytes_below(tmp_path / "l") == {"s.jsonl": "\n".join([*own[:3], marker, ""]).encode(), "s.jsonl.bak": "\n".join(own).encode()}


def message(role, text, **more):
    return json.dumps({"role": role, "tokens": len(text) // 4, "call": None, "is_error": False, **more})


def test_states_are_saved_once(spark, tmp_path):
    compress = {"id": "k", "name": "compress", "print": "p", "arguments": json.dumps({"topic": "t", "ranges": [{"startId": "m0001", "endId": "m0001", "summary": "s"}]})}
    rows = [
        ("s", 0, message("user", "x" * 400)), ("t", 0, message("user", "y")),
        ("s", 1, message("assistant", "", calls=[compress])), ("s", 2, message("toolResult", "done", call="k")), ("t", 1, message("assistant", "z")),
        ("s", 3, message("user", "more")),
    ]
    df = spark.createDataFrame(rows, "session_id string, pos long, event string")
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    sink = snapshots.snapshot_sink(folder)
    seen = []

    def twice(batch, number):
        batch.persist()
        sink(batch, number)
        stamp = {f: os.path.getmtime(f"{folder}/batch={number}/{f}") for f in os.listdir(f"{folder}/batch={number}")}
        sink(batch, number)  # as after a failure
        assert stamp == {f: os.path.getmtime(f"{folder}/batch={number}/{f}") for f in os.listdir(f"{folder}/batch={number}")}
        seen.append((number, sorted((r.session_id, r.pending_save) for r in batch.collect())))

    for cut in ("pos = 0", "pos in (1, 2)", "pos = 3"):
        df.where(cut).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        sessions.replay_stream(stream).writeStream.outputMode("update").foreachBatch(twice).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [s for _, s in seen] == [[("s", False), ("t", False)], [("s", True), ("t", False)], [("s", False)]]
    got = snapshots.saved(spark, folder).collect()
    assert [(r.session_id, r.type, r.custom_type) for r in got] == [("s", "custom", "dcp-state")]
    given = json.loads(got[0].data)
    assert [(b["id"], b["topic"], b["summary"], b["active"], b["savedTokenEstimate"], b["compressCallId"]) for b in given.pop("blocks")] == [(1, "t", "s", True, 100, "k")]
    assert {k: v for k, v in given.items() if k != "savedAt"} == {"schemaVersion": 5, "nextBlockId": 2, "currentTurn": 2, "lastNudgeTurn": 2, "lastCompressTurn": 2, "prunedToolIds": [], "lifetimeTokensSavedRealized": 0}
    # half a batch, without its mark, is written anew
    part = next(f"{folder}/{d}" for d in os.listdir(folder) if d.startswith("batch=") and os.listdir(f"{folder}/{d}") and any(f.startswith("part") for f in os.listdir(f"{folder}/{d}")))
    state = replay.replay(df)
    number = int(part.split("=")[1])
    os.remove(f"{part}/_SUCCESS")
    sink(state.where("session_id = 's'").withColumn("pending_save", F.lit(True)), number)  # the state of a batch job will do
    assert os.path.exists(f"{part}/_SUCCESS") and snapshots.saved(spark, folder).count() == 1
