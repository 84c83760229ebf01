"""Rules of the log operators on small varied input, against plain walks and loops."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import branches, payload, persistence, pruning, splicing

NODES = "session_id string, id string, parent_id string, pos long"


def walk(nodes, marked):
    """A log read from its start: parents and marks are known from their line on."""
    out = {}
    for session in {n[0] for n in nodes}:
        parent, marks = {}, set()
        for _, i, p, _ in sorted((n for n in nodes if n[0] == session), key=lambda n: n[3]):
            parent[i] = p
            seen, at = set(), p
            while at and at not in seen and at not in marks:
                seen.add(at)
                at = parent.get(at)
            if (session, i) in marked:
                if at in marks and at:
                    out[session, i] = at
                marks.add(i)
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_nearest_marked_against_a_walk(spark, seed):
    rng = random.Random(seed)
    nodes = []
    for s in range(12):
        n = rng.randint(1, 60)
        order = rng.sample(range(n), n) if s % 3 == 0 else list(range(n))  # in a third of the sessions parents may come later
        for k in range(n):
            back = [None, f"e{k - 1}", f"e{rng.randrange(n)}" if s % 2 else f"e{max(0, k - rng.randint(1, 9))}", "missing"]  # the third makes cycles, and loops of one
            nodes.append((f"s{s}", f"e{k}", rng.choices(back, [1, 12, 6, 1])[0] if k else rng.choice([None, f"e{n - 1}"]), order[k]))
    marked = {(s, i) for s, i, _, _ in nodes if rng.random() < 0.35}
    df, held = spark.createDataFrame(nodes, NODES), spark.createDataFrame(sorted(marked), "session_id string, id string")
    got = {(r.session_id, r.id): r.ancestor for r in branches.nearest_marked(df, held).collect()}
    assert got == walk(nodes, marked) and got


def test_nearest_marked_of_a_long_chain(spark):
    """Rows out are marked entries, whatever the depth; a closed walk has no row for each pair."""
    n = 50_000
    i = F.col("id")
    chain = spark.range(n).select(F.lit("s").alias("session_id"), i.cast("string").alias("id"), F.when(i > 0, (i - 1).cast("string")).alias("parent_id"), i.alias("pos"))
    out = branches.nearest_marked(chain, chain.where("pos % 1000 = 7").select("session_id", "id"))
    assert {(r.id, r.ancestor) for r in out.collect()} == {(str(k), str(k - 1000)) for k in range(1007, n, 1000)}


def test_ancestors_of_cycles_have_no_root(spark):
    nodes = [("s", "a", None, 0), ("s", "b", "a", 1), ("s", "x", "y", 2), ("s", "y", "x", 3), ("s", "z", "y", 4), ("t", "a", "a", 0)]
    got = {(r.session_id, r.id): (r.depth, r.root) for r in branches.ancestors(spark.createDataFrame(nodes, NODES)).collect()}
    assert got == {("s", "a"): (0, "a"), ("s", "b"): (1, "a"), **{("s", i): (None, None) for i in "xyz"}, ("t", "a"): (None, None)}


def test_material_text_keeps_order_and_what_is_inside(spark):
    given = ['{"a":1,"savedAt":5,"b":{"savedAt":1}}', '{"a":1,"b":{"savedAt":1},"savedAt":6}', '{"b":{"savedAt":1},"a":1}', '{"a":1,"b":{"savedAt":2}}', '{"a":"1","b":{"savedAt":1}}', '{"a":1,"b":{"savedAt":1},"c":null}', '{"a":1,"b":{"savedAt":1},"c":"null"}', '{"savedAt":1}', "{}"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, j string").orderBy("i")
    keys = [r[0] for r in df.select(persistence.material_text(F.col("j"))).collect()]
    assert keys[0] == keys[1] and keys[7] == keys[8] and len(set(keys)) == 7 and None not in keys
    by_value = [r[0] for r in df.select(persistence.material_key(F.parse_json("j"))).collect()]
    assert by_value[0] == by_value[1] == by_value[2] and len({by_value[k] for k in (0, 3, 4, 5, 6)}) == 5


def test_metadata_only(spark):
    yes = ["<dcp-id>m0001</dcp-id>", " \n<DCP-OWNER>s3</DCP-OWNER> <dcp-block-id>b12</dcp-block-id>\t", "<dcp-id>m123</dcp-id><dcp-id>m1234</dcp-id>"]
    no = ["", "  ", None, "<agent-summary></agent-summary>", "<dcp-id>whatever words</dcp-id>", "<dcp-id>m12345</dcp-id>", "<dcp-id>b1</dcp-id>", "<dcp-owner></dcp-owner>", "x<dcp-id>m0001</dcp-id>"]
    df = spark.createDataFrame([(t, t in yes) for t in yes + no], "t string, want boolean")
    assert all(r.got == r.want for r in df.select("want", text.is_metadata_only(F.col("t")).alias("got")).collect())


def test_owner_borrowed_from_a_row_of_tags(spark):
    """A message without owner takes that of the next row of its role if this holds nothing but tags."""
    rows = [(0, "user", "plain"), (1, "user", "<dcp-id>m0001</dcp-id>"), (2, "user", "plain"), (3, "user", "<dcp-id>words</dcp-id>"), (4, "user", "x"), (5, "assistant", "<dcp-block-id>b1</dcp-block-id>")]
    items = spark.createDataFrame([("s", i, r, "message", t, None) for i, r, t in rows], "session_id string, idx int, role string, type string, text string, internal_owner string")
    refs = spark.createDataFrame([("s", "m0001", "s9")], "session_id string, ref string, owner string")
    got = {r.idx: r.owner for r in payload.direct_owners(items, refs).collect()}
    assert got == {0: "s9", 1: "s9", 2: None, 3: None, 4: None, 5: "block:b1"}


def test_calls_without_id_are_stripped(spark):
    part = "array<struct<type:string,id:string>>"
    rows = [
        (0, "assistant", None, [("toolCall", "a"), ("toolCall", None), ("toolCall", "lost"), ("text", None)]), (1, "toolResult", "a", []), (2, "toolResult", None, []), (3, "bashExecution", "none", []),
        (4, "assistant", None, [("toolCall", None)]), (5, "assistant", None, None), (6, "user", None, [("toolCall", None)]),
    ]
    out = pruning.without_orphans(spark.createDataFrame([("s", *r) for r in rows], f"session_id string, ordinal int, role string, tool_call_id string, parts {part}"))
    got = {r.ordinal: None if r.parts is None else [tuple(p) for p in r.parts] for r in out.collect()}
    assert got == {0: [("toolCall", "a"), ("text", None)], 1: [], 2: [], 4: [], 5: None, 6: [("toolCall", None)]}


def test_versions_four_resume_without_blocks(spark):
    block = {"id": 1, "topic": "a", "summary": "s", "startTimestamp": 1, "endTimestamp": 2, "savedTokenEstimate": 50}
    rows = [("s", 1, {"schemaVersion": 5, "blocks": [block]}), ("s", 2, {"schemaVersion": 4, "blocks": [block], "nextBlockId": 9}), ("t", 1, {"schemaVersion": 4, "blocks": [block]}), ("t", 2, {"unchanged": True}), ("u", 1, {"schemaVersion": 5, "blocks": [block]})]
    df = spark.createDataFrame([(s, p, json.dumps(v)) for s, p, v in rows], "session_id string, pos long, j string").select("session_id", "pos", F.parse_json("j").alias("v"))
    assert [(r.session_id, r.block_id) for r in persistence.restored_blocks(df).collect()] == [("u", 1)]
    assert {(r.session_id, r.next_block_id, r.tokens_saved, r.n_blocks) for r in persistence.restored_scalars(df).collect()} == {("s", 1, 0, 0), ("t", 1, 0, 0), ("u", 2, 50, 1)}
    assert sorted((r.session_id, r.pos) for r in persistence.single_blocks(df).collect()) == [("s", 1), ("s", 2), ("t", 1), ("u", 1)]


# ---- blocks one after another

RESULT, SOFT = ("toolResult", "bashExecution"), ("compaction", "branch_summary", "custom_message")


def plain_splice(rows, blocks):
    """Lists cut and searched anew for every block."""
    rows, saved = list(rows), {}
    for b in blocks:
        keys = [r["key"] for r in rows]
        at = [keys.index(b[k]) if b[k] in keys else None for k in ("start_key", "end_key")]
        if None in at:
            times = [r["ts"] for r in rows]
            at = [times.index(b[k]) if b[k] is not None and b[k] in times else None for k in ("start_ts", "end_ts")]
        if None in at:
            continue
        lo, hi = min(at), max(at)
        while True:
            p = lo - 1
            while p >= 0 and rows[p]["role"] in RESULT + SOFT:
                p -= 1
            ids = {r["answers"] for r in rows[lo : hi + 1] if r["role"] in RESULT}
            if p < 0 or rows[p]["role"] != "assistant" or not ids & set(rows[p]["calls"]):
                break
            lo = p
        asked = {c for r in rows[lo : hi + 1] if r["role"] == "assistant" for c in r["calls"]}
        while hi + 1 < len(rows) and (rows[hi + 1]["role"] in SOFT or (rows[hi + 1]["role"] in RESULT and rows[hi + 1]["answers"] in asked)):
            hi += 1
        removed = sum(r["tokens"] for r in rows[lo : hi + 1])
        del rows[lo : hi + 1]
        made = {"key": f"synth:block:b{b['block_id']}", "role": "user", "ts": b["anchor_ts"] - 0.5 if b["anchor_ts"] is not None else None if b["end_ts"] is None else b["end_ts"] + 0.5, "tokens": b["added"], "calls": [], "answers": None}
        keys = [r["key"] for r in rows]
        if (b["anchor_key"] or "").startswith("tail:"):
            rows.append(made)
        elif b["anchor_key"] in keys:
            rows.insert(keys.index(b["anchor_key"]), made)
        else:
            rows.append(made)
            rows.sort(key=lambda r: r["ts"] or 0)
        saved[b["block_id"]] = removed
    return [r["key"] for r in rows], saved


def random_session(rng, n):
    rows = []
    for k in range(n):
        role = rng.choices(["user", "assistant", "toolResult", "bashExecution", "custom_message", "system"], [3, 5, 5, 1, 1, 1])[0]
        rows.append({"key": f"k{k if rng.random() < 0.97 else 0}", "role": role, "ts": rng.choice([float(k), float(k), None, 3.0]), "tokens": rng.randint(0, 9), "calls": [f"c{rng.randint(0, 6)}" for _ in range(rng.randint(0, 2))] if role == "assistant" else [], "answers": f"c{rng.randint(0, 6)}" if role in RESULT and rng.random() < 0.9 else None})
    key = lambda: rng.choice([f"k{rng.randrange(n)}", f"k{rng.randrange(n)}", f"synth:block:b{rng.randint(1, 6)}", None, "gone"])
    time = lambda: rng.choice([float(rng.randrange(n)), None])
    blocks = [{"block_id": b, "start_key": key(), "end_key": key(), "start_ts": time(), "end_ts": time(), "anchor_key": rng.choice([key(), "tail:x"]), "anchor_ts": time(), "added": rng.randint(0, 5)} for b in range(1, 9)]
    return rows, blocks


@pytest.mark.parametrize("seed", range(60))
def test_blocks_in_order_against_plain_lists(seed):
    rng = random.Random(seed)
    rows, blocks = random_session(rng, rng.randint(1, 25))
    items = splicing.Rows([splicing.Item(r["key"], r["role"], r["ts"], r["tokens"], tuple(r["calls"]), r["answers"]) for r in rows])
    saved = {b["block_id"]: splicing.applied(items, splicing.Block(**b)) for b in blocks}
    want, removed = plain_splice(rows, blocks)
    assert [i.key for i in items] == want and {b: r for b, r in saved.items() if r is not None} == removed


def test_many_insertions_before_one_row():
    """Labels run out of room between two rows and are given anew."""
    items = splicing.Rows([splicing.Item(f"k{k}", "user", None, 1) for k in range(3)])
    for b in range(200):
        items.insert(splicing.Item(f"b{b}", "user", None, 1), items.found(items.by_key, "k1"))
    assert [i.key for i in items] == ["k0", *(f"b{b}" for b in range(200)), "k1", "k2"]
    labels = [i.label for i in items]
    assert labels == sorted(set(labels))


def test_splicing_in_spark(spark):
    rows = [(f"s{s}", o, "user" if o % 2 == 0 else "assistant", f"text {o} " * 5, f"k{o}", float(o), [], None) for s in range(3) for o in range(6)]
    df = spark.createDataFrame(rows, "session_id string, ordinal long, role string, content string, source_key string, ts double, calls array<string>, tool_call_id string")
    made = [("s0", 1, "k1", "k3", "k4", 4.0, True), ("s0", 2, "k4", "k4", "tail:k4", 5.0, True), ("s0", 3, "k2", "k2", "k5", 5.0, True), ("s1", 1, "k0", "k0", "k1", 1.0, False)]
    blocks = spark.createDataFrame(made, "session_id string, block_id long, start_key string, end_key string, anchor_key string, anchor_ts double, active boolean").withColumns({"topic": F.lit("t"), "summary": F.lit("sum"), "created_at": F.lit(None).cast("double")})
    shown, saved = splicing.spliced(df, blocks)
    got = {}
    for r in shown.orderBy("session_id", "ordinal").collect():
        got.setdefault(r.session_id, []).append(r.block_id or r.content.split()[1])
    assert got == {"s0": ["0", 1, "5", 2], "s1": list("012345"), "s2": list("012345")}
    added = 1 + len("[Compressed section: t]" + "\n" * 8 + "sum") // 4
    facts = {r.block_id: (r.removed, r.resolved, r.saved) for r in saved.collect()}
    assert facts[3] == (0, False, None) and facts[1][:2] == (27, True) and facts[2][:2] == (9, True) and abs(facts[1][2] - (27 - added)) <= 1
