"""The context pass on a session with tool calls and results."""

from __future__ import annotations

from threadloom.plans.context import PART, context_pass

ROWS = "session_id int, ordinal int, role string, content string, tool_call_id string, is_error boolean, parts array<struct<" + PART[7:-1] + ">>"
BLOCKS = "session_id int, block_id int, lo int, hi int, topic string, summary string, active boolean, created_at double"


def call(*ids, text=None):
    said = [("text", text, None, None, None, None, None)] if text else []
    return said + [("toolCall", None, None, None, i, "read", "{}") for i in ids]


def test_tool_calls_and_results(spark):
    tag = "<dcp-id>m0099</dcp-id>"
    rows = [
        ("user", "old " + tag, None, None, None), ("assistant", None, None, None, call("x")), ("toolResult", "x out", "x", False, None),
        ("user", "go", None, None, None), ("assistant", None, None, None, call("a", "lost", text="reading" + tag)), ("toolResult", "first", "a", False, None),
        ("assistant", None, None, None, call("e")), ("toolResult", None, "e", True, [("text", "failed", None, None, None, None, None)]),
        ("toolResult", "no call", "nobody", False, None), ("user", "on", None, None, None), ("user", "and on", None, None, None), ("user", "still", None, None, None),
        ("assistant", None, None, None, call("b")), ("toolResult", "second" + tag, "b", False, None),
    ]
    df = spark.createDataFrame([(1, k, r, c, t, e, p) for k, (r, c, t, e, p) in enumerate(rows)], ROWS)
    blocks = spark.createDataFrame([(1, 1, 1, 1, "topic", "summary", True, None)], BLOCKS)  # takes the call x away
    tools = spark.createDataFrame([(1, "x", "read", '{"p": 0}', 1), (1, "a", "read", '{"p": 1}', 3), (1, "e", "bash", '{"c": 1}', 4), (1, "b", "read", '{"p": 1}', 9)], "session_id int, tool_call_id string, tool_name string, arguments string, turn_index int")
    out = context_pass(df, blocks, tools).orderBy("ordinal").collect()
    assert [r.ordinal for r in out] == list(range(len(out)))
    assert [(r.role, r.tool_call_id) for r in out] == [("user", None), ("user", None), ("user", None), ("assistant", None), ("toolResult", "a"), ("assistant", None), ("toolResult", "e"), ("user", None), ("user", None), ("user", None), ("assistant", None), ("toolResult", "b")]
    assert out[0].content == "old " + tag + "\n\n<dcp-id>m0001</dcp-id>"  # users' own text stays
    assert [(p.type, p.text, p.id) for p in out[3].parts] == [("text", "reading", None), ("toolCall", None, "a")]
    assert out[4].content == "[Output removed to save context - information superseded or no longer needed]\n<dcp-id>m0004</dcp-id>"
    assert [p.text for p in out[6].parts] == ["[Error output removed - tool failed more than N turns ago]", "\n<dcp-id>m0005</dcp-id>"]
    assert out[11].content == "second\n<dcp-id>m0009</dcp-id>"
    early = context_pass(df, blocks, tools, cadence=20).orderBy("ordinal").collect()
    assert early[4].content == "first\n<dcp-id>m0004</dcp-id>" and early[6].parts[0].text == "failed"


def test_switches_of_the_configuration(spark):
    """Strategies can be switched off, tools spared, and blocks found by keys and put at anchors."""
    from threadloom.config import DEFAULTS, merged

    rows = [("user", "go", None, None, None)] + [r for k in range(6) for r in (("assistant", None, None, None, call(f"c{k}")), ("toolResult", f"out {k}", f"c{k}", k == 0, None))] + [("user", f"turn {k}", None, None, None) for k in range(4)]
    df = spark.createDataFrame([(1, k, r, c, t, e, p) for k, (r, c, t, e, p) in enumerate(rows)], ROWS)
    none = spark.createDataFrame([], BLOCKS)
    tools = spark.createDataFrame([(1, f"c{k}", "bash" if k == 0 else "read", '{"p": %d}' % (k % 2 if k else 9), k) for k in range(6)], "session_id int, tool_call_id string, tool_name string, arguments string, turn_index int")

    def gone(**strategies):
        out = context_pass(df, none, tools, config=merged(DEFAULTS, {"strategies": strategies}))
        return {r.tool_call_id for r in out.collect() if r.tool_call_id and "removed" in r.content}

    assert gone() == {"c0", "c1", "c2", "c3"}
    assert gone(deduplication={"enabled": False}) == {"c0"} and gone(purgeErrors={"enabled": False}) == {"c1", "c2", "c3"}
    assert gone(deduplication={"protectedTools": ["read"]}) == {"c0"} and gone(purgeErrors={"protectedTools": ["bash"]}) == {"c1", "c2", "c3"}
    assert gone(purgeErrors={"turns": 99}) == {"c1", "c2", "c3"} and gone(pruneCadenceTurns=20) == set()
    # a block from a result on takes in its call; its anchor is a later row
    made = spark.createDataFrame([(1, 1, "s2", "s4", "s13", "topic", "summary", True, None)], "session_id int, block_id int, start_key string, end_key string, anchor_key string, topic string, summary string, active boolean, created_at double")
    shown = context_pass(df, made, tools, config=DEFAULTS).orderBy("ordinal").collect()
    assert [r.tool_call_id for r in shown if r.tool_call_id] == ["c2", "c3", "c4", "c5"]
    assert [r.block_id for r in shown].index(1) == 9 and shown[10].content.startswith("turn 0")


def test_layers_of_configuration(tmp_path):
    from threadloom.config import config_paths, load_config

    home, env, project = tmp_path / "home", tmp_path / "env", tmp_path / "a" / "b" / "c"
    for folder in (home / "new", home / "old", env, project, tmp_path / "a" / ".x"):
        folder.mkdir(parents=True)
    (home / "old" / "f.jsonc").write_text('{"debug": true, /* both */ "compress": {"protectedTools": ["edit", "mine"], "protectRecentTurns": 9,},}')
    (env / "f.jsonc").write_text('{"compress": {"protectRecentTurns": 2}} // the environment\n')
    (tmp_path / "a" / ".x" / "f.jsonc").write_text('{"protectedFilePatterns": ["*.md"]}')
    paths = lambda: config_paths(project, "f.jsonc", preferred="new", legacy="old", local=".x", home=str(home), env_dir=str(env))
    got = load_config(paths())
    assert got["debug"] and got["compress"]["protectRecentTurns"] == 2 and got["compress"]["protectedTools"] == ["compress", "write", "edit", "mine"] and got["protectedFilePatterns"] == ["*.md"]
    (home / "new" / "f.jsonc").write_text("[1]")
    assert [p.split("/")[-2] for p in paths()] == ["new", "env", ".x"] and not load_config(paths())["debug"]
    (tmp_path / "a" / ".x" / "f.jsonc").unlink()
    assert len(paths()) == 2 and load_config([*paths(), str(tmp_path / "none")])["compress"]["protectRecentTurns"] == 2


def test_reminders_of_a_stream(spark, tmp_path):
    from threadloom.operators import nudge
    from threadloom.streaming import sessions

    turns = {"a": [1, 2, 3, 6, 7, 12], "b": [5], "c": [0, 3, 4]}
    df = spark.createDataFrame([(s, t) for s, own in turns.items() for t in own], "session_id string, turn long")
    got = []
    for cut in ("turn < 3", "turn between 3 and 6", "turn > 6"):
        df.where(cut).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        sessions.debounce_stream(stream, 3).writeStream.outputMode("append").foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    want = nudge.debounced(df.selectExpr("*", "true AS wanted"), 3).selectExpr("session_id", "explode(turns)").collect()
    assert sorted(got) == sorted(map(tuple, want)) == [("a", 1), ("a", 6), ("a", 12), ("b", 5), ("c", 0), ("c", 3)]


def test_ranges_meet_as_in_a_plain_loop(spark):
    import random

    from threadloom.operators import coverage

    pick = random.Random(7)
    spans = [(s, i, lo, lo + pick.choice((0, 1, 5, 63, 64, 200))) for s in (1, 2) for i, lo in enumerate(pick.sample(range(400), 12))]
    new = [(s, 100 + i, lo, lo + pick.choice((0, 10, 130))) for s in (1, 2) for i, lo in enumerate(pick.sample(range(400), 9))]
    times = {(s, o): pick.choice((None, float("nan"), float(pick.randrange(50)))) for s in (1, 2) for o in range(300)}
    rows = spark.createDataFrame([(s, o, t) for (s, o), t in times.items()], "session_id int, ordinal int, ts double")
    blocks = spark.createDataFrame([(s, i, lo, hi, i % 4 > 0, lo / 8.0, None if i == 3 else hi / 8.0) for s, i, lo, hi in spans], "session_id int, block_id int, lo int, hi int, active boolean, start_ts double, end_ts double")
    found = sorted(map(tuple, coverage.covered_rows(rows, blocks).collect()))
    assert found == sorted((s, i, o) for s, i, lo, hi in spans for o in range(lo, min(hi, 299) + 1))
    timed = sorted(map(tuple, coverage.time_coverage(rows, blocks).collect()))
    assert timed == sorted((s, i, o) for s, i, lo, hi in spans if i != 3 for (s2, o), t in times.items() if s2 == s and t is not None and lo / 8 <= t <= hi / 8)
    ranges = spark.createDataFrame(new, "session_id int, range_id int, lo int, hi int")
    met = sorted(map(tuple, coverage.overlapping(ranges, blocks).collect()))
    assert met == sorted((s, r, i, "supersedes" if lo <= a and b <= hi else "partial-overlap") for s, r, lo, hi in new for s2, i, a, b in spans if s == s2 and i % 4 and lo <= b and a <= hi)
    refs = [(s, o, f"k{o}") for s in (1, 2) for o in range(0, 300, 7)]
    ends = ranges.selectExpr("session_id", "range_id", "hi", "concat('e', range_id) as end_key")
    got = sorted(map(tuple, coverage.anchors(ends, spark.createDataFrame(refs, "session_id int, ordinal int, source_key string")).collect()))
    assert got == sorted((s, r, next((k for s2, o, k in refs if s2 == s and o > hi), f"tail:e{r}")) for s, r, _, hi in new)
