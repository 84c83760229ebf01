"""Registered queries over agent transcripts, trees of entries and saved state, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom import sql
from threadloom.config import DEFAULTS
from threadloom.functions import refs, text, tokens, tools
from threadloom.operators import artifacts, branches, compaction, coverage, hints, nudge, payload, persistence, pruning, replay, splicing, status, transaction, transcript
from threadloom.queries import EST, INLINE, M, PLACE, QUERIES, SQL, _with, register
from threadloom.sources import adapters, jsonl

# ruff: noqa: E501 - queries are listed with their SQL
__all__ = ["QUERIES", "SQL"]

E = """e AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_id, event_type, event_type = 'signup' AS u, event_type = 'error' AND event_id % 2 = 0 AS lost, event_id % 97 AS k, 'c' || event_id AS call, props,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'bash' WHEN 'purchase' THEN 'edit' ELSE 'grep' END AS tool FROM events)"""
A = """a AS (SELECT session_id, 2 * i AS ordinal, CASE WHEN u THEN 'user' ELSE 'assistant' END AS role, CASE WHEN NOT u THEN call END AS call, NULL AS tool_call_id FROM e
  UNION ALL SELECT session_id, 2 * i + 1, CASE WHEN u THEN 'custom_message' ELSE 'toolResult' END, NULL, CASE WHEN u THEN NULL WHEN lost THEN 'x' || call ELSE call END FROM e)"""


def _tools(spark, sf_dir):
    rows, calls = adapters.agent_rows(spark, sf_dir)
    return artifacts.with_tools(rows, calls)


@register("tool_spans", _with(E) + "SELECT session_id, 2 * i AS lo, 2 * i + CASE WHEN u OR lost THEN 0 ELSE 1 END AS hi, CASE WHEN u OR lost THEN 'message' ELSE 'tool-exchange' END AS kind, true AS is_turn FROM e UNION ALL SELECT session_id, 2 * i + 1, 2 * i + 1, 'message', lost FROM e WHERE u OR lost")
def tool_spans(spark, sf_dir):
    return transcript.spans(adapters.agent_rows(spark, sf_dir)[0]).select("session_id", "lo", "hi", "kind", "is_turn")


@register("span_turns", _with(E) + "SELECT session_id, count(*) + count(*) FILTER (WHERE lost) AS turns FROM e GROUP BY 1")
def span_turns(spark, sf_dir):
    return transcript.logical_turns(transcript.spans(adapters.agent_rows(spark, sf_dir)[0]))


@register("orphans_repaired", _with(E) + "SELECT session_id, 2 * i AS ordinal, CASE WHEN u OR lost THEN 0 ELSE 1 END AS n_parts FROM e UNION ALL SELECT session_id, 2 * i + 1, 0 FROM e WHERE NOT lost")
def orphans_repaired(spark, sf_dir):
    rows = adapters.agent_rows(spark, sf_dir)[0]
    parts = F.transform("calls", lambda c: F.struct(F.lit("toolCall").alias("type"), c.alias("id")))
    return pruning.without_orphans(rows.withColumn("parts", parts)).select("session_id", "ordinal", F.size("parts").alias("n_parts"))


@register("range_closure", _with(E, A, "r AS (SELECT session_id, g AS range_id, 4 * g + 3 AS lo, 4 * g + 6 AS hi FROM (SELECT session_id, max(ordinal) AS last FROM a GROUP BY 1), range(0, 4) t(g) WHERE 4 * g + 6 <= last)")
          + "SELECT r.session_id, range_id, CASE WHEN x.u OR x.lost THEN r.lo ELSE r.lo - 1 END AS lo, CASE WHEN y.lost THEN r.hi ELSE r.hi + 1 END AS hi FROM r JOIN e x ON x.session_id = r.session_id AND 2 * x.i + 1 = r.lo JOIN e y ON y.session_id = r.session_id AND 2 * y.i = r.hi")
def range_closure(spark, sf_dir):
    rows = adapters.agent_rows(spark, sf_dir)[0]
    g = F.explode(F.sequence(F.lit(0), F.lit(3)))
    ranges = rows.groupBy("session_id").agg(F.max("ordinal").alias("last")).select("session_id", "last", g.alias("range_id")).select("session_id", "range_id", (4 * F.col("range_id") + 3).alias("lo"), (4 * F.col("range_id") + 6).alias("hi"), "last").where("hi <= last").drop("last")
    return coverage.closed(rows, ranges)


@register("tool_records", _with("e AS (SELECT user_id AS session_id, event_type AS tool, event_id % 5 AS id, event_id, props, event_type = 'error' AS bad FROM events)",
                                "c AS (SELECT session_id, id, arg_min(tool, event_id) AS tool, arg_min(props, event_id) AS args, min(event_id) AS turn FROM e WHERE event_id % 3 <> 0 GROUP BY 1, 2)",
                                "r AS (SELECT session_id, id, arg_min(tool, event_id) AS tool, min(event_id) AS turn, arg_max(bad, event_id) AS bad, arg_max(props, event_id) AS text FROM e WHERE event_id % 3 <> 1 GROUP BY 1, 2)")
          + f"SELECT coalesce(c.session_id, r.session_id) AS session_id, coalesce(c.id, r.id) AS tool_call_id, coalesce(c.tool, r.tool) AS tool_name, coalesce(c.args, '{{}}') AS arguments, coalesce(c.turn, r.turn) AS turn_index, coalesce(bad, false) AS is_error, coalesce({EST.format('text')}, 0) AS tokens FROM c FULL JOIN r ON c.session_id = r.session_id AND c.id = r.id")
def tool_records(spark, sf_dir):
    e = adapters.read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 5).alias("tool_call_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("tool_name"), F.col("props").alias("arguments"), F.col("event_id").alias("turn_index"), (F.col("event_type") == "error").alias("is_error"), F.col("props").alias("content"))
    return artifacts.tool_records(e.where("pos % 3 <> 0"), e.where("pos % 3 <> 1")).drop("fingerprint")


SHELL = "CASE k % 6 WHEN 0 THEN 'git commit -m x' WHEN 1 THEN 'cd a && git commit' WHEN 2 THEN 'npm test' WHEN 3 THEN 'bun run build' WHEN 4 THEN '  npx  tsc' ELSE 'GIT COMMIT' END"
SPAN = "CASE WHEN k % 3 = 0 THEN NULL WHEN k % 4 > 1 THEN 'L' || k || '-L' || (k + k % 4 - 1) ELSE 'L' || k END"
LINES = "(CASE WHEN k % {0} = 0 THEN 0 ELSE k % {0} + 1 END)"
DELTA = f"({LINES.format(5)} - {LINES.format(3)})"


@register("activity_log", _with(E, "t AS (SELECT *, event_type = 'error' AS bad FROM e WHERE NOT u AND NOT lost)") + f"""SELECT session_id, 2 * i + 1 AS ordinal,
  CASE tool WHEN 'grep' THEN 'tool' WHEN 'bash' THEN CASE WHEN k % 6 = 0 THEN 'commit' WHEN k % 6 IN (2, 3) THEN 'test' ELSE 'command' END ELSE tool END AS kind,
  CASE tool WHEN 'read' THEN 'f' || k % 7 || coalesce('#' || {SPAN}, '') WHEN 'bash' THEN trim(replace({SHELL}, '  ', ' ')) || ' -> ok'
    WHEN 'edit' THEN 'f' || k % 7 || ' (2 edits, +' || greatest({DELTA}, 0) || '/-' || (greatest(-{DELTA}, 0) + 1) || ')' ELSE 'grep ' || CASE WHEN k % 2 = 1 THEN 'f' || k % 7 || ' ' ELSE '' END || 'p' || k END AS text FROM t
  UNION ALL SELECT session_id, 2 * i, 'user_excerpt', '"' || props || '"' FROM e WHERE u""")
def activity_log(spark, sf_dir):
    rows, calls = adapters.agent_rows(spark, sf_dir)
    return artifacts.activity_log(rows, artifacts.with_tools(rows, calls))


@register("file_reads", _with(E) + f"SELECT session_id, 'f' || k % 7 AS path, count(*) AS count, coalesce(list_sort(list_distinct(list({SPAN}) FILTER (WHERE k % 3 <> 0))), []) AS line_spans FROM e WHERE tool = 'read' GROUP BY 1, 2")
def file_reads(spark, sf_dir):
    return artifacts.file_reads(_tools(spark, sf_dir), "session_id").withColumn("line_spans", F.array_sort("line_spans"))


@register("file_writes", _with(E) + f"SELECT session_id, 'f' || k % 7 AS path, CAST(2 * count(*) AS BIGINT) AS edit_count, CAST(sum(greatest({DELTA}, 0)) AS BIGINT) AS added_lines, CAST(sum(greatest(-{DELTA}, 0) + 1) AS BIGINT) AS removed_lines FROM e WHERE tool = 'edit' GROUP BY 1, 2")
def file_writes(spark, sf_dir):
    return artifacts.file_writes(_tools(spark, sf_dir), "session_id")


@register("command_stats", _with(E) + f"SELECT session_id, 2 * i + 1 AS ordinal, {SHELL} AS command, 'ok' AS status FROM e WHERE tool = 'bash'")
def command_stats(spark, sf_dir):
    return artifacts.commands(_tools(spark, sf_dir))


@register("block_coverage", _with(E, A, "p AS (SELECT a.*, g FROM a, range(0, 3) t(g) WHERE ordinal BETWEEN 6 * g + 1 AND 6 * g + 4)") + "SELECT p.session_id, g AS range_id, list('s' || p.ordinal ORDER BY p.ordinal) AS source_keys, CAST(count(*) FILTER (WHERE p.ordinal <= 6 * g + 4 AND (p.role IN ('user', 'custom_message') OR e.lost OR (p.role = 'assistant' AND p.ordinal < 6 * g + 4))) AS INT) AS n_spans, coalesce(list(tool_call_id ORDER BY p.ordinal) FILTER (WHERE tool_call_id IS NOT NULL), []) AS tool_ids FROM p JOIN e ON e.session_id = p.session_id AND e.i = p.ordinal // 2 GROUP BY 1, 2")
def block_coverage(spark, sf_dir):
    rows = adapters.agent_rows(spark, sf_dir)[0]
    ranges = rows.select("session_id").distinct().select("session_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("range_id")).select("session_id", "range_id", (6 * F.col("range_id") + 1).alias("lo"), (6 * F.col("range_id") + 4).alias("hi"))
    return artifacts.covered(rows, transcript.spans(rows), ranges).select("session_id", "range_id", "source_keys", F.size("span_keys").alias("n_spans"), "tool_ids")


@register("exact_coverage", _with("m AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations)", "l AS (SELECT session_id, max(ordinal) AS last FROM m GROUP BY 1)") + "SELECT session_id, b AS block_id, b + 2 <= last AS resolved, CASE WHEN b + 2 <= last THEN [b, b + 2] END AS ordinals FROM l, (VALUES (0), (3), (6)) t(b)")
def exact_coverage(spark, sf_dir):
    rows = adapters.messages(spark, sf_dir).withColumn("source_key", transcript.owner_key(F.col("ordinal")))
    made = rows.select("session_id").distinct().select("session_id", F.explode(F.array(*map(F.lit, (0, 3, 6)))).alias("block_id"))
    made = made.withColumn("covered_source_keys", F.array(transcript.owner_key(F.col("block_id")), transcript.owner_key(F.col("block_id") + 2)))
    return coverage.exact_coverage(rows, made)


@register("time_coverage", "SELECT conv_id AS session_id, 1 AS block_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations QUALIFY (turn + 1) * 1000 BETWEEN 1500 AND 4000")
def time_coverage(spark, sf_dir):
    rows = adapters.messages(spark, sf_dir)
    made = rows.select("session_id").distinct().select("session_id", F.lit(1).alias("block_id"), F.lit(1500.0).alias("start_ts"), F.lit(4000.0).alias("end_ts"))
    return coverage.time_coverage(rows, made)


def _requests(spark, sf_dir):
    rows = adapters.messages(spark, sf_dir)
    made = adapters.blocks(rows)
    covered = coverage.covered_rows(rows, made)
    known = rows.join(covered, ["session_id", "ordinal"], "left").select("session_id", refs.format_ref(F.col("ordinal")).alias("ref"), "ordinal", "block_id")
    asked = (("1", 1, "m0000", "m0000", "one"), ("1", 2, "m004", "m0004", "two"), ("2", 3, "b1", "m0004", "three"), ("3", 4, "m0002", "m0004", "four"), ("4", 5, "b1", "b1", "five"), ("5", 6, "x", "m0000", "six"), ("6", 7, "m0000", "m0900", ""), ("7", 8, "m0000", "m0900", "eight"), ("8", 9, "m0004", "m0000", "nine"), ("9", 10, "m0000", "b2", "ten"))
    rows_ = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("request_id", "range_id", "start_ref", "end_ref", "topic"), a, strict=True))) for a in asked))
    requests = made.where("block_id = 2").select("session_id", F.explode(rows_).alias("r")).select("session_id", "r.*", F.lit("s").alias("summary"))
    return transaction.boundaries(requests, known, made), covered, made


@register("request_boundaries", "WITH l AS (SELECT conv_id AS session_id FROM conversations GROUP BY 1 HAVING count(*) > 6) SELECT session_id, range_id, lo, hi, error FROM l, (VALUES (1, 0, 0, NULL), (2, 4, 4, NULL), (3, 1, 4, NULL), (4, NULL, 4, 'inside-block'), (5, 1, 3, 'only-block'), (6, NULL, 0, 'invalid-start'), (7, 0, NULL, 'no-topic'), (8, 0, NULL, 'unknown-end'), (9, 4, 0, 'reversed'), (10, 0, 6, NULL)) t(range_id, lo, hi, error)")
def request_boundaries(spark, sf_dir):
    return _requests(spark, sf_dir)[0].select("session_id", "range_id", "lo", "hi", "error")


@register("request_commit", "WITH l AS (SELECT conv_id AS session_id FROM conversations GROUP BY 1 HAVING count(*) > 6) SELECT session_id, range_id, block_id, replaced FROM l, (VALUES (1, 3, []), (2, 4, []), (3, 5, [1]), (10, 6, [1, 2])) t(range_id, block_id, replaced)")
def request_commit(spark, sf_dir):
    checked, covered, made = _requests(spark, sf_dir)
    relations = transaction.superseded(checked.where("error is null"), covered, made)
    new, _ = transaction.commit(checked, relations, made.groupBy("session_id").agg((F.max("block_id") + 1).alias("next_block_id")))
    gone = relations.groupBy("session_id", "range_id").agg(F.array_sort(F.collect_set("block_id")).alias("replaced"))
    return new.join(gone, ["session_id", "range_id"], "left").select("session_id", "range_id", "block_id", F.coalesce("replaced", F.array().cast("array<int>")).alias("replaced"))


@register("nearest_block_refs", "SELECT session_id, block_id, start_ref, end_ref FROM (SELECT conv_id AS session_id, count(*) AS n FROM conversations GROUP BY 1), (VALUES (1, 3, 'm0002', 'm0002'), (2, 6, 'm0006', 'm0006')) t(block_id, hi, start_ref, end_ref) WHERE n > hi")
def nearest_block_refs(spark, sf_dir):
    rows = adapters.messages(spark, sf_dir)
    return transaction.nearest_refs(adapters.blocks(rows), rows.where("ordinal % 2 = 0").select("session_id", "ordinal", refs.format_ref(F.col("ordinal")).alias("ref")))


def _tree(spark, sf_dir):
    """Customers as a heap: in each nation the entry numbered n hangs on number n // 2."""
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = adapters.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session_id"), n.alias("pos"), (F.col("c_custkey") % 3).alias("k"))
    return rows.select("session_id", "pos", "k", F.col("pos").cast("string").alias("id"), F.when(F.col("pos") > 1, F.floor(F.col("pos") / 2).cast("string")).alias("parent_id"))


TREE = "t AS (SELECT c_nationkey AS session_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos, c_custkey % 3 AS k FROM customer)"
UP = "up(session_id, leaf, node, d) AS (SELECT session_id, pos, pos, 0 FROM t UNION ALL SELECT session_id, leaf, node // 2, d + 1 FROM up WHERE node > 1)"


@register("branch_paths", "WITH RECURSIVE " + TREE + ", " + UP + " SELECT up.session_id, CAST(leaf AS VARCHAR) AS branch_id, CAST(node AS VARCHAR) AS id, CAST(max(d) OVER (PARTITION BY up.session_id, leaf) - d AS BIGINT) AS depth FROM up WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.session_id = up.session_id AND t.pos // 2 = up.leaf AND t.pos > 1)")
def branch_paths(spark, sf_dir):
    return branches.branch_entries(_tree(spark, sf_dir))


@register("tree_markers", "WITH RECURSIVE " + TREE + ", " + UP + ", n AS (SELECT up.session_id, leaf, arg_min(t.k, d) AS k FROM up JOIN t ON t.session_id = up.session_id AND t.pos = node WHERE d > 0 AND node % 2 = 1 AND leaf % 2 = 1 GROUP BY 1, 2) SELECT t.session_id, CAST(pos AS VARCHAR) AS id, coalesce(n.k = t.k, false) AS is_marker FROM t LEFT JOIN n ON n.session_id = t.session_id AND n.leaf = t.pos WHERE pos % 2 = 1")
def tree_markers(spark, sf_dir):
    """Entries of odd number hold a snapshot; one equal to that of its nearest ancestor is a marker."""
    nodes = _tree(spark, sf_dir)
    held = nodes.where("pos % 2 = 1")
    text = F.to_json(F.struct(F.lit(5).alias("schemaVersion"), F.col("pos").alias("savedAt"), F.struct(F.col("k").alias("savedAt")).alias("k")))
    return persistence.marked_by_ancestor(held.select("session_id", "id", "pos", F.parse_json(text).alias("v"), text.alias("text")), branches.nearest_marked(nodes, held)).select("session_id", "id", "is_marker")


@register("replayable_branches", "WITH RECURSIVE " + TREE + ", " + UP + " SELECT up.session_id, CAST(leaf AS VARCHAR) AS branch_id, bool_or(t.k = 0 AND t.pos % 4 = 1 OR t.k = 1 AND t.pos % 5 = 0) AS replayable FROM up JOIN t ON t.session_id = up.session_id AND t.pos = node WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.session_id = up.session_id AND c.pos // 2 = up.leaf AND c.pos > 1) GROUP BY 1, 2")
def replayable_branches(spark, sf_dir):
    nodes = _tree(spark, sf_dir)
    kind = nodes.select(
        "session_id", "id", F.when(F.col("k") == 1, "compaction").otherwise("message").alias("type"), F.lit("toolResult").alias("role"), F.when((F.col("k") == 0) & (F.col("pos") % 4 == 1), "compress").otherwise("read").alias("tool_name"), F.lit(None).cast("boolean").alias("is_error"),
        F.lit(branches.NATIVE_SOURCE).alias("compaction_source"), F.when(F.col("pos") % 5 == 0, F.array("pos")).otherwise(F.array().cast("array<int>")).alias("represented"),
    )
    return branches.replayable(branches.branch_entries(nodes).join(kind, ["session_id", "id"]))


SNAPSHOT = "s AS (SELECT o_custkey AS session_id, arg_max(o_orderkey % 7, o_orderkey) AS v, max(o_orderkey) AS o FROM orders GROUP BY 1)"


def _snapshots(spark, sf_dir):
    """Orders as snapshots: version by the key modulo 7 (6: none), blocks of ids 1 and 4 and one that isn't valid."""
    key = F.col("o_orderkey")
    version = F.when(key % 7 < 6, key % 7)
    block = F.concat(F.lit('[{"id":1,"topic":"a","summary":"s","startTimestamp":1,"endTimestamp":2,"active":true,"savedTokenEstimate":'), (key % 50).cast("string"), F.lit('},{"id":4,"topic":"b","summary":"","startTimestamp":3,"endTimestamp":4,"active":false,"savedTokenEstimate":9},{"id":5}]'))
    body = F.concat(F.lit('{"savedAt":1,"prunedToolIds":["c'), (key % 9).cast("string"), F.lit('",7,"x"],"lifetimeTokensSavedRealized":'), (key % 13).cast("string"), F.when(key % 2 == 0, F.concat(F.lit(',"currentTurn":'), (key % 11).cast("string"))).otherwise(F.lit(',"currentTurn":"4","lastNudgeTurn":3')), F.coalesce(F.concat(F.lit(',"schemaVersion":'), version.cast("string")), F.lit("")), F.when(version >= 4, F.concat(F.lit(',"blocks":'), block)).when(F.coalesce(version, F.lit(1)) == 1, F.concat(F.lit(',"tokensSaved":77,"compressionBlocks":'), block)).otherwise(""), F.lit("}"))
    return adapters.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), key.alias("pos"), F.parse_json(body).alias("v"))


@register("restored_state", _with(SNAPSHOT) + """SELECT session_id, CASE v WHEN 5 THEN 'restored-v5' WHEN 4 THEN 'reset-legacy-v4' WHEN 3 THEN 'scalar-v3' WHEN 1 THEN 'restored-v1' WHEN 6 THEN 'restored-v1' ELSE 'scalar-legacy' END AS kind, CASE WHEN v IN (1, 5, 6) THEN 5 ELSE 1 END AS next_block_id, CAST(CASE WHEN v = 5 THEN o % 50 WHEN v IN (1, 6) THEN 77 ELSE 0 END AS BIGINT) AS tokens_saved, CASE WHEN v IN (1, 5, 6) THEN 2 ELSE 0 END AS n_blocks,
  v AS schema_version, ['c' || o % 9, 'x'] AS pruned_tool_ids, o % 13 AS lifetime_saved, CASE WHEN o % 2 = 0 THEN o % 11 ELSE 0 END AS current_turn, CASE WHEN o % 2 = 0 THEN -1 ELSE 3 END AS last_nudge_turn FROM (SELECT *  REPLACE (CASE v WHEN 6 THEN 1 ELSE v END AS v) FROM s)""")
def restored_state(spark, sf_dir):
    return persistence.restored_scalars(_snapshots(spark, sf_dir)).drop("last_compress_turn")


BLOCK_FIELDS = """CAST(b AS BIGINT) AS block_id, b = 1 OR o % 2 = 0 AS active,
  CASE WHEN o % 3 = 1 THEN 'infinity'::DOUBLE ELSE b * 10 END AS start_ts, CASE WHEN o % 3 = 1 OR b = 2 THEN 'infinity'::DOUBLE ELSE b * 10 + 6 END AS anchor_ts, CASE WHEN b = 2 THEN 0 ELSE CAST(o % 50 AS DOUBLE) END AS saved_tokens,
  CASE WHEN o % 3 = 1 THEN [7] ELSE [8] END AS superseded_block_ids, CASE WHEN o % 3 = 1 THEN [] ELSE ['k' || o] END AS covered_source_keys, CASE WHEN o % 3 <> 1 THEN 1 END AS n_log, CASE WHEN o % 3 <> 1 THEN 'f:3' END AS read, CASE WHEN o % 3 <> 1 THEN 'other' END AS status"""


def _versioned(spark, sf_dir):
    """Orders as snapshots of three versions with two valid blocks and some that aren't."""
    key = F.col("o_orderkey")
    k, n = key.cast("string"), (key % 50).cast("string")
    rest = ',"metadata":{"coveredSourceKeys":["k%s",5],"supersededBlockIds":[8,"9"],"fileReadStats":[{"path":"f","count":3},{"count":1}],"commandStats":[{"command":"c","status":"odd"},5]},"activityLog":[{"kind":"read","text":"t"},{"kind":"odd","text":"t"},{"kind":"read"}],"supersededBlockIds":[7]'
    one = F.format_string('{"id":1,"topic":"a","summary":"s","startTimestamp":10,"endTimestamp":15,"anchorTimestamp":16,"savedTokenEstimate":%s' + rest + "}", n, k)
    two = F.format_string('{"id":2,"topic":"","summary":"","startTimestamp":20,"endTimestamp":25,"anchorTimestamp":"x","active":%s,"savedTokenEstimate":"4"' + rest + "}", (key % 2 == 0).cast("string"), k)
    bad = F.lit('{"id":"3","topic":"a","summary":"s","startTimestamp":1,"endTimestamp":2},{"id":4,"topic":"a","startTimestamp":1,"endTimestamp":2},7')
    named = F.when(key % 3 == 0, '{"schemaVersion":5,"blocks":[').when(key % 3 == 1, '{"schemaVersion":4,"blocks":[').otherwise('{"compressionBlocks":[')
    v = F.parse_json(F.concat(named, F.concat_ws(",", one, two, bad), F.lit("]}")))
    return adapters.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), key.alias("pos"), v.alias("v"))


def _block_fields(blocks, *first):
    read = F.transform("file_reads", lambda r: F.concat_ws(":", r["path"], r["count"].cast("long").cast("string")))
    return blocks.select(*first, "block_id", "active", "start_ts", "anchor_ts", "saved_tokens", "superseded_block_ids", "covered_source_keys", F.when(F.col("activity_log").isNotNull(), F.size("activity_log")).alias("n_log"), F.element_at(read, 1).alias("read"), F.element_at("commands.status", 1).alias("status"))


@register("restored_blocks", _with("s AS (SELECT o_custkey AS session_id, max(o_orderkey) AS o FROM orders GROUP BY 1)") + f"SELECT session_id, CASE o % 3 WHEN 0 THEN 'restored-v5' ELSE 'restored-v1' END AS kind, {BLOCK_FIELDS} FROM s, (VALUES (1), (2)) t(b) WHERE o % 3 <> 1")
def restored_blocks(spark, sf_dir):
    """A session whose last snapshot is of version 4 resumes without blocks, whatever came before."""
    return _block_fields(persistence.restored_blocks(_versioned(spark, sf_dir)), "session_id", "kind")


@register("single_blocks", f"SELECT o_custkey AS session_id, o_orderkey AS pos, {BLOCK_FIELDS} FROM (SELECT *, o_orderkey AS o FROM orders), (VALUES (1), (2)) t(b)")
def single_blocks(spark, sf_dir):
    return _block_fields(persistence.single_blocks(_versioned(spark, sf_dir)), "session_id", "pos")


@register("debug_lines", """SELECT '{"timestamp":"1970-01-01T00:00:0' || event_id % 10 || '.000Z","event":"' || event_type || '","payload":{"n":' || CASE event_id % 3 WHEN 0 THEN '"NaN"' WHEN 1 THEN '"-Infinity"' ELSE 'null' END || ',"who":' || user_id || '}}' AS value FROM events""")
def debug_lines(spark, sf_dir):
    n = F.when(F.col("event_id") % 3 == 0, float("nan")).when(F.col("event_id") % 3 == 1, float("-inf"))
    e = adapters.read(spark, sf_dir, "events").select(F.timestamp_seconds(F.col("event_id") % 10).alias("ts"), F.col("event_type").alias("event"), n.alias("n"), F.col("user_id").alias("who"))
    return jsonl.debug_lines(e, ["n", "who"])


@register("decoded_bodies", "SELECT event_id, props AS body FROM events")
def decoded_bodies(spark, sf_dir):
    """Bodies in gzip, in deflate, plain ones, and plain ones said to be gzip, decoded."""
    import gzip
    import zlib

    @F.pandas_udf("binary")
    def encoded(bodies: pd.Series, ways: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else gzip.compress(b.encode()) if w == "GZIP" else zlib.compress(b.encode()) if w == "deflate" else b.encode() for b, w in zip(bodies, ways, strict=True)])

    way = F.element_at(F.array(*map(F.lit, ("GZIP", "deflate", "", "gzip, br"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = adapters.read(spark, sf_dir, "events").select("event_id", encoded("props", way).alias("body"), way.alias("encoding"))
    return e.select("event_id", jsonl.decoded(F.col("body"), F.col("encoding")).cast("string").alias("body"))


@register("off_branch_repair", "SELECT o_custkey AS session_id, o_orderkey AS block_id, o_orderkey % 3 = 0 OR (o_orderkey % 4 = 1 AND o_orderkey % 5 <> 0) AS active, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 = 1 AND o_orderkey % 5 <> 0 THEN 'v2' ELSE 'now' END AS topic, o_orderkey % 3 <> 0 AND o_orderkey % 4 = 1 AND o_orderkey % 5 <> 0 AS repaired FROM orders")
def off_branch_repair(spark, sf_dir):
    now = adapters.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("block_id"), (F.col("o_orderkey") % 3 == 0).alias("active"), F.lit("now").alias("topic"))
    history = now.withColumns({"pos": F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))}).withColumns({"active": F.col("pos") < 3, "topic": F.concat(F.lit("v"), F.col("pos").cast("string"))})
    return persistence.repaired(now, now.where("block_id % 5 = 0"), now.where("block_id % 4 = 1"), history)


@register("auto_decision", "SELECT o_orderkey, CASE WHEN k % 11 = 0 THEN 'no-new-blocks' WHEN k % 9 < 3 THEN 'too-few-active-blocks' WHEN k % 2500 >= 2000 THEN 'force-threshold' WHEN k % 2500 < 1000 THEN 'below-lower-threshold' WHEN k % 20 / 20.0 >= 0.65 THEN 'likely-dcp-owned' ELSE 'low-estimated-coverage' END AS reason FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS k FROM orders)")
def auto_decision(spark, sf_dir):
    k = F.floor("o_totalprice").cast("long")
    reason = compaction.decision(True, k % 11, k % 2500, k % 9, k % 20 / 20.0, DEFAULTS["nativeCompaction"])
    return adapters.read(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@register("first_sentences", f"SELECT doc_id, '- t — ' || coalesce(nullif(trim(regexp_extract(t, '^.{{0,200}}?[.!?](\\s|$)')), ''), substr(t, 1, 200)) AS line FROM (SELECT doc_id, {INLINE} AS t FROM documents) WHERE t <> ''")
def first_sentences(spark, sf_dir):
    docs = adapters.read(spark, sf_dir, "documents").where(text.normalize_inline(F.col("text")) != "")
    return docs.select("doc_id", compaction.archived_line(F.lit(" t "), F.col("text")).alias("line"))


@register("summary_sections", "WITH b AS (SELECT o_custkey AS session_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders), t AS (SELECT *, CASE WHEN n <= 4 THEN 2 WHEN n <= 12 THEN 1 ELSE 0 END AS f FROM b), p AS (SELECT session_id, string_agg(CASE WHEN f = 0 THEN '- q\"' || id || ' — Done.' END, chr(10) ORDER BY id) AS old, string_agg(CASE f WHEN 1 THEN '<section topic=\"q&quot;' || id || '\" tier=\"compact\">' || chr(10) || 'Done. More' || chr(10) || '</section>' WHEN 2 THEN '<section topic=\"q&quot;' || id || '\">' || chr(10) || 'Done. More' || chr(10) || '</section>' END, chr(10) || chr(10) ORDER BY f, id) AS new FROM t GROUP BY 1) SELECT session_id, coalesce('<archived-sections>' || chr(10) || old || chr(10) || '</archived-sections>' || chr(10) || chr(10), '') || new AS text FROM p")
def summary_sections(spark, sf_dir):
    made = adapters.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("block_id"), F.concat(F.lit('q"'), F.col("o_orderkey").cast("string")).alias("topic"), F.lit("Done. More").alias("summary"), )
    return compaction.summary_text(compaction.demoted(compaction.sized(made.withColumn("body", F.col("summary"))), 0))


@register("compaction_instructions", "SELECT o_custkey AS session_id, '" + compaction.INSTRUCTIONS + "' || chr(10) || chr(10) || string_agg('<block id=\"b' || o_orderkey || '\" topic=\"' || replace(o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ' \"q\"' ELSE '' END, '\"', '&quot;') || '\">' || chr(10) || o_orderstatus || chr(10) || '</block>', chr(10) || chr(10) ORDER BY o_orderkey) AS text FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def compaction_instructions(spark, sf_dir):
    topic = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, ' "q"').otherwise(""))
    return compaction.instructions(adapters.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("block_id"), (F.col("o_orderkey") % 2 == 0).alias("active"), topic.alias("topic"), F.col("o_orderstatus").alias("body")))


@register("status_lines", "SELECT o_orderkey, 'DCP' || CASE WHEN n % 4 > 0 THEN ' ' || n % 4 * 100 || ' saved' ELSE '' END || CASE WHEN n % 3 > 0 THEN ' ' || n % 3 || ' prunes' ELSE '' END || CASE WHEN n % 5 > 0 THEN ' b' || n % 5 ELSE '' END AS line FROM (SELECT o_orderkey, o_orderkey AS n FROM orders)")
def status_lines(spark, sf_dir):
    n = F.col("o_orderkey")
    return adapters.read(spark, sf_dir, "orders").select("o_orderkey", status.status_line(n % 4 * 100 - 50, F.when(n % 4 > 0, F.lit(50)), n % 3, F.when(n % 5 > 0, n % 5)).alias("line"))


@register("request_providers", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'openai' WHEN 3 THEN 'anthropic' END AS provider, CASE event_id % 6 WHEN 0 THEN '/messages' WHEN 1 THEN '/responses/x' WHEN 2 THEN '/other' WHEN 3 THEN '/' WHEN 4 THEN '/other' ELSE '/messagesx' END AS path FROM events")
def request_providers(spark, sf_dir):
    k = F.col("event_id") % 6
    url = F.element_at(F.array(*map(F.lit, ("http://h/v1/messages?a=/responses", "/responses/x", "/v1/other", "/v1", "https://h:1/other#x", "/v1/messagesx"))), (k + 1).cast("int"))
    headers = F.when(k == 2, F.array(F.lit("authorization"))).when(k == 3, F.array(F.lit("x-api-key"), F.lit("accept"))).when(k == 4, F.array(F.lit("authorization"), F.lit("x-api-key"))).otherwise(F.array().cast("array<string>"))
    return adapters.read(spark, sf_dir, "events").select("event_id", status.provider(url, headers).alias("provider"), status.request_path(url).alias("path"))


@register("part_texts", "SELECT doc_id, 't' || CASE WHEN text IS NULL THEN '' ELSE chr(10) || text END AS plain, '[thinking] t [toolCall read c1 {\"a\": 1}] [image] [odd]' || CASE WHEN text IS NULL THEN '' ELSE ' ' || text END AS labelled, CAST(coalesce(" + EST.format("text") + ", 0) + 502 AS BIGINT) AS tokens FROM documents")
def part_texts(spark, sf_dir):
    fields = ("type", "text", "thinking", "input", "id", "name", "arguments")
    part = lambda **own: F.struct(*(F.lit(own.get(c)).cast("string").alias(c) if not hasattr(own.get(c), "alias") else own[c].alias(c) for c in fields))
    parts = F.array(part(type="thinking", text="t"), part(type="toolCall", name="read", id="c1", arguments='{"a": 1}', input="in"), part(type="image"), part(type="odd", thinking="th"), part(type="text", text=F.col("text")))
    docs = adapters.read(spark, sf_dir, "documents")
    return docs.select("doc_id", text.plain_text(parts).alias("plain"), text.labelled_text(parts).alias("labelled"), tokens.message_estimate(F.lit(None).cast("string"), parts).alias("tokens"))


@register("log_lines", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'u: ' WHEN 1 THEN 'a: ' WHEN 2 THEN 'cmd: ' ELSE 'read: ' END || CASE WHEN length(t) > 800 THEN rtrim(substr(t, 1, 799)) || '…' ELSE t END AS line FROM (SELECT event_id, trim(event_type || CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' ' WHEN 2 THEN ' <dcp-note> ' ELSE ' x' END || props || repeat(' y', CAST(event_id % 450 AS INT))) AS t0, regexp_replace(t0, ' +', ' ', 'g') AS t FROM events)")
def log_lines(spark, sf_dir):
    """Rows of all kinds, short and long, with shown tags that go and others that stay."""
    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("user_excerpt", "assistant_excerpt", "command", "read"))), (k % 4 + 1).cast("int"))
    tag = F.when(k % 5 == 0, F.concat(F.lit(" <dcp-id>m"), k.cast("string"), F.lit("</dcp-id>\n"))).when(k % 5 == 1, "<dcp-log a='b'>\t</dcp-log>").when(k % 5 == 2, " <dcp-note> ").otherwise("\r\n x")
    entry = F.struct(kind.alias("kind"), F.concat(F.lit(" "), "event_type", tag, "props", F.repeat(F.lit("\ny"), (k % 450).cast("int"))).alias("text"))
    return adapters.read(spark, sf_dir, "events").select("event_id", coverage.log_line(entry).alias("line"))


@register("id_lists", "SELECT o_custkey AS session_id, CASE WHEN count(*) > 8 THEN list_aggregate(list_slice(list('b' || o_orderkey ORDER BY o_orderkey), 1, 8), 'string_agg', ', ') || ' (+' || (count(*) - 8) || ' more)' ELSE string_agg('b' || o_orderkey, ', ' ORDER BY o_orderkey) END AS ids FROM orders GROUP BY 1")
def id_lists(spark, sf_dir):
    ids = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda i: F.concat(F.lit("b"), i.cast("string")))
    return adapters.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(ids.alias("i")).select("session_id", text.listed(F.col("i"), 8).alias("ids"))


@register("short_numbers", "SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 10000 THEN " + PLACE + " || 'k' WHEN n < 1000000 THEN (n + 500) // 1000 || 'k' ELSE '' END AS label FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 50 % 12000 ELSE CAST(floor(o_totalprice) AS BIGINT) % 1000000 END AS n FROM orders)")
def short_numbers(spark, sf_dir):
    n = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") * 50 % 12000).otherwise(F.floor("o_totalprice").cast("long") % 1000000)
    return adapters.read(spark, sf_dir, "orders").select("o_orderkey", tokens.short_number(n).alias("label"))


@register("placeholders", "SELECT event_id, event_type || ' ' || CASE WHEN event_id % 5 < 3 THEN '[Previously compressed: t' || event_id % 5 || ']' || chr(10) || props ELSE '(b' || event_id % 5 || ')' END || CASE WHEN event_id % 3 = 0 THEN '(b)' ELSE ' (b9' END || CASE WHEN event_id % 2 = 0 THEN '[Previously compressed: t' || event_id % 3 || ']' || chr(10) || CASE event_id % 3 WHEN event_id % 5 THEN props ELSE 's(b1)' END ELSE '(B1)' END AS text FROM events")
def placeholders(spark, sf_dir):
    """Blocks 0 to 2 are known; what a summary itself says stays as it is."""
    k = F.col("event_id")
    one = lambda i: F.struct(F.lit(i).alias("id"), F.lit(f"t{i}").alias("topic"), F.when(k % 5 == i, F.col("props")).otherwise("s(b1)").alias("summary"))
    text_ = F.concat("event_type", F.lit(" (b"), (k % 5).cast("string"), F.lit(")"), F.when(k % 3 == 0, "(b)").otherwise(" (b9"), F.when(k % 2 == 0, F.concat(F.lit("(b"), (k % 3).cast("string"), F.lit(")"))).otherwise("(B1)"))
    return adapters.read(spark, sf_dir, "events").select("event_id", refs.expand_placeholders(text_, F.array(*map(one, range(3)))).alias("text"))


@register("parsed_refs", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id + 100 END AS message, CASE WHEN event_id % 3 = 1 THEN event_id END AS block FROM events")
def parsed_refs(spark, sf_dir):
    k = F.col("event_id")
    ref = F.when(k % 3 == 0, F.concat(F.lit(" M"), (k + 100).cast("string"), F.lit(" "))).when(k % 3 == 1, F.concat(F.lit("B"), k.cast("string"))).otherwise("m1x")
    return adapters.read(spark, sf_dir, "events").select("event_id", refs.parse_message_ref(ref).alias("message"), refs.parse_block_ref(ref).alias("block"))


@register("compress_receipts", "WITH b AS (SELECT o_custkey AS session_id, o_orderkey AS id, o_orderkey % 4 AS c FROM orders), c AS (SELECT session_id, c, max(id) AS newest, string_agg('b' || id || ': ' || CASE WHEN id % 2 = 0 THEN 't' ELSE 'untitled' END, ', ' ORDER BY id) AS created FROM b WHERE id % 3 <> 0 GROUP BY 1, 2) SELECT session_id, 'k' || c || s AS call_id, newest = max(newest) OVER (PARTITION BY session_id, s) AS is_newest, created FROM c, (VALUES (''), ('|z')) t(s)")
def compress_receipts(spark, sf_dir):
    k = F.col("o_orderkey")
    made = adapters.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), k.alias("block_id"), F.lit(True).alias("active"), F.when(k % 2 == 0, "t").otherwise(" ").alias("topic"), F.concat(F.lit("k"), (k % 4).cast("string"), F.lit("|z")).alias("compress_call_id"))
    live = made.where("block_id % 3 <> 0").select("session_id", F.concat(F.lit("block:b"), F.col("block_id").cast("string")).alias("owner"))
    return payload.receipts(made, live).select("session_id", "call_id", "is_newest", "created")


@register("edit_line_stats", _with(E) + f"SELECT session_id, i, 1 AS edit_count, greatest({DELTA}, 0) AS added_lines, greatest(-{DELTA}, 0) AS removed_lines FROM e")
def edit_line_stats(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.col("event_id") % 97
    edit = F.struct(F.repeat(F.lit("x\n"), (k % 3).cast("int")).alias("old"), F.repeat(F.lit("x\r\n"), (k % 5).cast("int")).alias("new"))
    return adapters.read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.row_number().over(order) - 1).alias("i"), tools.edit_stats(F.array(edit)).alias("s")).select("session_id", "i", "s.*")


ANCHORED = """n AS (SELECT session_id, count(*) AS n FROM m GROUP BY 1),
b AS (SELECT session_id, k, (session_id * k) % n AS x, (session_id + 2 * k) % n AS y, CASE WHEN (session_id + k) % 4 = 0 THEN 'tail:x' WHEN (session_id + k) % 7 = 0 AND k > 1 THEN 'b' || k - 1 ELSE 's' || (session_id + 5 * k) % n END AS anchor, ((session_id + 3 * k) % n + 1) * 1000.0 AS due FROM n, range(1, 5) t(k)),
s(session_id, k, rows) AS (
  SELECT session_id, 0::BIGINT, list({'t': ts, 'key': 's' || ordinal} ORDER BY ordinal) FROM m GROUP BY 1
  UNION ALL
  SELECT session_id, k + 1, CASE WHEN lo IS NULL THEN rows WHEN anchor LIKE 'tail:%' THEN list_concat(rest, [made]) WHEN place IS NULL THEN
      [{'t': r.t, 'key': r.key} FOR r IN list_sort([{'t': r.t, 'i': i, 'key': r.key} FOR r, i IN list_concat(rest, [made])])]
    ELSE list_concat(list_concat(rest[:place - 1], [made]), rest[place:]) END
  FROM (SELECT *, list_position([r.key FOR r IN rest], anchor) AS place FROM (
    SELECT *, list_concat(rows[:lo - 1], rows[hi + 1:]) AS rest, {'t': CAST(due - 0.5 AS DOUBLE), 'key': 'b' || (k + 1)} AS made FROM (
      SELECT s.session_id, s.k, s.rows, b.anchor, b.due, CASE WHEN px > 0 AND py > 0 THEN least(px, py) END AS lo, CASE WHEN px > 0 AND py > 0 THEN greatest(px, py) END AS hi
      FROM (SELECT *, list_position([r.key FOR r IN s.rows], 's' || x) AS px, list_position([r.key FOR r IN s.rows], 's' || y) AS py FROM s JOIN b USING (session_id) WHERE b.k = s.k + 1) s JOIN b ON b.session_id = s.session_id AND b.k = s.k + 1))))"""


@register("anchored_splice", "WITH RECURSIVE " + M + ", " + ANCHORED + " SELECT session_id, i - 1 AS ordinal, rows[i].key AS item FROM (SELECT session_id, rows, unnest(range(1, len(rows) + 1)) AS i FROM s WHERE k = 4)")
def anchored_splice(spark, sf_dir):
    """Four blocks for each conversation, many of which overlap or stand in each other's ranges."""
    rows = adapters.messages(spark, sf_dir).withColumns({"source_key": transcript.owner_key(F.col("ordinal")), "calls": F.array().cast("array<string>"), "tool_call_id": F.lit(None).cast("string")})
    c, n, k = F.col("session_id"), F.col("n"), F.col("block_id")
    key = lambda i: F.concat(F.lit("s"), i.cast("string"))
    anchor = F.when((c + k) % 4 == 0, "tail:x").when(((c + k) % 7 == 0) & (k > 1), F.concat(F.lit("synth:block:b"), (k - 1).cast("string"))).otherwise(key((c + 5 * k) % n))
    made = rows.groupBy("session_id").agg(F.count("*").alias("n")).withColumn("block_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))))
    made = made.select("session_id", "block_id", key((c * k) % n).alias("start_key"), key((c + 2 * k) % n).alias("end_key"), anchor.alias("anchor_key"), (((c + 3 * k) % n + 1) * 1000).cast("double").alias("anchor_ts"), F.lit(True).alias("active"), F.lit("t").alias("topic"), F.concat(F.lit("Summary "), k.cast("string")).alias("summary"), F.lit(None).cast("double").alias("created_at"))
    shown, _ = splicing.spliced(rows, made, ("source_key",))
    return shown.select("session_id", "ordinal", F.coalesce(F.concat(F.lit("b"), F.col("block_id").cast("string")), "source_key").alias("item"))


@register("corpus_summary", """WITH l AS (SELECT user_id % 7 AS folder, user_id AS session_id, props AS raw, event_type IN ('view', 'error') AS snap, event_type = 'error' AND lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'view' AS marker FROM events),
  o AS (SELECT folder, session_id, count(*) AS n_lines, count(*) FILTER (WHERE snap) AS n_snapshots, count(*) FILTER (WHERE marker AND raw <> 'm') AS n_changed, count(*) FILTER (WHERE marker) AS n_markers, CAST(sum(strlen(raw) + 1) AS BIGINT) AS bytes_before, CAST(sum(CASE WHEN marker THEN 2 ELSE strlen(raw) + 1 END) AS BIGINT) AS bytes_after FROM l GROUP BY 1, 2)
  SELECT CASE GROUPING(folder, session_id) WHEN 0 THEN 'session' WHEN 1 THEN 'folder' ELSE 'corpus' END AS level, folder, session_id, count(*) AS n_sessions, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(n_snapshots) AS BIGINT) AS n_snapshots, CAST(sum(n_changed) AS BIGINT) AS n_changed, CAST(sum(n_markers) AS BIGINT) AS n_markers,
    CAST(sum(bytes_before) AS BIGINT) AS bytes_before, CAST(sum(bytes_after) AS BIGINT) AS bytes_after, CAST((20000 * (sum(bytes_before) - sum(bytes_after)) + sum(bytes_before)) // (2 * sum(bytes_before)) AS DOUBLE) / 100 AS saved_percent FROM o GROUP BY ROLLUP (folder, session_id)""")
def corpus_summary(spark, sf_dir):
    """Events as lines; an error after a view becomes a marker."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    marker = F.coalesce((F.col("event_type") == "error") & (before == "view"), F.lit(False))
    e = adapters.read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("folder"), F.col("user_id").alias("session_id"), F.col("props").alias("raw"), F.when(marker, "m").otherwise(F.col("props")).alias("new_raw"), F.col("event_type").isin("view", "error").alias("is_snapshot"), marker.alias("is_marker"))
    return persistence.corpus_summary(e)


@register("sql_spans", SQL["tool_spans"])
def sql_spans(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT session_id, lo, hi, kind, is_turn FROM session_spans(TABLE({rows}))", rows=adapters.agent_rows(spark, sf_dir)[0])


@register("sql_candidate_ranges", SQL["candidate_ranges_topk"])
def sql_candidate_ranges(spark, sf_dir):
    sql.register(spark)
    rows = adapters.messages(spark, sf_dir)
    return spark.sql(
        """SELECT * FROM candidate_ranges(TABLE(SELECT session_id, ordinal, CASE role WHEN 'system' THEN 'F' WHEN 'user' THEN 'R' ELSE 'T' END AS kind, concat('s', ordinal) AS ref, estimate_tokens(content) AS tokens FROM {rows}), 3)""",
        rows=rows,
    )


@register("sql_functions", f"SELECT event_id, {EST.format('props')} AS tokens, trim(event_type) || ' x' AS line, CASE WHEN length(props) > 9 THEN rtrim(substr(props, 1, 8)) || '…' ELSE props END AS short, 'm' || CASE WHEN event_id * 7 < 10000 THEN lpad(CAST(event_id * 7 AS VARCHAR), 4, '0') ELSE CAST(event_id * 7 AS VARCHAR) END AS ref, event_type || '::{{\"a\":' || event_id || ',\"b\":[1,{{\"y\":2,\"z\":1}}]}}' AS print, event_id // 8 * 8 AS bucket FROM events")
def sql_functions(spark, sf_dir):
    sql.register(spark)
    return spark.sql(
        """SELECT event_id, estimate_tokens(props) AS tokens, normalize_inline(concat('\t ', event_type, ' \n\u00A0 x ')) AS line, truncate_text(props, 9) AS short, format_ref(event_id * 7) AS ref,
        call_fingerprint(event_type, concat('{{"b": [1, {{"z": 1, "y": 2}}], "a": ', event_id, '}}')) AS print, turn_bucket(event_id, 8) AS bucket FROM {e}""",
        e=adapters.read(spark, sf_dir, "events"),
    )


REQUESTS = """q AS (SELECT session_id, g AS range_id, 1 + 4 * g + session_id % 2 AS a, 3 + 4 * g - (session_id + g) % 2 AS b FROM (SELECT DISTINCT session_id FROM e), range(0, 3) t(g)),
w AS (SELECT q.*, x.u AS xu, x.lost AS xl, y.u AS yu, CASE WHEN x.u THEN 2 * a WHEN x.lost THEN 2 * a + 1 ELSE 2 * a END AS lo, 2 * b + 1 AS hi, n.i AS next, n.u AS nu FROM q JOIN e x ON x.session_id = q.session_id AND x.i = a JOIN e y ON y.session_id = q.session_id AND y.i = b LEFT JOIN e n ON n.session_id = q.session_id AND n.i = b + 1 WHERE a <= b),
z AS (SELECT w.session_id, range_id, CAST(2 * count(*) - any_value(w.lo % 2) AS INT) AS n_rows, CAST(count(*) FILTER (WHERE e.u OR NOT e.lost) AS INT) AS n_log, CAST(count(*) FILTER (WHERE NOT e.u) AS INT) AS n_tools, count(*) FILTER (WHERE tool = 'read' AND NOT e.u AND NOT e.lost) AS reads, CAST(count(*) FILTER (WHERE tool = 'bash') AS INT) AS n_commands,
  CAST(coalesce(sum(CASE WHEN tool = 'edit' THEN 2 END), 0) AS BIGINT) AS edits FROM w JOIN e ON e.session_id = w.session_id AND e.i BETWEEN w.a AND w.b GROUP BY 1, 2)"""


@register("compressed_blocks", _with(E, REQUESTS) + f"""SELECT w.session_id, range_id, CAST(6 + row_number() OVER (PARTITION BY w.session_id ORDER BY range_id) AS BIGINT) AS block_id, lo, hi, lo * 10.0::DOUBLE AS start_ts, hi * 10.0::DOUBLE AS end_ts, 's' || lo AS start_source_key,
  CASE WHEN next IS NULL THEN 'tail:s' || hi ELSE 's' || (2 * next + CASE WHEN nu THEN 0 ELSE 1 END) END AS anchor_source_key, 'see [Previously compressed: old]' || chr(10) || 'before (b9)' AS summary, n_rows, n_log, n_tools, reads, n_commands, edits
  FROM w JOIN z USING (session_id, range_id)""")
def compressed_blocks(spark, sf_dir):
    """Up to three ranges of events a user, each a request of its own; a block of id 6 stands before all of them."""
    rows, calls = adapters.agent_rows(spark, sf_dir)
    g, c = F.col("range_id"), F.col("session_id")
    a, b = 1 + 4 * g + c % 2, 3 + 4 * g - (c + g) % 2
    place = rows.where(F.col("role").isin(*transcript.REF_ROLES)).select("session_id", F.floor(F.col("ordinal") / 2).alias("i"), "ordinal")
    asked = rows.select("session_id").distinct().withColumn("range_id", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumns({"a": a, "b": b}).where("a <= b")
    for side, at in (("start", "a"), ("end", "b")):
        asked = asked.join(place.select("session_id", F.col("i").alias(at), refs.format_ref(F.col("ordinal")).alias(f"{side}_ref")), ["session_id", at])
    asked = asked.select("session_id", g.cast("string").alias("request_id"), "range_id", "start_ref", "end_ref", F.lit(" t ").alias("topic"), F.lit("see (b6) (b9)").alias("summary"), F.lit("k").alias("call_id"))
    named = place.select("session_id", refs.format_ref(F.col("ordinal")).alias("ref"), "ordinal", F.lit(None).cast("long").alias("block_id"))
    old = rows.where("ordinal = 0").select("session_id", F.lit(6).cast("long").alias("block_id"), F.lit(True).alias("active"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit("old").alias("topic"), F.lit("before").alias("summary"))
    made, _, _ = transaction.compress(asked, rows, calls, named, old)
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda t, x: t + x[f]).cast("long")
    return made.select("session_id", "range_id", "block_id", "lo", "hi", "start_ts", "end_ts", "start_source_key", "anchor_source_key", "summary", F.size("covered_source_keys").alias("n_rows"), F.size("activity_log").alias("n_log"), F.size("covered_tool_ids").alias("n_tools"), total("file_reads", "count").alias("reads"), F.size("commands").alias("n_commands"), total("file_writes", "edit_count").alias("edits"))


@register("planning_hints", _with(M, "t AS (SELECT session_id, CASE WHEN count(*) >= 3 THEN list(ts ORDER BY ordinal DESC)[3] ELSE min(ts) END AS tail_start FROM m WHERE role IN ('user', 'assistant') GROUP BY 1)",
  "p AS (SELECT t.session_id, list('m' || lpad(CAST(ordinal AS VARCHAR), 4, '0') ORDER BY ordinal) AS ids FROM t JOIN m ON m.session_id = t.session_id AND m.role = 'user' AND m.ts >= t.tail_start GROUP BY 1)",
  f"k AS (SELECT m.session_id, ordinal, CASE WHEN role = 'system' OR ts >= tail_start THEN 'F' WHEN role = 'user' THEN 'R' ELSE 'T' END AS kind, {EST.format('content')} AS tokens FROM m JOIN t ON t.session_id = m.session_id)",
  "i AS (SELECT *, sum(CASE WHEN kind = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ordinal) AS isle FROM k)", "h AS (SELECT *, min(CASE WHEN kind = 'R' THEN ordinal END) OVER (PARTITION BY session_id, isle) AS lo, max(CASE WHEN kind = 'R' THEN ordinal END) OVER (PARTITION BY session_id, isle) AS hi FROM i WHERE kind <> 'F')",
  "g AS (SELECT session_id, lo, hi, CAST(sum(tokens) AS BIGINT) AS tokens FROM h WHERE ordinal BETWEEN lo AND hi GROUP BY session_id, isle, lo, hi)",
  "r AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY session_id) AS BIGINT) AS total, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY tokens DESC, lo) AS rank FROM g)",
  "x AS (SELECT session_id, 'Stale and compressible now (~' || any_value(total) || ' tokens total across ' || any_value(n) || CASE WHEN any_value(n) = 1 THEN ' stretch' ELSE ' stretches' END || CASE WHEN any_value(n) > 1 THEN '; showing top 1 by size' ELSE '' END || '):' || chr(10) || string_agg('- m' || lpad(CAST(lo AS VARCHAR), 4, '0') || CASE WHEN lo = hi THEN '' ELSE '..m' || lpad(CAST(hi AS VARCHAR), 4, '0') END || ' (~' || tokens || ' tokens)', chr(10) ORDER BY rank) AS text FROM r WHERE rank <= 1 GROUP BY 1)")
  + "SELECT t.session_id, concat_ws(chr(10), CASE WHEN ids IS NOT NULL THEN 'Protected hot tail starts at ' || ids[1] || '.' END, CASE WHEN ids IS NOT NULL THEN 'Do not use these as endId right now: messages ' || array_to_string(ids, ', ') || CASE WHEN t.session_id % 2 = 0 THEN '; blocks b2, b3' ELSE '' END || '.' WHEN t.session_id % 2 = 0 THEN 'Do not use these as endId right now: blocks b2, b3.' END, x.text) AS text FROM t LEFT JOIN p ON p.session_id = t.session_id LEFT JOIN x ON x.session_id = t.session_id")
def planning_hints(spark, sf_dir):
    """Users' rows have references; the last three turns are protected; in every second session two blocks end late."""
    rows = adapters.messages(spark, sf_dir)
    tails = transcript.tail_start(rows.where(F.col("role").isin(*transcript.TURN_ROLES)), 3)
    named = rows.where("role = 'user'").select("session_id", "ordinal", "ts", refs.format_ref(F.col("ordinal")).alias("ref"))
    old = tails.where("session_id % 2 = 0").select("session_id", F.explode(F.array(*map(F.lit, (3, 2, 1, 4)))).alias("block_id"), F.lit(1e9).alias("end_ts")).withColumns({"active": F.col("block_id") != 1, "end_ts": F.when(F.col("block_id") == 4, float("inf")).otherwise(F.col("end_ts"))})
    kind = F.when((F.col("role") == "system") | (F.col("ts") >= F.col("tail_start")), "F").when(F.col("role") == "user", "R").otherwise("T")
    stretches = rows.join(tails, "session_id").select("session_id", "ordinal", kind.alias("kind"), tokens.estimate(F.col("content")).alias("tokens"), refs.format_ref(F.col("ordinal")).alias("ref"))
    return hints.rendered(hints.protected(tails, named, old), coverage.candidate_ranges(stretches, 1), protected_ids=True)


@register("nudge_texts", "WITH n AS (SELECT event_id, event_id % 100 / 100.0 AS percent, event_id % 7 AS turn, event_id % 5 - 1 AS last_nudge, event_id % 3 - 1 AS last_compress FROM events), k AS (SELECT *, percent < 0.75 OR turn <= last_compress OR (last_nudge >= 0 AND turn - last_nudge < 2) AS quiet FROM n) SELECT event_id, CASE WHEN NOT quiet THEN 'emitted' WHEN percent < 0.75 THEN 'below_min_threshold' WHEN turn <= last_compress OR last_compress >= last_nudge THEN 'same_turn_or_post_compress_debounce' ELSE 'turn_debounce' END AS reason, CASE WHEN quiet THEN NULL WHEN percent > 0.9 THEN 80 WHEN event_id % 20 >= 15 THEN 60 ELSE 40 END AS priority, CASE WHEN NOT quiet THEN substr(CASE WHEN percent > 0.9 THEN 'Compress now: over DCP cleanup target (120k-9.9k tokens). Compress every' WHEN event_id % 20 >= 15 THEN 'DCP checkpoint (120k-9.9k tokens). After a long tool run, compress every' ELSE 'DCP checkpoint (120k-9.9k tokens). Compress every eligible stretch below — not' END, 1, 60) END AS head FROM k")
def nudge_texts(spark, sf_dir):
    k = F.col("event_id")
    config = DEFAULTS["compress"] | {"minContextTokens": 120_000, "maxContextTokens": 9_950}
    percent, turn, last_nudge, last_compress, none = k % 100 / 100.0, k % 7, k % 5 - 1, k % 3 - 1, F.lit(None).cast("double")
    kind = nudge.nudge_type(percent, none, turn, last_nudge, last_compress, k % 20, config)
    return adapters.read(spark, sf_dir, "events").select("event_id", nudge.nudge_reason(kind, percent, none, turn, last_nudge, last_compress, config).alias("reason"), nudge.priority(kind).alias("priority"), F.substring(nudge.header(kind, percent, none, config), 1, 60).alias("head"))


CALLS = "b AS (SELECT o_custkey AS session_id, o_orderkey AS id, o_orderkey % 4 AS c, CASE WHEN o_orderkey % 2 = 0 THEN 't' ELSE 'untitled' END AS topic FROM orders), c AS (SELECT session_id, c, max(id) AS newest, string_agg('b' || id || ': ' || topic, ', ' ORDER BY id) AS created, string_agg('{\"id\":\"b' || id || '\",\"topic\":\"' || topic || '\"}', ',' ORDER BY id) AS listed FROM b WHERE id % 3 <> 0 GROUP BY 1, 2), n AS (SELECT *, newest = max(newest) OVER (PARTITION BY session_id) AS is_newest FROM c)"
_BEFORE, _AFTER = payload.RECEIPT_TEXT.split("{0}")


@register("compress_payloads", _with(CALLS) + f"""SELECT s.session_id, s.c * 2 + k AS idx, CASE WHEN is_newest AND k = 0 THEN '{{"receiptOnly":true,"status":"succeeded","createdBlocks":[' || listed || '],"note":"{payload.RECEIPT_NOTE}"}}' WHEN is_newest THEN '{_BEFORE}' || created || '{_AFTER}' END AS receipt
  FROM (SELECT DISTINCT session_id, c FROM b) s, (VALUES (0), (1)) t(k) LEFT JOIN n ON n.session_id = s.session_id AND n.c = s.c WHERE coalesce(is_newest, true)""")
def compress_payloads(spark, sf_dir):
    """Each customer's compress calls and their outputs as a payload: of those whose blocks are live the newest stays, as receipts."""
    k = F.col("o_orderkey")
    made = adapters.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), k.alias("block_id"), F.lit(True).alias("active"), F.when(k % 2 == 0, "t").otherwise(" ").alias("topic"), F.concat(F.lit("k"), (k % 4).cast("string"), F.lit("|z")).alias("compress_call_id"))
    live = made.where("block_id % 3 <> 0").select("session_id", F.concat(F.lit("block:b"), F.col("block_id").cast("string")).alias("owner"))
    none = F.lit(None).cast("string")
    call = F.struct((F.col("c") * 2).alias("idx"), F.lit("function_call").alias("type"), F.lit("compress").alias("name"))
    out = F.struct((F.col("c") * 2 + 1).alias("idx"), F.lit("function_call_output").alias("type"), none.alias("name"))
    asked = made.select("session_id", (F.col("block_id") % 4).alias("c")).distinct().select("session_id", F.concat(F.lit("k"), F.col("c").cast("string")).alias("call_id"), F.explode(F.array(call, out)).alias("i"))
    items = asked.select("session_id", "i.*", "call_id", none.alias("role"), none.alias("text"), none.alias("internal_owner"))
    names = made.select("session_id", F.lit("m0000").alias("ref"), none.alias("owner")).distinct()
    return payload.filtered(items, live, names, made).select("session_id", "idx", "receipt")


@register("event_streams", "SELECT event_id AS capture_id, CAST(s AS INT) AS seq, CASE s WHEN 0 THEN event_id ELSE user_id END AS n FROM events, (VALUES (0), (4)) t(s) WHERE s = 0 OR event_id % 3 <> 0")
def event_streams(spark, sf_dir):
    """Bodies of two data lines with others between them; every third ends before the second."""
    body = F.concat(F.lit('data: {"n": '), F.col("event_id"), F.lit("}\r\n\r\nevent: x\ndata:  [DONE] \n"), F.when(F.col("event_id") % 3 == 0, F.lit('data: {"n": ')).otherwise(F.concat(F.lit('data:{"n":'), F.col("user_id"), F.lit("}\n: note"))))
    found = jsonl.sse_payloads(adapters.read(spark, sf_dir, "events").select(F.col("event_id").alias("capture_id"), body.alias("body")))
    return found.select("capture_id", "seq", F.try_variant_get("v", "$.n", "long").alias("n"))


@register("effective_contexts", "SELECT event_id, greatest(CASE WHEN event_id % 3 = 0 OR event_id % 10 = 7 THEN 0 ELSE event_id % 900 END, user_id)::DOUBLE AS tokens, CASE WHEN event_id % 4 > 0 THEN greatest(CASE WHEN event_id % 3 = 0 OR event_id % 10 = 7 THEN 0 ELSE event_id % 900 END, user_id) / (event_id % 4 * 100.0) END AS percent, least(greatest(event_id % 7 - 2, 0), 1)::DOUBLE AS ratio, CASE WHEN greatest(event_id % 9, event_id % 5 + 1) < 7 THEN greatest(event_id % 9, event_id % 5 + 1) ELSE event_id % 9 END AS kept_from, 'x y' AS spoken FROM events")
def effective_contexts(spark, sf_dir):
    k = F.col("event_id")
    host = F.when(k % 3 == 0, F.lit(None)).when(k % 10 == 7, float("nan")).otherwise((k % 900).cast("double"))
    size, percent = tokens.effective_context(host, F.col("user_id"), k % 4 * 100)
    part = lambda own, given: F.struct(own.cast("string").alias("text"), given.cast("string").alias("input"))
    parts = F.array(part(F.lit("x"), F.lit("not this")), part(F.lit(None), F.lit("y")), part(F.lit(""), F.lit(None)))
    return adapters.read(spark, sf_dir, "events").select("event_id", size.alias("tokens"), percent.alias("percent"), tokens.clamp_ratio((k % 7 - 2).cast("double")).alias("ratio"), compaction.first_kept(k % 9, k % 5, F.lit(7)).alias("kept_from"), text.spoken_text(parts).alias("spoken"))


def _entries(spark, sf_dir):
    """The agent's transcript as lines of a session log."""
    rows, calls = adapters.agent_rows(spark, sf_dir)
    named = rows.join(calls.select("session_id", "ordinal", F.struct(F.lit("toolCall").alias("type"), F.col("tool_call_id").alias("id"), F.col("tool_name").alias("name"), F.parse_json("arguments").alias("arguments")).alias("_call")), ["session_id", "ordinal"], "left")
    said = F.struct("role", F.col("content"), F.col("tool_call_id").alias("toolCallId"), F.col("is_error").alias("isError"), F.col("ts").alias("timestamp"))
    asked = F.struct("role", F.array("_call").alias("content"), F.col("ts").alias("timestamp"))
    own = F.when(F.col("role") == "custom_message", F.to_json(F.struct(F.lit("custom_message").alias("type"), "content"))).when(F.col("_call").isNotNull(), F.to_json(F.struct(F.lit("message").alias("type"), asked.alias("message")))).otherwise(F.to_json(F.struct(F.lit("message").alias("type"), said.alias("message"))))
    return jsonl.entries(named.select("session_id", F.col("ordinal").alias("pos"), own.alias("raw")))


#: Calls alike in name and arguments; without arguments those that have lost their call.
PRINT = "CASE WHEN lost THEN 'lost' WHEN tool = 'read' AND k % 3 <> 0 THEN 'r' || k WHEN tool = 'read' THEN 'r' || k % 7 || '-' || k % 4 WHEN tool = 'bash' THEN 'b' || k % 6 WHEN tool = 'edit' THEN 'e' || event_id ELSE 'g' || k END"


@register("replayed_states", _with(E, f"p AS (SELECT *, {PRINT} AS print, event_type = 'error' AS failed, count(*) OVER (PARTITION BY session_id) + count(*) FILTER (WHERE lost) OVER (PARTITION BY session_id) AS turns FROM e)",
  "d AS (SELECT *, row_number() OVER (PARTITION BY session_id, print ORDER BY i DESC) > 1 AS old FROM p WHERE NOT u)",
  "g AS (SELECT session_id, list(CASE WHEN lost THEN 'x' || call ELSE call END ORDER BY CASE WHEN lost THEN 'x' || call ELSE call END) AS ids FROM d WHERE (old AND tool <> 'edit') OR (failed AND turns >= 4) GROUP BY 1)")
  + "SELECT CAST(p.session_id AS VARCHAR) AS session_id, any_value(turns) AS turns, 2 * count(*) AS n_messages, count(*) FILTER (WHERE NOT u) AS n_tool_calls, coalesce(any_value(ids), []) AS pruned_tool_ids FROM p LEFT JOIN g ON g.session_id = p.session_id GROUP BY p.session_id")
def replayed_states(spark, sf_dir):
    """Users' transcripts as session logs, replayed: without a compress call all calls are dated 0, so the last pass prunes
    every repeated result but the last and, after four turns, all failed ones."""
    return replay.replay(replay.entry_events(_entries(spark, sf_dir))).select("session_id", "turns", "n_messages", "n_tool_calls", "pruned_tool_ids")
