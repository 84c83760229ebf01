"""Registered queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.config import DEFAULTS
from threadloom.functions import refs, text, tokens
from threadloom.operators import branches, compaction, coverage, nudge, payload, persistence, pruning, transcript, usage
from threadloom.plans.context import context_pass
from threadloom.sources import adapters

# ruff: noqa: E501 - queries are listed with their SQL


def _log(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return pruning.prune_log(adapters.tool_log(spark, sf_dir), **options)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.messages(spark, sf_dir)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return _messages(spark, sf_dir).withColumn("source_key", transcript.source_key(none, F.col("ts"), F.col("role"), none, F.col("ordinal")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens saved in each session by dropping repeated and stale tool outputs."""
    return pruning.savings(_log(spark, sf_dir, cadence=5))


LOG = """log AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn_index, count(*) OVER (PARTITION BY user_id) AS current_turn,
         CAST(event_id AS VARCHAR) AS tool_call_id, event_type AS tool_name, props, event_type = 'error' AS is_error FROM events
), marked AS (
  SELECT *, {bucket} AS bucket, turn_index < {bucket} AS may FROM log
), pruned AS (
  SELECT *, may AND row_number() OVER (PARTITION BY session_id, tool_name, props, may ORDER BY turn_index DESC, tool_call_id DESC) > 1 AS duplicate,
         is_error AND bucket - turn_index >= 4 AS stale FROM marked
), shown AS (
  SELECT *, CASE WHEN (duplicate OR stale) AND is_error THEN '[Error output removed - tool failed more than N turns ago]'
                 WHEN duplicate OR stale THEN '[Output removed to save context - information superseded or no longer needed]' ELSE props END AS visible FROM pruned
)"""
M = """m AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, role, text AS content, CAST((turn + 1) * 1000 AS DOUBLE) AS ts FROM conversations)"""
B = """b AS (
  SELECT e.session_id, s.block_id, s.lo, s.hi, 'topic ' || s.block_id AS topic, 'Summary of section ' || s.block_id || '.' AS summary
  FROM (SELECT session_id, max(ordinal) AS last FROM m GROUP BY 1) e, (VALUES (1, 1, 3), (2, 5, 6)) s(block_id, lo, hi) WHERE s.hi <= e.last)"""
EST = "CAST(floor(length({0}) / 4.0 + 0.5) AS BIGINT)"
FLAT = "translate({0}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def log_sql(select: str, bucket: str = "CAST(floor(current_turn / 5) * 5 AS BIGINT)") -> str:
    return _with(LOG.format(bucket=bucket)) + select


QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


register("flagship_savings", log_sql(f"SELECT session_id, count(*) FILTER (WHERE duplicate) AS n_duplicate, count(*) FILTER (WHERE stale) AS n_stale, CAST(sum({EST.format('props')}) AS BIGINT) AS tokens, CAST(sum(CASE WHEN duplicate OR stale THEN greatest({EST.format('props')} - {EST.format('visible')}, 0) ELSE 0 END) AS BIGINT) AS tokens_saved FROM shown GROUP BY 1"))(flagship)


@register("dedup_keep_last", log_sql("SELECT session_id, tool_call_id FROM shown WHERE duplicate", "current_turn"))
def dedup_keep_last(spark, sf_dir):
    return _log(spark, sf_dir).where("duplicate").select("session_id", "tool_call_id")


@register("error_purge_cadence", log_sql("SELECT session_id, tool_call_id, turn_index, CASE CAST(tool_call_id AS BIGINT) % 4 WHEN 0 THEN 'edit' WHEN 1 THEN 'write' WHEN 2 THEN 'compress' ELSE 'read' END AS tool_name FROM shown WHERE stale AND CAST(tool_call_id AS BIGINT) % 8 <> 3"))
def error_purge_cadence(spark, sf_dir):
    """Failed edits, writes and summaries go stale like others; one tool is spared."""
    k = F.col("tool_call_id").cast("long")
    tool = F.when(k % 8 == 3, "spared").when(k % 4 == 0, "edit").when(k % 4 == 1, "write").when(k % 4 == 2, "compress").otherwise("read")
    log = pruning.prune_log(adapters.tool_log(spark, sf_dir).withColumn("tool_name", tool), cadence=5, protected=("spared",))
    return log.where("stale").select("session_id", "tool_call_id", "turn_index", "tool_name")


@register("tombstoned_log", log_sql("SELECT session_id, tool_call_id, duplicate OR stale AS pruned, visible FROM shown"))
def tombstoned_log(spark, sf_dir):
    return _log(spark, sf_dir, cadence=5).select("session_id", "tool_call_id", "pruned", "visible")


@register("turn_buckets", "SELECT bucket, count(*) AS n FROM (SELECT CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 8) * 8 AS BIGINT) AS bucket FROM events) GROUP BY 1")
def turn_buckets(spark, sf_dir):
    return adapters.tool_log(spark, sf_dir).groupBy(pruning.bucket(F.col("turn_index"), 8).alias("bucket")).agg(F.count("*").alias("n"))


@register("tool_usage", "SELECT user_id AS session_id, event_type AS tool_name, count(*) AS calls, count(DISTINCT props) AS distinct_calls, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1, 2")
def tool_usage(spark, sf_dir):
    return adapters.tool_log(spark, sf_dir).groupBy("session_id", "tool_name").agg(F.count("*").alias("calls"), F.count_distinct("arguments").alias("distinct_calls"), F.count_if("is_error").alias("errors"))


@register("logical_turns", "SELECT conv_id AS session_id, count(*) FILTER (WHERE role IN ('user', 'assistant', 'toolResult', 'bashExecution')) AS turns FROM conversations GROUP BY 1")
def logical_turns(spark, sf_dir):
    return _messages(spark, sf_dir).groupBy("session_id").agg(F.count_if(F.col("role").isin(*transcript.TURN_ROLES)).alias("turns"))


@register("source_keys", _with(M) + "SELECT session_id, ordinal, 'msg:' || CAST(CAST(ts AS BIGINT) AS VARCHAR) || ':' || role || ':' || ordinal AS source_key, 's' || ordinal AS owner FROM m")
def source_keys(spark, sf_dir):
    return _keyed(spark, sf_dir).select("session_id", "ordinal", "source_key", transcript.owner_key(F.col("ordinal")).alias("owner"))


@register("visible_refs", _with(M) + "SELECT session_id, ordinal, n AS ref_index, 'm' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS ref FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS n FROM m WHERE role IN ('user', 'toolResult', 'bashExecution'))")
def visible_refs(spark, sf_dir):
    return transcript.visible_refs(_keyed(spark, sf_dir)).select("session_id", "ordinal", "ref_index", "ref")


@register("legacy_refs", _with(M) + "SELECT session_id, ordinal, 'm' || lpad(CAST(n AS VARCHAR), 3, '0') AS legacy FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS n FROM m WHERE role IN ('user', 'toolResult', 'bashExecution')) WHERE n <= 999")
def legacy_refs(spark, sf_dir):
    return transcript.visible_refs(_keyed(spark, sf_dir)).select("session_id", "ordinal", refs.legacy_ref(F.col("ref_index")).alias("legacy")).where("legacy is not null")


@register("tagged_messages", _with(M) + "SELECT m.session_id, m.ordinal, CASE WHEN n IS NULL THEN content ELSE content || chr(10) || chr(10) || '<dcp-id>m' || lpad(CAST(n AS VARCHAR), 4, '0') || '</dcp-id>' END AS content FROM m LEFT JOIN (SELECT session_id, ordinal, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS n FROM m WHERE role = 'user') r ON m.session_id = r.session_id AND m.ordinal = r.ordinal")
def tagged_messages(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    named = transcript.visible_refs(rows).select("session_id", "ordinal", "ref")
    return rows.join(named, ["session_id", "ordinal"], "left").select("session_id", "ordinal", refs.with_ref(F.col("role"), F.col("content"), F.col("ref")).alias("content"))


TURNS = "t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal DESC) AS n FROM m WHERE role IN ('user', 'assistant'))"


@register("protected_tail_start", _with(M, TURNS) + "SELECT session_id, coalesce(max(ts) FILTER (WHERE n = 4), arg_min(ts, ordinal)) AS tail_start FROM t GROUP BY 1")
def protected_tail_start(spark, sf_dir):
    return transcript.tail_start(_messages(spark, sf_dir).where(F.col("role").isin(*transcript.TURN_ROLES)), 4)


@register("token_estimates", _with(M) + f"SELECT session_id, CAST(sum({EST.format('content')}) AS BIGINT) AS tokens FROM m GROUP BY 1")
def token_estimates(spark, sf_dir):
    return _messages(spark, sf_dir).groupBy("session_id").agg(F.sum(tokens.estimate(F.col("content"))).alias("tokens"))


PAIRS = "WITH c AS (SELECT o_orderkey % 50 AS session_id, o_orderkey % 1000 AS call_id FROM orders WHERE o_orderstatus <> 'F'), r AS (SELECT l_orderkey % 50 AS session_id, l_orderkey % 1000 + CASE WHEN l_linenumber = 7 THEN 500 ELSE 0 END AS call_id, l_linenumber AS line FROM lineitem) "


@register("orphan_results", PAIRS + "SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = r.session_id AND c.call_id = r.call_id)")
def orphan_results(spark, sf_dir):
    return pruning.orphan_results(*adapters.call_pairs(spark, sf_dir)).select("session_id", "call_id", "line")


@register("orphan_calls", PAIRS + "SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE c.session_id = r.session_id AND c.call_id = r.call_id)")
def orphan_calls(spark, sf_dir):
    return pruning.orphan_calls(*adapters.call_pairs(spark, sf_dir)).select("session_id", "call_id")


@register("live_owner_keys", _with(M, B) + "SELECT session_id, 's' || ordinal AS owner FROM m WHERE role IN ('user', 'assistant') AND NOT EXISTS (SELECT 1 FROM b WHERE b.session_id = m.session_id AND m.ordinal BETWEEN b.lo AND b.hi) UNION ALL SELECT session_id, 'block:b' || block_id FROM b")
def live_owner_keys(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    made = adapters.blocks(rows)
    return coverage.live_owners(rows, coverage.covered_rows(rows, made), made, F.col("role").isin(*transcript.TURN_ROLES))


BLOCK_TEXT = "'[Compressed section: ' || topic || ']' || chr(10)||chr(10)||chr(10)||chr(10) || summary || chr(10)||chr(10)"
SPLICED = f"""spliced AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY place) - 1 AS ordinal, role, content, block_id FROM (
    SELECT session_id, ordinal AS place, role, content, NULL AS block_id FROM m WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.session_id = m.session_id AND m.ordinal BETWEEN b.lo AND b.hi)
    UNION ALL SELECT session_id, lo, 'user', {BLOCK_TEXT}, block_id FROM b))"""


@register("block_splice", _with(M, B, SPLICED) + "SELECT session_id, ordinal, role, content, block_id FROM spliced")
def block_splice(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    return coverage.spliced(rows, adapters.blocks(rows)).select("session_id", "ordinal", "role", "content", "block_id")


@register("context_pass", _with(M, B, SPLICED) + "SELECT s.session_id, s.ordinal, s.role, CASE WHEN ref IS NULL THEN content ELSE content || chr(10) || chr(10) || '<dcp-id>' || ref || '</dcp-id>' END AS content, block_id, ref FROM spliced s LEFT JOIN (SELECT session_id, ordinal, 'm' || lpad(CAST(row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS VARCHAR), 4, '0') AS ref FROM spliced WHERE role = 'user') r ON s.session_id = r.session_id AND s.ordinal = r.ordinal")
def context_pass_query(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    return context_pass(rows, adapters.blocks(rows))


@register("block_savings", _with(M, B) + f"SELECT *, greatest(removed - added, 0) AS saved FROM (SELECT b.session_id, b.block_id, CAST(sum({EST.format('content')}) AS BIGINT) AS removed, any_value({EST.format('(' + BLOCK_TEXT + ')')}) AS added FROM b JOIN m ON m.session_id = b.session_id AND m.ordinal BETWEEN b.lo AND b.hi GROUP BY 1, 2)")
def block_savings(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    return coverage.block_savings(rows, adapters.blocks(rows))


@register("block_detail_tiers", "SELECT o_custkey AS session_id, o_orderkey AS block_id, CASE WHEN n <= 4 THEN 'full' WHEN n <= 12 THEN 'compact' ELSE 'minimal' END AS detail FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)")
def block_detail_tiers(spark, sf_dir):
    made = adapters.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("block_id"), F.lit(True).alias("active"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double").alias("created_at"))
    return coverage.detail_levels(made).select("session_id", "block_id", "detail")


KINDS = f"k AS (SELECT session_id, ordinal, CASE role WHEN 'system' THEN 'F' WHEN 'user' THEN 'R' ELSE 'T' END AS kind, {EST.format('content')} AS tokens, 's' || ordinal AS ref FROM m)"


@register("candidate_ranges_topk", _with(M, KINDS, "i AS (SELECT *, sum(CASE WHEN kind = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ordinal) AS isle FROM k)", "h AS (SELECT *, min(CASE WHEN kind = 'R' AND tokens > 0 THEN ordinal END) OVER (PARTITION BY session_id, isle) AS lo, max(CASE WHEN kind = 'R' AND tokens > 0 THEN ordinal END) OVER (PARTITION BY session_id, isle) AS hi FROM i WHERE kind <> 'F')", "g AS (SELECT session_id, isle, 's' || lo AS start_ref, 's' || hi AS end_ref, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n_spans FROM h WHERE ordinal BETWEEN lo AND hi GROUP BY session_id, isle, lo, hi HAVING sum(tokens) > 0)", "r AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY session_id) AS BIGINT) AS all_tokens, count(*) OVER (PARTITION BY session_id) AS all_ranges, row_number() OVER (PARTITION BY session_id ORDER BY tokens DESC, start_ref) AS rank FROM g)") + "SELECT session_id, start_ref, end_ref, tokens, n_spans, all_tokens, all_ranges, rank FROM r WHERE rank <= 3")
def candidate_ranges_topk(spark, sf_dir):
    kind = F.when(F.col("role") == "system", "F").when(F.col("role") == "user", "R").otherwise("T")
    rows = _messages(spark, sf_dir).select("session_id", "ordinal", kind.alias("kind"), tokens.estimate(F.col("content")).alias("tokens"), transcript.owner_key(F.col("ordinal")).alias("ref"))
    return coverage.candidate_ranges(rows, 3)


@register("supersession", _with(M, B) + "SELECT session_id, 1 AS range_id, block_id, CASE WHEN 0 <= lo AND hi <= 5 THEN 'supersedes' ELSE 'partial-overlap' END AS relation FROM b WHERE lo <= 5")
def supersession(spark, sf_dir):
    made = adapters.blocks(_messages(spark, sf_dir))
    new = made.select("session_id").distinct().select("session_id", F.lit(1).alias("range_id"), F.lit(0).alias("lo"), F.lit(5).alias("hi"))
    return coverage.overlapping(new, made)


@register("anchor_asof", _with(M, B) + "SELECT b.session_id, b.block_id AS range_id, coalesce('s' || min(m.ordinal), 'tail:s' || b.hi) AS anchor FROM b LEFT JOIN m ON m.session_id = b.session_id AND m.role = 'user' AND m.ordinal > b.hi GROUP BY b.session_id, b.block_id, b.hi")
def anchor_asof(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    ranges = adapters.blocks(rows).select("session_id", F.col("block_id").alias("range_id"), "hi", transcript.owner_key(F.col("hi")).alias("end_key"))
    own = rows.where("role = 'user'").select("session_id", "ordinal", transcript.owner_key(F.col("ordinal")).alias("source_key"))
    return coverage.anchors(ranges, own)


ITEMS = """items AS (SELECT session_id, ordinal AS idx, CASE WHEN ordinal % 5 = 3 THEN NULL ELSE role END AS role, CASE WHEN ordinal % 5 = 3 THEN 'reasoning' ELSE 'message' END AS type FROM m),
own AS (SELECT *, CASE WHEN role IN ('user', 'assistant') THEN 's' || idx END AS owner FROM items),
seg AS (SELECT *, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM own),
near AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN owner END IGNORE NULLS) OVER (PARTITION BY session_id, seg ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
                   first_value(CASE WHEN role = 'assistant' THEN owner END IGNORE NULLS) OVER (PARTITION BY session_id, seg ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM seg),
dec AS (SELECT *, CASE WHEN type = 'reasoning' THEN coalesce(next, prev) ELSE owner END AS deciding FROM near)"""


@register("payload_filter", _with(M, B, ITEMS) + "SELECT session_id, idx, type, deciding FROM dec WHERE deciding IS NULL OR (role = 'user' AND idx % 3 = 2) OR NOT EXISTS (SELECT 1 FROM b WHERE b.session_id = dec.session_id AND CAST(substr(deciding, 2) AS BIGINT) BETWEEN b.lo AND b.hi)")
def payload_filter(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    made = adapters.blocks(rows)
    live = coverage.live_owners(rows, coverage.covered_rows(rows, made), made, F.col("role").isin(*transcript.TURN_ROLES))
    thought = F.col("ordinal") % 5 == 3
    own = transcript.owner_key(F.col("ordinal"))
    items = rows.select(
        "session_id", F.col("ordinal").alias("idx"), F.when(~thought, F.col("role")).alias("role"), F.when(thought, "reasoning").otherwise("message").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("call_id"),
        F.when(F.col("role") == "user", F.concat("content", F.lit("\n\n"), refs.ref_tag(refs.format_ref(F.col("ordinal"))))).otherwise(F.col("content")).alias("text"), F.when((F.col("role") == "assistant") & ~thought, own).alias("internal_owner"),
    )
    # every third text begins like a summary: those of users stay, others go with their owner; after a blank it is none
    items = items.withColumn("text", F.when(F.col("idx") % 3 == 2, F.concat(F.lit(payload.SUMMARY_PREFIX), "text")).when(F.col("idx") % 3 == 1, F.concat(F.lit(" " + payload.SUMMARY_PREFIX), "text")).otherwise(F.col("text")))
    named = rows.select("session_id", refs.format_ref(F.col("ordinal")).alias("ref"), own.alias("owner"))
    return payload.filtered(items, live, named).select("session_id", "idx", "type", "deciding")


NUDGE = "n AS (SELECT session_id, ordinal AS turn, sum(length(content)) OVER (PARTITION BY session_id ORDER BY ordinal) / 2000.0 AS percent FROM m)"


@register("nudge_gate", _with(M, NUDGE) + "SELECT session_id, turn, CASE WHEN percent < 0.75 OR turn <= 1 THEN NULL WHEN percent > 0.9 THEN 'context-soft' WHEN turn >= 15 THEN 'iteration' ELSE 'turn' END AS nudge FROM n")
def nudge_gate(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("ordinal")
    rows = _messages(spark, sf_dir).select("session_id", F.col("ordinal").alias("turn"), (F.sum(F.char_length("content")).over(w) / 2000.0).alias("percent"))
    kind = nudge.nudge_type(F.col("percent"), F.lit(None).cast("double"), F.col("turn"), F.lit(-1), F.lit(1), F.col("turn"), DEFAULTS["compress"])
    return rows.select("session_id", "turn", kind.alias("nudge"))


@register("nudge_debounce", "WITH RECURSIVE " + M + ", w AS (SELECT session_id, ordinal AS turn FROM m WHERE role = 'user'), s(session_id, turn) AS (SELECT session_id, min(turn) FROM w GROUP BY 1 UNION ALL SELECT s.session_id, (SELECT min(w.turn) FROM w WHERE w.session_id = s.session_id AND w.turn >= s.turn + 3) AS turn FROM s WHERE EXISTS (SELECT 1 FROM w WHERE w.session_id = s.session_id AND w.turn >= s.turn + 3)) SELECT session_id, CAST(turn AS BIGINT) AS turn FROM s")
def nudge_debounce(spark, sf_dir):
    passes = _messages(spark, sf_dir).select("session_id", F.col("ordinal").cast("bigint").alias("turn"), (F.col("role") == "user").alias("wanted"))
    return nudge.debounced(passes, 3).select("session_id", F.explode("turns").alias("turn"))


@register("toolcalls_since_user", _with(M) + "SELECT session_id, count(*) FILTER (WHERE role = 'toolResult' AND ordinal > coalesce(last, -1)) AS calls_since_user FROM (SELECT session_id, ordinal, CASE WHEN role = 'assistant' THEN 'toolResult' ELSE role END AS role, max(CASE WHEN role = 'user' THEN ordinal END) OVER (PARTITION BY session_id) AS last FROM m) GROUP BY 1")
def toolcalls_since_user(spark, sf_dir):
    rows = _messages(spark, sf_dir).withColumn("role", F.when(F.col("role") == "assistant", "toolResult").otherwise(F.col("role")))
    return transcript.calls_since_user(rows)


INLINE = f"trim(regexp_replace({FLAT.format('text')}, ' +', ' ', 'g'))"


@register("excerpt_normalized", f"SELECT doc_id, CASE WHEN length(t) > 80 THEN rtrim(substr(t, 1, 79)) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, {INLINE} AS t FROM documents)")
def excerpt_normalized(spark, sf_dir):
    return adapters.read(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text"), 80).alias("excerpt"))


@register("text_stripped", "SELECT doc_id, CASE k WHEN 0 THEN ' ' WHEN 1 THEN '<dcp-id>a<b</dcp-id>' WHEN 2 THEN '  ' WHEN 3 THEN 'x ' WHEN 4 THEN '<DCP-ID>m1</DCP-ID>' ELSE '<dcp-owner></dcp-id>' END || substr(text, 1, n) || CASE WHEN k % 2 = 0 THEN ' ' ELSE '</dcp-lo>' END || substr(text, n + 1) AS stripped, CASE k WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'x' WHEN 4 THEN '' ELSE '' END || substr(text, 1, n) || substr(text, n + 1) AS cleaned FROM (SELECT doc_id, text, doc_id % 6 AS k, doc_id % 97 AS n FROM documents WHERE doc_id % 6 <> 3 OR doc_id % 2 = 1)")
def text_stripped(spark, sf_dir):
    """Documents with tags of many sorts before and inside them: shown ones become blanks, whatever looks like a tag is made up."""
    docs = adapters.read(spark, sf_dir, "documents")
    k, n = F.col("doc_id") % 6, (F.col("doc_id") % 97).cast("int")
    before = F.element_at(F.array(*map(F.lit, ("<dcp-id>m1</dcp-id>", "<dcp-id>a<b</dcp-id>", "<dcp-owner>s1</dcp-owner><dcp-block-id></dcp-block-id>", "x<agent-summary>", "<DCP-ID>m1</DCP-ID>", "<dcp-owner></dcp-id>"))), (k + 1).cast("int"))
    inside = F.when(k % 2 == 0, "<dcp-log a>").otherwise("</dcp-lo>")
    shown = F.concat(before, F.col("text").substr(F.lit(1), n), inside, F.col("text").substr(n + 1, F.length("text")))
    # made-up tags hold no document text: pairs are closed before it begins
    made_up = F.concat(F.regexp_replace(before, "<agent-summary>", ""), F.col("text").substr(F.lit(1), n), F.lit("</dcp-x>"), F.col("text").substr(n + 1, F.length("text")))
    return docs.where("doc_id % 6 <> 3 or doc_id % 2 = 1").select("doc_id", text.strip_metadata(shown).alias("stripped"), text.strip_hallucinated(made_up).alias("cleaned"))


@register("line_counts", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split_regex(text, '\\r?\\n')) END AS lines FROM documents")
def line_counts(spark, sf_dir):
    return adapters.read(spark, sf_dir, "documents").select("doc_id", text.line_count(F.col("text")).alias("lines"))


@register("usage_last_wins", "SELECT user_id AS capture_id, CASE WHEN user_id % 2 = 0 THEN 'anthropic' ELSE 'openai' END AS provider, CAST(CASE WHEN user_id % 2 = 0 THEN arg_max(event_id, seq) FILTER (WHERE event_type = 'click') ELSE (arg_max(struct_pack(v := CASE WHEN event_type = 'click' THEN event_id END), seq) FILTER (WHERE event_type IN ('click', 'view'))).v END AS BIGINT) AS input_tokens FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) GROUP BY 1, 2")
def usage_last_wins(spark, sf_dir):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    none = F.lit(None).cast("long")
    rows = adapters.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("capture_id"), seq.alias("seq"), F.when(F.col("user_id") % 2 == 0, "anthropic").otherwise("openai").alias("provider"),
        F.when(F.col("event_type") == "click", F.col("event_id")).alias("input_tokens"), F.when(F.col("event_type") == "view", F.col("event_id")).alias("output_tokens"), none.alias("cache_read_tokens"), none.alias("cache_write_tokens"),
    )
    return usage.merged_usage(rows).select("capture_id", "provider", "input_tokens")


@register("request_report", "SELECT conv_id AS capture_id, role AS component, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(floor(sum(length(text)) / 4.0 + 0.5) AS BIGINT) AS tokens FROM conversations GROUP BY 1, 2")
def request_report(spark, sf_dir):
    parts = adapters.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("capture_id"), F.col("role").alias("component"), F.col("text").alias("json"))
    return usage.component_report(parts).drop("percent")


@register("hidden_coverage", _with(M, B) + "SELECT session_id, count(*) AS hidden, count(*) FILTER (WHERE c) AS covered, count(*) FILTER (WHERE c) / count(*) AS ratio FROM (SELECT m.session_id, EXISTS (SELECT 1 FROM b WHERE b.session_id = m.session_id AND m.ordinal BETWEEN b.lo AND b.hi) AS c FROM m WHERE m.ordinal < 4) GROUP BY 1")
def hidden_coverage(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    return compaction.hidden_coverage(rows.where("ordinal < 4"), coverage.covered_rows(rows, adapters.blocks(rows)), 1.0)


@register("represented_blocks", _with(M, B) + "SELECT session_id, block_id FROM b WHERE hi < 6")
def represented_blocks(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    return compaction.represented(coverage.covered_rows(rows, adapters.blocks(rows)), rows.where("ordinal < 6"))


QUOTES = f"""t AS (SELECT session_id, ordinal, role, trim(regexp_replace({FLAT.format('content')}, ' +', ' ', 'g')) AS t FROM m),
l AS (SELECT session_id, ordinal, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS i, length('- ' || role || ': ' || CASE WHEN t = '' THEN '(no text content)' WHEN length(t) > 420 THEN rtrim(substr(t, 1, 419)) || '…' ELSE t END) AS n FROM t),
s(session_id, i, kept, chars) AS (
  SELECT DISTINCT session_id, 0::BIGINT, []::INTEGER[], 0::BIGINT FROM l
  UNION ALL
  SELECT s.session_id, s.i + 1, CASE WHEN len(kept) < 6 AND chars + n <= 900 THEN list_append(kept, CAST(ordinal AS INTEGER)) ELSE kept END, CASE WHEN len(kept) < 6 AND chars + n <= 900 THEN chars + n ELSE chars END FROM s JOIN l ON l.session_id = s.session_id AND l.i = s.i + 1)"""


@register("excerpt_budget", "WITH RECURSIVE " + M + ", " + QUOTES + " SELECT session_id, kept, CAST(chars AS INTEGER) AS chars, CAST(i AS INTEGER) AS uncovered, CAST(len(kept) AS INTEGER) AS rendered, CAST(i - len(kept) AS INTEGER) AS truncated FROM s QUALIFY i = max(i) OVER (PARTITION BY session_id)")
def excerpt_budget(spark, sf_dir):
    return compaction.excerpts(_messages(spark, sf_dir), most_rows=6, most_chars=900)


@register("summary_demotion")
def summary_demotion(spark, sf_dir):
    """Lines of a part as blocks; times of creation run against ids, every fifth has none."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = adapters.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("session_id"), k.alias("block_id"), F.when(k % 5 > 0, -(k % 1000).cast("double")).alias("created_at"), (F.col("l_quantity") * 8 * (F.col("l_partkey") % 7 + 1)).cast("int").alias("full_length"))
    rows = rows.withColumns({"compact_length": F.floor(F.col("full_length") / 3).cast("int"), "archived_length": F.floor(F.col("full_length") / 12).cast("int")})
    return compaction.demoted(rows, 1500)


@register("native_summaries")
def native_summaries(spark, sf_dir):
    """Users' events as blocks of texts of all sorts: what their histories are summarised to within a small budget."""
    e, k = adapters.read(spark, sf_dir, "events"), F.col("event_id")
    log = F.when(k % 4 == 0, F.array(F.struct(F.lit("read").alias("kind"), F.concat(F.lit("f"), k.cast("string")).alias("text")))).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    summary = F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("Did "), "event_type", F.lit(" 😀. Then "), "props", F.repeat(F.lit(" more"), (k % 40).cast("int"))))
    made = e.select(F.col("user_id").alias("session_id"), k.alias("block_id"), F.when(k % 6 > 0, (k * 7919 % 10007).cast("double")).alias("created_at"), F.concat(F.lit('a "b"  '), "event_type").alias("topic"), summary.alias("summary"), log.alias("activity_log"))
    before = F.when(F.col("session_id") % 3 == 0, F.concat(F.lit("Notes of the user. "), F.repeat(F.lit("x y "), F.col("session_id").cast("int") * 3), F.lit('\n<dcp-summary version="1">\nold\n</dcp-summary>\n'))).when(F.col("session_id") % 3 == 1, '<dcp-summary version="1">old</dcp-summary>')
    sessions = made.select("session_id").distinct().withColumn("previous_summary", before)
    own = e.select(F.col("user_id").alias("session_id"), "event_type", F.concat(F.lit("f"), (k % 5).cast("string")).alias("path")).where("session_id % 2 = 0")
    files = compaction.file_lists(own.where("event_type = 'view'"), own.where("event_type = 'purchase' and path <> 'f0'"))
    config = {"compress": DEFAULTS["compress"], "nativeCompaction": DEFAULTS["nativeCompaction"] | {"maxSummaryTokens": 700, "maxPreviousSummaryTokens": 40}}
    return compaction.native_summary(sessions, made, files, config=config)


DETAILS = """d AS (SELECT session_id, ordinal, (session_id % 5 + 2) AS first, role, content, (SELECT min(block_id) FROM b WHERE b.session_id = m.session_id AND m.ordinal BETWEEN lo AND hi AND hi < m.session_id % 5 + 2) AS inside FROM m)"""


@register("native_details", _with(M, B, DETAILS) + "SELECT g.session_id, coalesce(ids, []) AS represented_block_ids, hidden, uncovered, least(uncovered, 2) AS rendered, uncovered - least(uncovered, 2) AS truncated FROM (SELECT session_id, CAST(count(*) AS INT) AS hidden, CAST(count(*) FILTER (WHERE inside IS NULL) AS INT) AS uncovered FROM d WHERE ordinal < first GROUP BY 1) g LEFT JOIN (SELECT session_id, list(block_id ORDER BY block_id) AS ids FROM b WHERE hi < session_id % 5 + 2 GROUP BY 1) r ON r.session_id = g.session_id")
def native_details(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    made = adapters.blocks(rows)
    kept = rows.select("session_id").distinct().withColumn("first_kept", F.col("session_id") % 5 + 2)
    return compaction.native_details(rows, kept, coverage.covered_rows(rows, made), made, most_rows=2)


@register("file_lists", "SELECT session_id, list_sort(list_filter(r, lambda x: NOT list_contains(w, x))) AS read_files, list_sort(w) AS modified_files FROM (SELECT user_id AS session_id, coalesce(list(DISTINCT props) FILTER (WHERE event_type = 'view'), []) AS r, coalesce(list(DISTINCT props) FILTER (WHERE event_type = 'purchase'), []) AS w FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1)")
def file_lists(spark, sf_dir):
    e = adapters.read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_type", F.col("props").alias("path"))
    return compaction.file_lists(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"))


@register("branch_closure", "SELECT c_nationkey AS session_id, CAST(c_custkey AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS depth, CAST(min(c_custkey) OVER (PARTITION BY c_nationkey) AS VARCHAR) AS root FROM customer")
def branch_closure(spark, sf_dir):
    from threadloom.sources.folders import shared_folder

    shared_folder(spark)
    before = F.lag("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    nodes = adapters.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session_id"), F.col("c_custkey").cast("string").alias("id"), before.cast("string").alias("parent_id"))
    return branches.ancestors(nodes)


@register("marker_collapse", "SELECT session_id, count(*) AS snapshots, count(*) FILTER (WHERE same) AS markers FROM (SELECT user_id AS session_id, coalesce(props = lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS same FROM events) GROUP BY 1")
def marker_collapse(spark, sf_dir):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = adapters.read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.lit(0).alias("chain"), pos.alias("pos"), F.parse_json("props").alias("v"))
    return persistence.shrink_report(persistence.collapsed(rows)).select("session_id", "snapshots", "markers")


#: A half that binary holds goes up, others to the nearest double, as printf has them.
PLACE = "regexp_replace(CASE WHEN n % 1000 IN (250, 750) THEN printf('%.1f', (n + 50) / 1000.0) ELSE printf('%.1f', n / 1000.0) END, '\\.0$', '')"


@register("compact_numbers", "SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 100000 THEN " + PLACE + " || 'k' WHEN n < 999500 THEN CAST((n + 500) // 1000 AS VARCHAR) || 'k' ELSE '' END AS label FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 50 % 99000 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS n FROM orders)")
def compact_numbers(spark, sf_dir):
    """Every third number ends in 50, the half of a place."""
    n = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") * 50 % 99000).otherwise(F.floor("o_totalprice").cast("long"))
    return adapters.read(spark, sf_dir, "orders").select("o_orderkey", tokens.compact_number(n).alias("label"))
