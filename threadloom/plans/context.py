"""The context pass: from a session's rows and blocks to what is sent, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.refs import ref_tag, with_ref
from threadloom.functions.text import strip_hallucinated
from threadloom.functions.tokens import estimate, message_estimate
from threadloom.functions.tools import fingerprint
from threadloom.operators import coverage, pruning, splicing, transcript
from threadloom.sources.jsonl import PART

STRIPPED_ROLES = ("assistant", "toolResult", "bashExecution")


def source_turns(rows: DataFrame) -> DataFrame:
    """(session_id, turns) of the rows as they came, before blocks take their place."""
    calls = F.transform(F.filter("parts", lambda p: p["type"] == "toolCall"), lambda p: p["id"])
    keyed = rows.withColumns({"calls": F.coalesce(calls, F.array().cast("array<string>")), "source_key": transcript.owner_key(F.col("ordinal")), "ts": F.lit(None).cast("double")})
    return transcript.logical_turns(transcript.spans(keyed))


def pruned_results(rows: DataFrame, tools: DataFrame, turns: DataFrame, *, cadence: int, error_turns: int, prior: DataFrame | None, dedup: bool = True, purge: bool = True, kept: tuple[str, ...] = (), spared: tuple[str, ...] = ()) -> DataFrame:
    """(session_id, tool_call_id) of results that a tombstone stands for: of a repeated call all but the
    last shown one, failed ones of ``error_turns`` turns ago, both before the open bucket, and ``prior``.
    ``kept``: tools whose repeated results stay; ``spared``: those whose failed ones do."""
    shown = rows.where("role = 'toolResult'").select("session_id", "ordinal", "tool_call_id", "is_error")
    log = shown.join(tools.select("session_id", "tool_call_id", "tool_name", "arguments", "turn_index"), ["session_id", "tool_call_id"]).join(turns, "session_id")
    may_repeat = ~F.coalesce(F.col("tool_name"), F.lit("")).isin(*pruning.PROTECTED, *kept) & F.lit(dedup)
    log = log.withColumns({"_fp": fingerprint(F.coalesce("tool_name", F.lit("")), F.col("arguments")), "_open": pruning.bucket(F.col("turns"), cadence)})
    later = F.row_number().over(Window.partitionBy("session_id", "_fp").orderBy(F.col("ordinal").desc())) > 1
    duplicate = may_repeat & later & (F.col("turn_index") < F.col("_open"))
    stale = F.coalesce(F.col("is_error"), F.lit(False)) & (F.col("_open") - F.col("turn_index") >= error_turns) & F.lit(purge)
    if spared:
        stale = stale & ~F.coalesce("tool_name", F.lit("")).isin(*spared)
    found = log.withColumn("_pruned", duplicate | stale).where("_pruned").select("session_id", "tool_call_id")
    return (found if prior is None else found.unionByName(prior.select("session_id", "tool_call_id"))).distinct()


def spliced(rows: DataFrame, blocks: DataFrame, carried: tuple[str, ...], full: int, compact: int) -> DataFrame:
    """Blocks in the place of rows. Those that come with keys or anchors (``splicing.spliced``) are applied in order,
    widened to whole exchanges and put at their anchors; others are disjoint ranges lo to hi."""
    if not {"start_key", "start_source_key"} & set(blocks.columns):
        return coverage.spliced(rows, blocks, carried, full=full, compact=compact)
    none = F.array().cast("array<string>")
    calls = F.transform(F.filter("parts", lambda p: p["type"] == "toolCall"), lambda p: p["id"]) if "parts" in rows.columns else none
    size = message_estimate(F.col("content"), F.col("parts")) if "parts" in rows.columns else None
    given = {"calls": F.coalesce(calls, none), "tool_call_id": F.lit(None).cast("string"), "ts": F.lit(None).cast("double"), "source_key": transcript.owner_key(F.col("ordinal"))}
    whole = rows.withColumns({c: x for c, x in given.items() if c not in rows.columns})
    return splicing.spliced(whole, blocks, carried, tokens=size, full=full, compact=compact)[0]


def context_pass(rows: DataFrame, blocks: DataFrame, tools: DataFrame | None = None, *, cadence: int = 1, error_turns: int = 4, prior: DataFrame | None = None, config: dict | None = None) -> DataFrame:
    """Rows as they are sent: blocks spliced in, made-up tags stripped, orphans repaired, repeated and
    stale outputs replaced by tombstones, references shown.

    ``rows``: session_id, ordinal, role, content; those of sessions with tools also parts (instead of
    content, in the form of ``PART``), tool_call_id and is_error, and then parts and tool_call_id are
    returned too. ``tools``: session_id, tool_call_id, tool_name, arguments, turn_index of recorded
    calls; only their results are replaced. ``prior``: as for ``pruning.prune_log``. ``config``: the whole
    configuration, whose strategies and numbers of detailed blocks then hold in place of the defaults.
    """
    switches, full, compact = {}, 4, 8
    if config is not None:
        own, dedup, purge = config["strategies"], config["strategies"]["deduplication"], config["strategies"]["purgeErrors"]
        cadence, error_turns = own["pruneCadenceTurns"], purge["turns"]
        switches = {"dedup": dedup["enabled"], "purge": purge["enabled"], "kept": tuple(dedup["protectedTools"]), "spared": tuple(purge["protectedTools"])}
        full, compact = config["compress"]["renderFullBlockCount"], config["compress"]["renderCompactBlockCount"]
    columns = ["session_id", "ordinal", "role", "content", "block_id", "ref"]
    if "parts" in rows.columns:
        turns = source_turns(rows)
        out = spliced(rows.withColumn("parts", F.col("parts").cast(f"array<{PART}>")), blocks, ("parts", "tool_call_id", "is_error"), full, compact)
        made_up = F.col("role").isin(*STRIPPED_ROLES)
        out = out.withColumns({"content": F.when(made_up, strip_hallucinated(F.col("content"))).otherwise(F.col("content")), "parts": F.when(made_up, pruning.stripped_parts(F.col("parts"))).otherwise(F.col("parts"))})
        out = pruning.without_orphans(out)
        if tools is not None or prior is not None:
            gone = prior.select("session_id", "tool_call_id").distinct() if tools is None else pruned_results(out, tools, turns, cadence=cadence, error_turns=error_turns, prior=prior, **switches)
            out = out.join(gone.withColumn("_gone", F.lit(True)), ["session_id", "tool_call_id"], "left")
            pruned = F.coalesce("_gone", F.lit(False)) & (F.col("role") == "toolResult")
            text = pruning.tombstone(F.lit(None).cast("string"), pruned, F.coalesce("is_error", F.lit(False)))
            out = out.withColumns({"content": F.when(pruned & F.col("parts").isNull(), text).otherwise(F.col("content")), "parts": F.when(pruned & F.col("parts").isNotNull(), F.array(text_part(text))).otherwise(F.col("parts"))}).drop("_gone")
        out = out.withColumn("ordinal", F.row_number().over(Window.partitionBy("session_id").orderBy("ordinal")) - 1)
        columns += ["parts", "tool_call_id"]
    else:
        out = spliced(rows, blocks, (), full, compact)
        out = out.withColumn("content", F.when(F.col("role").isin(*STRIPPED_ROLES), strip_hallucinated(F.col("content"))).otherwise(F.col("content")))
    keyed = out.withColumn("source_key", F.coalesce(F.concat(F.lit("synth:block:b"), F.col("block_id").cast("string")), F.concat(F.lit("s"), F.col("ordinal").cast("string"))))
    refs = transcript.visible_refs(keyed).select("session_id", "source_key", "ref")
    shown = keyed.join(refs, ["session_id", "source_key"], "left")
    if "parts" in columns:
        tagged = F.array_append("parts", text_part(F.concat(F.lit("\n"), ref_tag(F.col("ref")))))
        shown = shown.withColumn("parts", F.when(F.col("ref").isNotNull(), tagged).otherwise(F.col("parts")))
    return shown.withColumn("content", with_ref(F.col("role"), F.col("content"), F.col("ref"))).select(*columns)


def text_part(text: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit("text").alias("type"), text.alias("text"), *(none.alias(c) for c in ("thinking", "input", "id", "name", "arguments"))).cast(PART)


def context_tokens(shown: DataFrame) -> DataFrame:
    return shown.groupBy("session_id").agg(F.sum(estimate(F.col("content"))).alias("tokens"), F.count("*").alias("n_rows"))
