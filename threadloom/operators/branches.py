"""The tree of entries: branches, nearest ancestors, replayable branches.

Parent chains are as long as sessions, so they are not walked step by step: every round joins each
entry's pointer with the pointer it points to, which doubles the distance covered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.sources.folders import shared_folder


def _rounds(nodes: DataFrame) -> int:
    """Rounds of doubling after which every path of a session's entries has ended, unless it is a cycle."""
    longest = nodes.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    return max(1, int(longest).bit_length())


def ancestors(nodes: DataFrame) -> DataFrame:
    """(session_id, id, depth, root) by pointer doubling; ``nodes``: session_id, id, parent_id.

    Rounds go on until all paths have ended. What is open after as many as the largest session needs leads into
    a cycle: no root, no depth.
    """
    shared_folder(nodes.sparkSession)
    known = nodes.select("session_id", F.col("id").alias("parent_id")).withColumn("_known", F.lit(True))
    start = nodes.join(known, ["session_id", "parent_id"], "left")
    at = start.select("session_id", "id", F.when(F.col("_known"), F.col("parent_id")).alias("up"), F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("depth"), F.when(F.col("_known").isNull(), F.col("id")).alias("root"))
    for _ in range(_rounds(nodes)):
        step = at.select("session_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("root").alias("_root"))
        at = at.join(step, ["session_id", "up"], "left").select("session_id", "id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("root", "_root").alias("root")).checkpoint()
        if not at.where("up is not null").take(1):
            break
    return at.select("session_id", "id", F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth"), "root")


def leaves(nodes: DataFrame) -> DataFrame:
    """Entries that are nobody's parent; each names a branch."""
    return nodes.join(nodes.select("session_id", F.col("parent_id").alias("id")).where("id is not null").distinct(), ["session_id", "id"], "left_anti").select("session_id", "id")


def lineage(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(session_id, id, ancestor, distance): each entry of ``of`` (all by default) with all its ancestors,
    itself at distance 0. On a cycle it ends before the first entry that comes again.

    Round k joins the ancestors known within 2**k steps with the entry 2**k steps above each, so rounds
    are the logarithm of the longest path.
    """
    shared_folder(nodes.sparkSession)
    named = nodes.where("id is not null").select("session_id", "id", "parent_id")
    there = named.select("session_id", F.col("id").alias("parent_id"))
    jump = named.join(there, ["session_id", "parent_id"]).select("session_id", F.col("id").alias("ancestor"), F.col("parent_id").alias("above")).where("ancestor <> above").distinct()
    out = (named if of is None else of).select("session_id", "id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    step = 1
    while True:
        grown = out.join(jump, ["session_id", "ancestor"]).select("session_id", "id", F.col("above").alias("ancestor"), (F.col("distance") + step).alias("distance")).checkpoint()
        fresh = grown.join(out.select("session_id", "id", "ancestor"), ["session_id", "id", "ancestor"], "left_anti").groupBy("session_id", "id", "ancestor").agg(F.min("distance").alias("distance")).checkpoint()
        if not fresh.take(1):
            return out
        out = out.unionByName(fresh).checkpoint()
        jump = jump.alias("a").join(jump.alias("b"), (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.above") == F.col("b.ancestor"))).select("a.session_id", "a.ancestor", "b.above").checkpoint()
        step *= 2


def branch_entries(nodes: DataFrame) -> DataFrame:
    """(session_id, branch_id, id, depth): each leaf's path from the root, depth 0 at the root. Sessions
    whose entries have no ids are one flat branch in order of place."""
    flat = nodes.where("id is null").select("session_id", F.lit(None).cast("string").alias("branch_id"), F.lit(None).cast("string").alias("id"), (F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1).cast("long").alias("depth"))
    named = nodes.where("id is not null")
    up = lineage(named, leaves(named.select("session_id", "id", "parent_id")))
    longest = Window.partitionBy("session_id", "id")
    paths = up.select("session_id", F.col("id").alias("branch_id"), F.col("ancestor").alias("id"), (F.max("distance").over(longest) - F.col("distance")).alias("depth"))
    return paths.unionByName(flat)


def nearest_marked(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """(session_id, id, ancestor): the nearest proper ancestor of each entry of ``marked`` that is marked,
    as a log that is read from its start knows it: an entry that stands later in the file than the one asked
    for ends the walk. ``nodes``: session_id, id, parent_id, pos; ``marked``: session_id, id. Of repeated ids
    the first line counts.

    The forest is contracted onto its marked entries: each entry points to its parent, and in each round an
    open pointer jumps as far as the one it points to, so its reach doubles; pointers to marked entries and
    from roots are closed. One row for each entry in every round, whatever the depth. A pointer carries the
    last place it passed, which decides whether all of the path was known. What never closes runs in a cycle.
    """
    shared_folder(nodes.sparkSession)
    first = nodes.where("id is not null").groupBy("session_id", "id").agg(F.min_by("parent_id", "pos").alias("up"), F.min("pos").alias("pos"))
    own = marked.where("id is not null").select("session_id", "id").distinct().withColumn("_marked", F.lit(True))
    first = first.join(own, ["session_id", "id"], "left").withColumn("_marked", F.coalesce("_marked", F.lit(False))).checkpoint()
    parent = first.select("session_id", F.col("id").alias("up"), F.col("pos").alias("high"), (~F.col("_marked")).alias("open"))
    at = first.join(parent, ["session_id", "up"], "left").select("session_id", "id", "pos", "_marked", F.when(F.col("high").isNotNull(), F.col("up")).alias("up"), "high", F.coalesce("open", F.lit(False)).alias("open")).checkpoint()
    for _ in range(_rounds(first)):
        if not at.where("open").take(1):
            break
        ahead = at.where("not _marked").select("session_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("high").alias("_high"), F.col("open").alias("_open"))
        jumped = at.where("open").join(ahead, ["session_id", "up"], "left").select("session_id", "id", "pos", "_marked", F.col("_up").alias("up"), F.greatest("high", "_high").alias("high"), F.coalesce("_open", F.lit(False)).alias("open"))
        at = at.where("not open").unionByName(jumped).checkpoint()
    return at.where("_marked and not open and up is not null and high < pos").select("session_id", "id", F.col("up").alias("ancestor"))


def replayable(entries: DataFrame) -> DataFrame:
    """(session_id, branch_id, replayable): whether a branch has a successful compress result or a
    compaction made of blocks. ``entries``: session_id, branch_id, type, role, tool_name, is_error,
    compaction_source, represented (array of block ids)."""
    done = (F.col("type") == "message") & (F.col("role") == "toolResult") & (F.col("tool_name") == "compress") & ~F.coalesce("is_error", F.lit(False))
    native = (F.col("type") == "compaction") & (F.col("compaction_source") == NATIVE_SOURCE) & (F.size("represented") > 0)
    return entries.groupBy("session_id", "branch_id").agg(F.bool_or(F.coalesce(done, F.lit(False)) | F.coalesce(native, F.lit(False))).alias("replayable"))


#: Fixed value: what marks a compaction made of blocks.
NATIVE_SOURCE = "dcp-native-compaction"
