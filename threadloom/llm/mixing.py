"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Every source has a weight and a ramp: its share of the stream at training time t in [0, 1] is
proportional to ``1 + ramp * (2t - 1)``. Integrated, a source has used ``(1-r)t + r t^2`` of its
target by time t; a document that starts at cumulative word u of its source is therefore placed at
the t that solves this for u / target. Sorting all taken copies by t gives the stream.

Defined cases: a null text has no words; a null source is a source of its own, ordered last; rows
with equal ids are separate documents; empty tables give empty results; other columns are carried
along untouched, columns of the input named like those added here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import ordered, settle

WEIGHTS = (3.0, 1.0, 2.0)
RAMPS = (-0.5, 0.0, 0.5)
#: Rows that one window over a part of a source should hold.
ROWS_A_PART = 4096


def cycle(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def targets(sources: DataFrame, *, weights=WEIGHTS, ramps=RAMPS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Words to take of each source. ``sources`` has one row (source, source_size) for each.

    Sources take ``share`` of all words in proportion to their weights, at most ``most`` times their
    own; what is over goes to the others by weight. Solved by raising the common level until no
    further source is full; each step is one aggregate, its two sums are all the driver sees.
    """
    ranked = ordered(sources, F.col("source").asc_nulls_last(), name="_rank")
    t = settle(ranked.withColumns({"weight": cycle(weights, F.col("_rank")), "ramp": cycle(ramps, F.col("_rank")), "_mixing_cap_": most * F.col("source_size")}).drop("_rank"))
    wanted = share * (t.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        is_full = F.col("weight") * F.lit(level) >= F.col("_mixing_cap_")
        n, held, open_weight = t.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("_mixing_cap_"))), F.sum(F.when(~is_full, F.col("weight")))).first()
        if n == full or not open_weight:
            break
        full, level = n, (wanted - (held or 0.0)) / open_weight
    target = F.when(F.col("weight") * F.lit(level) >= F.col("_mixing_cap_"), F.col("_mixing_cap_")).otherwise(F.col("weight") * F.lit(level))
    return t.withColumn("target", target.cast("double")).drop("_mixing_cap_")


def place_in_time(used: Column, ramp: Column) -> Column:
    """The time at which a source with this ramp has used a share ``used`` of its target."""
    root = F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * used)
    return F.when(ramp == 0, used).otherwise((root - (1 - ramp)) / (2 * ramp))


def plan(sized: DataFrame, **options) -> DataFrame:
    """Add source_size, target, ramp, ``start`` and ``taken`` to rows with doc_id, source and size.

    Within a source, documents stand in the order of a hash of their id and size (and ``_mixing_tie_``,
    if there is one, so that equal ids don't meet in one place). The order is cut into parts
    by that hash, so that a source of any size is summed by many tasks: the parts' sums are summed
    up first, then the rows within each part.
    """
    tie = [F.col("_mixing_tie_").cast("string")] if "_mixing_tie_" in sized.columns else []
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), *tie))
    rows = sized.drop("source_size", "target", "weight", "ramp", "start", "taken").withColumn("_mixing_key_", key)
    n = sized.count()
    digits = 1 if n <= 16 * ROWS_A_PART else len(f"{n // ROWS_A_PART:x}")
    # a source's name that is never null: join and window then share one exchange of the rows
    name_of = lambda t: F.coalesce(F.concat(F.lit("="), F.col(f"{t}.source")), F.lit(""))
    rows = rows.alias("r").withColumns({"_mixing_part_": F.substring("_mixing_key_", 1, digits), "_mixing_source_": name_of("r")})
    parts = settle(rows.groupBy("source", "_mixing_part_").agg(F.sum("size").alias("_mixing_size_")))
    goals = targets(parts.groupBy("source").agg(F.sum("_mixing_size_").alias("source_size")), **options)
    before = Window.partitionBy("source").orderBy("_mixing_part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_mixing_before_", F.coalesce(F.sum("_mixing_size_").over(before), F.lit(0)))
    p, g = parts.alias("p"), goals.alias("g")
    parts = p.join(g, F.col("p.source").eqNullSafe(F.col("g.source"))).select(name_of("p").alias("_mixing_source_"), "p._mixing_part_", "p._mixing_before_", "g.source_size", "g.target", "g.ramp")
    shared = ["_mixing_part_", "_mixing_source_"]
    joined = rows.join(parts, shared)
    within = Window.partitionBy(*shared).orderBy("_mixing_key_", "doc_id", "size", *(["_mixing_tie_"] if "_mixing_tie_" in sized.columns else [])).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_mixing_before_") + F.coalesce(F.sum("size").over(within), F.lit(0))
    goal = F.floor("target")
    once = lambda at: F.greatest(F.lit(0), F.least(F.col("size"), goal - at))
    out = joined.withColumn("start", start)
    out = out.withColumn("taken", (once(F.col("start")) + once(F.col("start") + F.col("source_size"))).cast("long"))
    return out.drop("_mixing_source_", "_mixing_part_", "_mixing_key_", "_mixing_before_", "_mixing_tie_")


def position(epoch: Column | int = 0) -> Column:
    """Training position of a planned document's first word in this pass over its source."""
    used = (F.col("start") + F.col("source_size") * F.lit(epoch)) / F.floor("target")
    return place_in_time(F.least(F.lit(1.0), used), F.col("ramp"))


def stream(sized: DataFrame, **options) -> DataFrame:
    """The mix itself: whole documents, up to two copies, range-sorted by training position.

    A copy is in if at least half of it lies before its source's target.
    """
    planned = plan(sized, **options)
    copies = planned.withColumn("_mixing_pass_", F.explode(F.array(F.lit(0), F.lit(1))))
    begins = F.col("start") + F.col("source_size") * F.col("_mixing_pass_")
    kept = copies.where((begins + F.col("size") / 2 <= F.floor("target")) & ((F.col("_mixing_pass_") == 0) | (F.col("size") > 0)))
    used = F.least(F.lit(1.0), F.coalesce(F.try_divide(begins, F.floor("target")), F.lit(0.0)))
    return kept.withColumn("position", place_in_time(used, F.col("ramp"))).drop("_mixing_pass_").orderBy("position", "doc_id")
