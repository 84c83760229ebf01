"""Blocks that overlap, or stand at anchors: applied one after another, each to what the ones before left.

Where blocks of a session are disjoint and take their range's place, ``coverage.spliced`` does it by joins alone. In
general a block's range is looked up in the rows that are left, takes in earlier blocks that stand in it, is widened
to whole exchanges, and its text is put before its anchor, which may lie in another block's range. So each
session with blocks is folded in order of its blocks. The fold sees no text: a row is its key, role, time,
tokens and call ids, and what comes back is the order of rows and blocks, to which Spark joins the contents.

The rows of a session are a linked list with order labels. A row is removed once, a lookup is a dictionary's,
an insertion sets one label between two others, so all blocks together take time in proportion to rows and
blocks; only a block whose anchor is gone sorts the session by time, as the protocol wants it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.tokens import estimate
from threadloom.operators import coverage, transcript

PLAN = "session_id {0}, ordinal long, from_ordinal long, block_id long, removed long, added long, resolved boolean"


@dataclass(slots=True, eq=False)
class Item:
    """A row, or a block in the place of rows."""

    key: str
    role: str
    ts: float | None
    tokens: int
    calls: tuple[str, ...] = ()
    answers: str | None = None
    ordinal: int | None = None
    block: int | None = None
    before: Item | None = field(default=None, repr=False)
    after: Item | None = field(default=None, repr=False)
    label: float = 0.0
    alive: bool = True


class Rows:
    """A session's rows in order, with removal of ranges and insertion before a row."""

    def __init__(self, items: list[Item]):
        self.first = self.last = None
        self.by_key: dict[str, list[Item]] = {}
        self.by_ts: dict[float, list[Item]] = {}
        for item in items:
            self._known(item)
        self._link(items)

    def _known(self, item: Item) -> None:
        self.by_key.setdefault(item.key, []).append(item)
        if item.ts is not None:
            self.by_ts.setdefault(item.ts, []).append(item)

    def _link(self, items: list[Item]) -> None:
        self.first, self.last = (items[0], items[-1]) if items else (None, None)
        for k, item in enumerate(items):
            item.label, item.before = float(k), items[k - 1] if k else None
            item.after = items[k + 1] if k + 1 < len(items) else None

    def __iter__(self) -> Iterator[Item]:
        item = self.first
        while item is not None:
            yield item
            item = item.after

    def found(self, known: dict, name) -> Item | None:
        """The first row of that key or time."""
        return min((i for i in known.get(name, ()) if i.alive), key=lambda i: i.label, default=None)

    def remove(self, lo: Item, hi: Item) -> int:
        """Tokens of the rows from lo to hi, which are taken out."""
        total, item, end = 0, lo, hi.after
        while item is not end:
            total, item.alive, item = total + item.tokens, False, item.after
        if lo.before is None:
            self.first = end
        else:
            lo.before.after = end
        if end is None:
            self.last = lo.before
        else:
            end.before = lo.before
        return total

    def insert(self, item: Item, at: Item | None) -> None:
        """Before a row, or at the end."""
        self._known(item)
        before = at.before if at is not None else self.last
        item.before, item.after = before, at
        if before is None:
            self.first = item
        else:
            before.after = item
        if at is None:
            self.last = item
        else:
            at.before = item
        low = before.label if before is not None else (at.label - 2 if at is not None else -1.0)
        item.label = low + 1 if at is None else (low + at.label) / 2
        if at is not None and not low < item.label < at.label:
            self._link(list(self))

    def sort(self) -> None:
        self._link(sorted(self, key=lambda i: i.ts or 0))


def widened(lo: Item, hi: Item) -> tuple[Item, Item]:
    """A range with the calls of its results, the results of its calls and the passthrough rows after it."""
    soft = (*transcript.RESULT_ROLES, *transcript.PASSTHROUGH)

    def between(a: Item, b: Item) -> Iterator[Item]:
        while a is not b:
            yield a
            a = a.after
        yield b

    answered = {i.answers for i in between(lo, hi) if i.role in transcript.RESULT_ROLES and i.answers is not None}
    while True:
        prior = lo.before
        while prior is not None and prior.role in soft:
            prior = prior.before
        if prior is None or prior.role != "assistant" or answered.isdisjoint(prior.calls):
            break
        answered |= {i.answers for i in between(prior, lo) if i.role in transcript.RESULT_ROLES and i.answers is not None}
        lo = prior
    asked = {c for i in between(lo, hi) if i.role == "assistant" for c in i.calls}
    while hi.after is not None and (hi.after.role in transcript.PASSTHROUGH or (hi.after.role in transcript.RESULT_ROLES and hi.after.answers in asked)):
        hi = hi.after
    return lo, hi


@dataclass(slots=True)
class Block:
    block_id: int
    start_key: str | None
    end_key: str | None
    start_ts: float | None
    end_ts: float | None
    anchor_key: str | None
    anchor_ts: float | None
    added: int


def applied(rows: Rows, block: Block) -> int | None:
    """Put a block in the place of its range; tokens removed, None if its range isn't there."""
    lo = hi = None
    if block.start_key and block.end_key:
        lo, hi = rows.found(rows.by_key, block.start_key), rows.found(rows.by_key, block.end_key)
    if lo is None or hi is None:
        finite = [t is not None and math.isfinite(t) for t in (block.start_ts, block.end_ts)]
        lo, hi = (rows.found(rows.by_ts, t) for t in (block.start_ts, block.end_ts)) if all(finite) else (None, None)
    if lo is None or hi is None:
        return None
    removed = rows.remove(*widened(*sorted((lo, hi), key=lambda i: i.label)))
    stands = block.anchor_ts is not None and math.isfinite(block.anchor_ts)
    ts = block.anchor_ts - 0.5 if stands else None if block.end_ts is None else block.end_ts + 0.5
    made = Item(f"synth:block:b{block.block_id}", "user", ts, block.added, block=block.block_id)
    if block.anchor_key and block.anchor_key.startswith("tail:"):
        rows.insert(made, None)
        return removed
    at = rows.found(rows.by_key, block.anchor_key) if block.anchor_key else None
    rows.insert(made, at)
    if at is None:
        rows.sort()
    return removed


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


def _planned(rows: pd.DataFrame, blocks: pd.DataFrame) -> list[tuple]:
    rows = rows.sort_values("ordinal")
    items = Rows([Item(r.source_key, r.role, _number(r.ts), int(r.tokens), tuple(() if r.calls is None else r.calls), r.tool_call_id, ordinal=int(r.ordinal)) for r in rows.itertuples(index=False)])
    out = []
    for b in blocks.sort_values("place").itertuples(index=False):
        block = Block(int(b.block_id), b.start_key, b.end_key, _number(b.start_ts), _number(b.end_ts), b.anchor_key, _number(b.anchor_ts), int(b.added))
        removed = applied(items, block)
        out.append((None, None, block.block_id, 0 if removed is None else removed, block.added, removed is not None))
    return [(k, i.ordinal, i.block, None, None, None) for k, i in enumerate(items)] + out


def planned(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """For sessions with blocks, the new order: (session_id, ordinal, from_ordinal or block_id), and a row without
    ordinal for each block: (block_id, removed, added, resolved).

    ``rows``: session_id, ordinal, source_key, role, ts, tokens, calls, tool_call_id; ``blocks``: session_id,
    block_id, place (their order), start_key, end_key, start_ts, end_ts, anchor_key, anchor_ts, added.
    """
    columns = ["ordinal", "from_ordinal", "block_id", "removed", "added", "resolved"]

    def one(key: tuple, r: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_planned(r, b) if len(b) else [], columns=columns).astype({c: "Int64" for c in columns[:-1]}).astype({"resolved": "boolean"})
        out.insert(0, "session_id", key[0])
        return out

    light = rows.select("session_id", "ordinal", "source_key", "role", F.col("ts").cast("double").alias("ts"), "tokens", "calls", "tool_call_id")
    light = light.join(blocks.select("session_id").distinct(), "session_id", "left_semi")
    light, blocks = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (light, blocks))  # columns of their own: both may come from one table
    kind = rows.schema["session_id"].dataType.simpleString()
    return light.groupBy("session_id").cogroup(blocks.groupBy("session_id")).applyInPandas(one, PLAN.format(kind))


def spliced(rows: DataFrame, blocks: DataFrame, carried: tuple[str, ...] = (), *, tokens: Column | None = None, full: int = 4, compact: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rows with all active blocks applied in order (session_id, ordinal, role, content, block_id, and
    ``carried``, null in rows of blocks), and what each saved (session_id, block_id, removed, added, saved,
    resolved).

    A block is found by its keys, else by its times; one that isn't found changes nothing and is not resolved. A
    tail anchor is the end; a block without a findable anchor goes by time, before its anchor's or after
    its end. ``rows``: session_id, ordinal, role, content, source_key, ts, calls, tool_call_id;
    ``blocks``: those of ``persistence.restored_blocks``, or with start_key, end_key and anchor_key.
    """
    levels = coverage.detail_levels(blocks, full, compact)
    log = F.col("activity_log") if "activity_log" in blocks.columns else None
    levels = levels.withColumn("_text", coverage.rendered(F.col("topic"), F.col("summary"), F.col("detail"), log))
    given = set(blocks.columns)
    name = lambda new, old, kind: (F.col(new) if new in given else F.col(old) if old in given else F.lit(None)).cast(kind).alias(new)
    place = F.col("place") if "place" in given else F.col("block_id")
    asked = levels.select(
        "session_id", F.col("block_id").cast("long").alias("block_id"), place.alias("place"), name("start_key", "start_source_key", "string"), name("end_key", "end_source_key", "string"), name("start_ts", "", "double"), name("end_ts", "", "double"),
        name("anchor_key", "anchor_source_key", "string"), name("anchor_ts", "", "double"), estimate(F.col("_text")).alias("added"),
    )
    plan = planned(rows.withColumn("tokens", estimate(F.col("content")) if tokens is None else tokens), asked)
    moved = plan.where("from_ordinal is not null").select("session_id", F.col("from_ordinal").alias("ordinal"), F.col("ordinal").alias("_to"))
    own = rows.select("session_id", "ordinal", "role", "content", *carried)
    touched = blocks.where("active").select("session_id").distinct()
    stay = own.join(touched, "session_id", "left_anti").withColumn("block_id", F.lit(None).cast("long"))
    kept = own.join(moved, ["session_id", "ordinal"]).withColumn("ordinal", F.col("_to")).drop("_to").withColumn("block_id", F.lit(None).cast("long"))
    texts = levels.select("session_id", F.col("block_id").cast("long").alias("block_id"), F.col("_text").alias("content"))
    made = plan.where("ordinal is not null and block_id is not null").select("session_id", "ordinal", "block_id").join(texts, ["session_id", "block_id"]).withColumn("role", F.lit("user"))
    out = stay.unionByName(kept).unionByName(made, allowMissingColumns=True)
    saved = plan.where("ordinal is null").select("session_id", "block_id", "removed", "added", F.greatest(F.col("removed") - F.col("added"), F.lit(0)).alias("saved"), "resolved")
    return out, saved.withColumn("saved", F.when(F.col("resolved"), F.col("saved")))
