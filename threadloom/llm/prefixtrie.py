"""Prefix tries of conversations, built as Patricia tries over sorted digests.

A turn is the 16-byte digest of its role and text, a conversation the string of its turns' digests.
Equal conversations are folded first; the distinct ones are range-sorted over all partitions. Each
partition then makes its part of the trie in one pass over its rows with a stack: only branch, end and leaf
points are created, with compressed edges, and a point's aggregates are settled when it is left. Nodes
that two partitions share lie on the paths of their first and last rows. Those are made one by one and
carry their prefix's digest, by which their parts are added up; two numbers for each partition (how many
turns its first row shares with the row before it, its last with the row after it) keep shared nodes from
being counted twice. Last, unary nodes are expanded from their edge's suffix sums.

Everything added up is additive over members: with ``a`` the code points of all members' turns below a
node and ``b`` those of its distinct nodes below, each counted once, ``a - b`` is what sharing saves.

The conversations that end at a node are hashed as one list: sorted parts of it are joined to strings where
they lie, and the strings pass through one running hash, so that no list is held as a whole.

Defined cases: null role or text is empty; null turns come first, equal turns go by their digests; rows
without conv_id are left out; a conversation without turns is a member of the root and ends there; an empty
table has no nodes, not even a root; other columns are ignored. A conversation's digests (16 bytes and a
length for each turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import settle

WIDTH = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

POINTS = (
    "part int, at long, parent_at long, depth int, conv_id long, n_convs long, n_children long, n_leaves long, "
    "below_all long, below_new long, own long, suffixes array<long>, ends_sha256 string, node string"
)


def turn_key() -> Column:
    """Digest of role and text; the role's length keeps the two apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (key, length)."""
    turn = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"), turn_key().alias("key"), F.coalesce(F.char_length("text"), F.lit(0)).alias("length"))
    lists = conversations.where("conv_id is not null").select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return lists.withColumn("turns", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["length"].alias("length"))))


def rebuilt(lists: DataFrame, *, block: int = 100, most: int = 6) -> DataFrame:
    """Conversation c with its first h turns replaced by those of conversation ``c - c % block``, with h =
    crc32(c) % most. Of that one, ``most - 1`` turns are needed at most, for ``block`` conversations."""
    heads = lists.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    own = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", h)
    none = F.slice("turns", 1, 0)
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).otherwise(none)
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def sequences(lists: DataFrame) -> DataFrame:
    """(conv_id, sequence, keys, lengths): keys is the string of the digests, sequence its own digest."""
    keys = F.unhex(F.concat_ws("", F.transform("turns", lambda t: F.hex(t["key"]))))
    out = lists.select("conv_id", keys.alias("keys"), F.transform("turns", lambda t: t["length"]).alias("lengths"))
    return out.withColumn("sequence", F.md5("keys"))


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids of one sequence that lie together in a batch, as one string."""
    for batch in batches:
        ids = batch["conv_id"].astype(str)
        parts = ids.groupby(batch["sequence"], sort=False).agg(ids=",".join, n="count")
        first = batch.groupby("sequence", sort=False)["conv_id"].min()
        yield parts.assign(first=first).reset_index()[["sequence", "first", "n", "ids"]]


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One running hash for each sequence over its strings in order."""
    name, run, n, conv = None, hashlib.sha256(), 0, None
    for batch in batches:
        done = []
        for sequence, first, count, ids in batch[["sequence", "first", "n", "ids"]].itertuples(index=False):
            if sequence != name:
                if name is not None:
                    done.append((name, conv, n, run.hexdigest()))
                name, run, n, conv = sequence, hashlib.sha256(), 0, first
            else:
                run.update(b",")
            run.update(ids.encode())
            n += count
        yield pd.DataFrame(done, columns=["sequence", "conv_id", "n", "ends_sha256"])
    if name is not None:
        yield pd.DataFrame([(name, conv, n, run.hexdigest())], columns=["sequence", "conv_id", "n", "ends_sha256"])


def ends(seqs: DataFrame) -> DataFrame:
    """(sequence, conv_id, n, ends_sha256): smallest id, number and hash of the ids of equal conversations."""
    sorted_ids = seqs.select("sequence", "conv_id").repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    parts = sorted_ids.mapInPandas(_joined, "sequence string, first long, n long, ids string")
    return parts.repartition("sequence").sortWithinPartitions("sequence", "first").mapInPandas(_hashed, "sequence string, conv_id long, n long, ends_sha256 string")


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two strings of digests have in common at their start."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    differ = np.frombuffer(a, np.uint8, n * WIDTH) != np.frombuffer(b, np.uint8, n * WIDTH)
    return int(differ.argmax()) // WIDTH


def borders(laid: DataFrame) -> dict[int, tuple[int, int]]:
    """For each partition with rows, turns its first row shares with the row before and its last with the row
    after (-1 if there is none). One row of each partition is read, two numbers of each reach the driver."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"part": b["part"], "left": [0 if p is None else shared_turns(p, f) for p, f in zip(b["before"], b["first"], strict=True)]})

    rows = laid.groupBy("part").agg(F.min("keys").alias("first"), F.max("keys").alias("last")).withColumn("before", F.lag("last").over(Window.orderBy("part")))
    left = {r.part: r.left for r in rows.mapInPandas(measured, "part int, left int").collect()}
    order = sorted(left)
    return {p: (left[p], left[order[k + 1]] if k + 1 < len(order) else -1) for k, p in enumerate(order)}


class Point:
    """A point of the trie that is still open, with what its closed children left behind."""

    __slots__ = ("depth", "at", "n", "conv", "children", "leaves", "all", "new", "ends", "node", "seen", "goes_on")

    def __init__(self, depth: int, at: int):
        self.depth, self.at = depth, at
        self.n = self.children = self.leaves = self.all = self.new = 0
        self.conv = self.ends = self.node = None
        self.seen = self.goes_on = False  # whether a partition before has it, too; whether the next one has children of it


class Stack:
    """The open points on the path to the row that was added last."""

    def __init__(self, part: int, left: int, right: int):
        self.part, self.left, self.right = part, left, right
        self.made, self.rows, self.open = 0, [], []
        self.keys, self.lengths = None, None

    def push(self, depth: int, place: int | None = None) -> Point:
        point = Point(depth, self.made)
        self.made += 1
        self.open.insert(len(self.open) if place is None else place, point)
        return point

    def name(self, keys: bytes) -> None:
        """Open points get their prefix's digest. All depths are open."""
        run = hashlib.md5()
        for point in self.open:
            if point.depth:
                run.update(keys[(point.depth - 1) * WIDTH : point.depth * WIDTH])
            point.node = f"{point.depth}:{run.hexdigest()}"

    def close(self) -> None:
        point = self.open.pop()
        parent = self.open[-1] if self.open else None
        if point.ends is not None and not point.children and not point.goes_on:
            point.leaves = 1
        top = parent.depth if parent else 0
        edge = self.lengths[top : point.depth]
        own = int(edge[-1]) if len(edge) else 0
        suffixes = (np.cumsum(edge[::-1])[::-1] - own).astype(np.int64) if len(edge) else np.zeros(1, np.int64)
        self.rows.append((self.part, point.at, parent.at if parent else None, point.depth, point.conv, point.n, point.children, point.leaves, point.all, point.new, own, suffixes, point.ends, point.node))
        if parent:
            parent.n += point.n
            parent.conv = point.conv if parent.conv is None else min(parent.conv, point.conv)
            parent.leaves += point.leaves
            parent.children += not point.seen
            whole = int(edge.sum())
            parent.all += point.all + point.n * whole
            parent.new += point.new + (0 if point.seen else whole)

    def leave(self, depth: int) -> None:
        """Close what is deeper than ``depth``; a branch point at that depth is made if there is none."""
        while self.open[-1].depth > depth:
            if self.open[-2].depth < depth:
                self.push(depth, len(self.open) - 1)
            self.close()

    def add(self, keys: bytes, lengths: np.ndarray, n: int, conv: int, ends: str) -> None:
        depth = len(keys) // WIDTH
        if self.keys is None:
            for d in range(depth + 1):
                self.push(d).seen = 0 < d <= self.left
            self.name(keys)
        else:
            self.leave(shared_turns(self.keys, keys))
            if self.open[-1].depth < depth:
                self.push(depth)
        top = self.open[-1]
        top.n, top.ends, top.conv = n, ends, conv
        self.keys, self.lengths = keys, lengths

    def finish(self) -> None:
        if self.keys is None:
            return
        for place in range(len(self.open) - 1, 0, -1):
            for d in range(self.open[place].depth - 1, self.open[place - 1].depth, -1):
                self.push(d, place)
        self.name(self.keys)
        self.open[-1].goes_on = self.right == self.open[-1].depth
        while self.open:
            self.close()


def _points(border: dict[int, tuple[int, int]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = [c.split()[0] for c in POINTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack = None
        for batch in batches:
            for part, keys, lengths, n, conv, sha in batch[["part", "keys", "lengths", "n", "conv_id", "ends_sha256"]].itertuples(index=False):
                if stack is None or stack.part != part:
                    if stack is not None:
                        stack.finish()
                        yield pd.DataFrame(stack.rows, columns=columns)
                    stack = Stack(part, *border[part])
                stack.add(bytes(keys), np.asarray(lengths, np.int64), n, conv, sha)
            if stack is not None and stack.rows:
                yield pd.DataFrame(stack.rows, columns=columns)
                stack.rows = []
        if stack is not None:
            stack.finish()
            yield pd.DataFrame(stack.rows, columns=columns)

    return run


def trie(seqs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the sequences: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    seqs = settle(seqs)
    distinct = seqs.groupBy("sequence").agg(F.first("keys").alias("keys"), F.first("lengths").alias("lengths")).join(ends(seqs), "sequence")
    laid = settle(distinct.repartitionByRange("keys").sortWithinPartitions("keys").withColumn("part", F.spark_partition_id()).drop("sequence"))
    points = settle(laid.mapInPandas(_points(borders(laid)), POINTS))
    local, shared = points.where("node is null").drop("node"), points.where("node is not null")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "below_all", "below_new")]
    once = F.min(F.struct("part", "at", "parent_at", "suffixes")).alias("once")
    merged = settle(shared.groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("own").alias("own"), F.max("ends_sha256").alias("ends_sha256"), once)).select("*", "once.*").drop("once")
    named = shared.select("part", "at", "node").join(merged.select("node", "conv_id"), "node").drop("node")
    parents = local.select("part", "at", "conv_id").unionByName(named).select("part", F.col("at").alias("parent_at"), F.col("conv_id").alias("parent_conv_id"))
    rows = local.unionByName(merged.drop("node")).join(parents, ["part", "parent_at"], "left")
    saved = F.when(F.col("depth") > 0, F.col("below_all") - F.col("below_new") + (F.col("n_convs") - 1) * F.col("own")).otherwise(F.col("below_all") - F.col("below_new"))
    each = rows.withColumn("saved", saved).select("*", F.posexplode("suffixes").alias("_i", "_suffix"))
    last = F.col("_i") == F.size("suffixes") - 1
    return each.select(
        "conv_id",
        (F.col("depth") - F.size("suffixes") + 1 + F.col("_i")).cast("long").alias("depth"),
        F.when(F.col("_i") == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("_suffix")).alias("saved_tokens"),
        F.when(last & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
