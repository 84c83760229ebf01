"""Exact n-gram Jaccard join by inverted lists with set-relation skipping, and its components.

1. One pass over the texts makes each the set of its hashed n-word shingles, sorted by hash; texts with
   equal sets form one class.
2. Two sets with Jaccard >= t differ in at most ``d = n (1 - t) / t`` shingles. Lay the shingles of both in
   one row by hash and cut it into tuples of w: one of the first ``d + 1`` tuples is untouched, so both sets
   hold these shingles as neighbours, the first at position ``w d`` at most. Each set is therefore
   listed under its first ``w d + 1`` tuples of neighbours, however common its shingles are; a list is cut
   wherever the next set is too large for the one before. Equal tuples of sets of about one size are merged
   within a task before they are shuffled, so one that very many sets share is few rows of each task.
3. Sets that share a list, or a chain of lists, form a candidate group. A group that fits goes to one task,
   each set once. Of a larger group each list's leader has a task; and what still is too large is cut into
   blocks by size band and hash and treated in three rounds, see ``in_rounds``.
4. In a task, sets stand in order of size and inverted lists are kept in blocks: a block is skipped if all
   its positions lie outside the size bound. A set whose partners are all in its component already is
   skipped; and the overlaps of a set with all others are derived from those of a highly similar set,
   reading only the lists of the shingles in which the two differ.
5. Tasks return links that connect what is linked, at most as many as sets; components follow by star
   steps, with a union-find within each partition before each of them.

Defined cases: null texts and texts without words have no shingle and are linked with nothing; texts
with fewer than n words have one shingle, the whole sequence; rows with equal ids and unequal texts are
separate documents (a component is named by its smallest id); null ids take part and name a component
only if there is no other id; columns beside id and text are not read; empty tables give empty
results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from threadloom.llm.common import discard, settle, stored

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Sets and shingles that one task takes of a candidate group, or of each block of a larger one.
BLOCK_SETS, BLOCK_TOKENS = 4_000, 600_000
#: Tuples that a task merges at a time, and nodes that its union-find holds.
MERGED, NODES = 2_000_000, 500_000
#: Bits of the filter by which texts outside all candidate groups are passed over; fixed, so that beyond
#: some million sets in groups it lets more texts through, which costs time but changes nothing.
FILTER_BITS = 1 << 23
#: Entries of a block of an inverted list; answered sets that are kept to derive others from.
LIST_BLOCK, KEPT = 64, 8
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
WORD_CACHE = 400_000


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, n: int = 3):
        self.n = n
        self.words: dict[bytes, int] = {}

    def word(self, w: bytes) -> int:
        h = self.words.get(w)
        if h is None:
            if len(self.words) >= WORD_CACHE:
                self.words.clear()
            h = xxhash.xxh3_64_intdigest(w)
            if len(w) <= 64:
                self.words[w] = h
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().translate(_LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.n:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
        h = np.fromiter(map(self.word, words), np.uint64, len(words))
        m = len(h) - self.n + 1
        code = h[:m].copy()
        for k in range(1, self.n):
            code = (code ^ (code >> np.uint64(29))) * _MIX[k % 3] + h[k : k + m]
        code = (code ^ (code >> np.uint64(32))) * _MIX[0]
        return np.unique(code ^ (code >> np.uint64(29)))


def digest(codes: np.ndarray) -> bytes:
    """What tells sets apart: 128 bits."""
    return xxhash.xxh3_128_digest(codes.tobytes())


def packed(codes: np.ndarray) -> bytes:
    """48 bits of each hash: what a pair of sets needs to be compared."""
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.int64)


def needed(n: int, num: int, den: int) -> int:
    """Least overlap of a set of n with any set of Jaccard >= num / den."""
    return -(-n * num // den)


def overlaps_enough(o, n, m, num: int, den: int):
    return (num + den) * o >= num * (n + m)


def tuples(codes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the neighbouring shingles that a set is listed under, see the module's text."""
    width = 3 if 10 * num >= 9 * den else 2 if 10 * num >= 8 * den else 1
    size = min(width * (len(codes) * (den - num) // num) + 1, len(codes) - width + 1)
    if size <= 0:
        return np.zeros(0, np.int64)
    out = codes[:size]
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(31))) * _MIX[1] + codes[k : k + size] * _MIX[2]
    return out.astype(np.int64)


def coded(set_id: bytes, n: int) -> int:
    """53 bits of a set's hash and, in the last 11, 64 times the logarithm of its size."""
    return int.from_bytes(set_id[:8], "little", signed=True) >> 11 << 11 | int(64 * math.log2(n))


SIZE_BITS = (1 << 11) - 1


def row_key() -> Column:
    """128 bits that tell rows apart that are not equal in id and text."""
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit(":"), F.col("text")), F.lit("")))
    return F.unhex(F.md5(own.cast("binary")))


def listed(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """From one pass over the texts, rows of three kinds.

    ``row_key``, ``doc_id``, ``n_shingles``, ``set_id``, ``code`` for each row of ``docs`` (set_id and code
    null without shingles); ``tuple``, ``code`` for each tuple and size of a task's sets, with the least of
    them; ``code``, ``least`` for the other sets.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingles(n), set()
        codes, keys, waiting = [], [], 0

        def out(size: int, **own) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(size, f.type) for f in kinds], schema=kinds)

        def merged() -> Iterator[pa.RecordBatch]:
            nonlocal codes, keys, waiting
            if waiting:
                key = np.concatenate(keys)
                code = np.repeat(np.array(codes, np.int64), [len(k) for k in keys])
                at = np.lexsort((code, code & SIZE_BITS, key))
                key, code = key[at], code[at]
                first = np.concatenate([[True], (key[1:] != key[:-1]) | ((code[1:] ^ code[:-1]) & SIZE_BITS != 0)])
                least = code[first][np.cumsum(first) - 1]
                for lo in range(0, int(first.sum()), 200_000):
                    yield out(len(part := key[first][lo : lo + 200_000]), tuple=part, code=code[first][lo : lo + 200_000])
                pairs = np.unique(np.stack([code, least])[:, code != least], axis=1)
                for lo in range(0, pairs.shape[1], 200_000):
                    part = pairs[:, lo : lo + 200_000]
                    yield out(part.shape[1], code=part[0], least=part[1])
            codes, keys, waiting = [], [], 0

        for batch in batches:
            sizes, ids, own_codes = [], [], []
            for text in batch["text"]:
                s = make(text.as_py())
                h = digest(s) if len(s) else None
                sizes.append(len(s))
                ids.append(h)
                own_codes.append(h and coded(h, len(s)))
                if h and h not in seen:
                    seen.add(h)
                    keys.append(tuples(s, num, den))
                    codes.append(own_codes[-1])
                    waiting += len(keys[-1])
            yield out(len(sizes), row_key=batch["row_key"], doc_id=batch["doc_id"], n_shingles=sizes, set_id=ids, code=own_codes)
            if waiting > MERGED:
                yield from merged()
        yield from merged()

    id_type = docs.schema["doc_id"].dataType
    schema = f"row_key binary, doc_id {id_type.simpleString()}, n_shingles long, set_id binary, code long, tuple long, least long"
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return docs.select(row_key().alias("row_key"), "doc_id", "text").mapInArrow(rows, schema)


def _slices(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Indices of all [start, end) ranges, one after the other."""
    size = ends - starts
    live = size > 0
    starts, size = starts[live], size[live]
    if not len(size):
        return np.zeros(0, np.int64)
    at = np.cumsum(size)
    step = np.ones(at[-1], np.int64)
    step[0] = starts[0]
    step[at[:-1]] = starts[1:] - starts[:-1] - size[:-1] + 1
    return np.cumsum(step)


class Lists:
    """Inverted lists of sets that stand in order of size, in blocks that know their first and last set."""

    def __init__(self, sets: list[np.ndarray]):
        self.count = len(sets)
        size = np.array([len(s) for s in sets], np.int64)
        doc = np.repeat(np.arange(self.count), size)
        _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[token] > 1
        doc, token = doc[shared], token[shared]
        begin = np.searchsorted(doc, np.arange(self.count + 1))
        self.own = [token[begin[i] : begin[i + 1]] for i in range(self.count)]
        self.sets = doc[np.argsort(token, kind="stable")]
        length = np.bincount(token, minlength=len(times))
        start = np.cumsum(length) - length
        self.blocks = -(-length // LIST_BLOCK)
        self.first = np.cumsum(self.blocks) - self.blocks
        within = np.arange(self.blocks.sum()) - np.repeat(self.first, self.blocks)
        self.start = np.repeat(start, self.blocks) + LIST_BLOCK * within
        self.end = np.minimum(self.start + LIST_BLOCK, np.repeat(start + length, self.blocks))
        self.least, self.most = self.sets[self.start], self.sets[self.end - 1]

    def overlaps(self, tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of the tokens each set has; right for sets in [low, high), other blocks are skipped."""
        b = _slices(self.first[tokens], self.first[tokens] + self.blocks[tokens])
        b = b[(self.most[b] >= low) & (self.least[b] < high)]
        return np.bincount(self.sets[_slices(self.start[b], self.end[b])], minlength=self.count)


def link_sets(sets: list[np.ndarray], num: int, den: int, *, probe: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what Jaccard >= num / den connects, as (position, position) pairs.

    Only sets in ``probe`` (a mask; without it, all) are held against the others. Sets of equal
    ``known`` are connected already.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    component = np.arange(len(order)) if known is None else np.unique(known, return_inverse=True)[1][order]
    lists = Lists([sets[i] for i in order])
    links: list[tuple[int, int]] = []
    answered: list[tuple[np.ndarray, np.ndarray, int, int]] = []  # a set's tokens, its overlaps, where they hold
    for i in range(len(order)) if probe is None else np.flatnonzero(probe[order]):
        own = lists.own[i]
        low = i + 1 if probe is None else int(np.searchsorted(size, needed(int(size[i]), num, den)))
        high = int(np.searchsorted(size, size[i] * den // num, side="right"))
        others = low + np.flatnonzero(component[low:high] != component[i])
        if not len(others) or not len(own):
            continue
        like = max((c for c in answered if c[2] <= i < c[3] and c[2] <= low and c[3] >= high), key=lambda c: c[1][i], default=None)
        if like is not None and 4 * like[1][i] > 3 * max(len(own), len(like[0])):
            holds = like[2:]
            row = like[1] + lists.overlaps(np.setdiff1d(own, like[0], assume_unique=True), *holds) - lists.overlaps(np.setdiff1d(like[0], own, assume_unique=True), *holds)
        else:  # as far as the sets that may be derived from this one need it
            holds = (i if probe is None else int(np.searchsorted(size, size[i] * num * num // (den * den))), int(np.searchsorted(size, size[i] * den * den // (num * num), side="right")))
            row = lists.overlaps(own, *holds)
        answered = [*answered[1 - KEPT :], (own, row, *holds)]
        for j in others[overlaps_enough(row[others], size[i], size[others], num, den)].tolist():
            if component[i] != component[j]:
                component[component == component[j]] = component[i]
                links.append((int(order[i]), int(order[j])))
    return links


def united(edges: DataFrame) -> DataFrame:
    """Edges (a, b) replaced, within each partition, by one from each node to the least it reaches there."""

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def out() -> pd.DataFrame:
            return pd.DataFrame([(x, top(x)) for x in list(up) if top(x) != x], columns=["a", "b"])

        for pdf in batches:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > NODES:
                yield out()
                up = {}
        yield out()

    kind = edges.schema["a"].dataType.simpleString()
    return edges.mapInPandas(stars, f"a {kind}, b {kind}")


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over links (a, b).

    Large and small star steps by turns, each after a union-find within the partitions: every node gives
    its larger neighbours, then its smaller ones and itself, to the smallest node beside it, until each tree
    is a star. Rounds grow with the logarithm of the nodes, also for long chains, and there are never more
    rows than links. Smallest neighbours are settled before they are joined, so that Spark can split the
    rows of a large star's centre.
    """

    def least_of(rows: DataFrame) -> DataFrame:
        return settle(rows.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("least")))

    edges = settle(united(links.select("a", "b").where("a <> b")).distinct())
    while True:
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if not ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below + above > 1").take(1):
            break
        large = edges.join(least_of(edges), F.col("b") == F.col("at"), "left").select("a", F.coalesce("least", "b").alias("b"))
        large = settle(large.distinct())
        below = least_of(large)
        small = large.join(below, F.col("a") == F.col("at")).where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = settle(united(small.unionByName(below.select(F.col("at").alias("a"), F.col("least").alias("b")))).distinct())
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(centres)


def contents(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``wanted`` (row_key, ...) with ``data``, the packed sets of these rows. A filter of fixed size keeps
    all other texts out before any shuffle."""
    bit = F.pmod(F.xxhash64("row_key"), F.lit(FILTER_BITS))
    words = wanted.select(F.floor(bit / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words["w"].to_numpy()] = words["m"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, bits = Shingles(n), shared.value
        for batch in batches:
            at = batch["bit"].to_numpy()
            hits = np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)
            if len(hits):
                part = batch.take(pa.array(hits))
                yield pa.RecordBatch.from_arrays([part["row_key"], pa.array([packed(make(t.as_py())) for t in part["text"]], pa.binary())], names=["row_key", "data"])

    keyed = docs.select(row_key().alias("row_key"), "text").select("row_key", bit.alias("bit"), "text")
    return keyed.mapInArrow(rows, "row_key binary, data binary").join(wanted, "row_key")


def linked(tasks: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of set ids. ``tasks``: one, two, three (a task), set_id, data, probe, component (may be
    null); sets that are not probes are not held against each other."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["set_id", "probe"]).sort_values(["set_id", "probe"])
        ids, probe = pdf["set_id"].tolist(), pdf["probe"].to_numpy(bool)
        known = np.array([c or i for c, i in zip(pdf["component"], ids, strict=True)])
        found = link_sets([unpacked(x) for x in pdf["data"]], num, den, probe=None if probe.all() else probe, known=known) if len(pdf) > 1 else []
        return pd.DataFrame([(ids[a], ids[b]) for a, b in found], columns=["a", "b"])

    return tasks.groupBy("one", "two", "three").applyInPandas(links, "a binary, b binary")


def in_rounds(sets: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """All links of the groups that are too large for a task, given those found within their blocks.

    ``sets``: label, band, part, parts, n, set_id, data. A band is as wide as the size bound, so a set
    can only be linked within its band and with the next ones. Most of a large group hangs together
    through some set that many resemble: of each group and band the set with most links is held against
    all blocks first. What then is outside the group's largest component is held, block by block, against
    all blocks of its own and the next bands; copies grow with these rests only, not with the group.
    """
    near = lambda left, right: F.abs(left - right) <= 1
    blocks = settle(sets.select("label", "band", "parts").distinct())
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    degree = links.groupBy(F.col("a").alias("set_id")).agg(F.count("*").alias("degree"))
    ids, data = settle(sets.drop("data")), sets.select("set_id", "data").dropDuplicates(["set_id"])
    hubs = ids.join(degree, "set_id").groupBy("label", "band").agg(F.max_by("set_id", F.struct("degree", "set_id")).alias("set_id"))
    hubs = stored(hubs)[0].join(data, "set_id").select("label", "band", F.struct("set_id", "data").alias("hub"))
    to = hubs.withColumnRenamed("band", "own").join(blocks, "label").where(near(F.col("own"), F.col("band"))).select("label", "band", every, "hub.*", F.lit(True).alias("probe"))
    each = sets.select("label", "band", "part", "set_id", "data", F.lit(False).alias("probe"))

    def placed(rows: DataFrame, third: Column) -> DataFrame:
        return rows.select(F.col("label").alias("one"), F.xxhash64("band", "part").alias("two"), third.alias("three"), "set_id", "data", "probe", "component")

    none = F.lit(None).cast("binary")
    links = settle(links.unionByName(linked(placed(each.unionByName(to).withColumn("component", none), F.lit(0).cast("long")), num, den)))
    labels = smallest_reachable(links).select(F.col("node").alias("set_id"), F.col("label").alias("component"))
    named = settle(ids.join(labels, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")))
    counts = named.groupBy("label", "component").agg(F.count("*").alias("k"))
    largest = counts.groupBy("label").agg(F.max_by("component", F.struct("k", "component")).alias("largest"))
    rest = settle(named.join(largest, "label").where("component <> largest").select("label", F.col("band").alias("own"), "n", "set_id", "component"))
    if not rest.take(1):
        return links
    cuts = rest.groupBy("label", "own").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("cuts"))
    cuts = settle(cuts)
    cut = F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("cuts")).alias("cut")
    ours = rest.join(cuts, ["label", "own"]).select("label", "own", cut, "set_id", "component").join(blocks, "label").where(near(F.col("own"), F.col("band")))
    ours = ours.select("label", "own", "cut", "band", every, "set_id", "component", F.lit(True).alias("probe")).join(data, "set_id")
    theirs = named.join(cuts, "label").where(near(F.col("own"), F.col("band")))
    theirs = theirs.select("label", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"), "band", "part", "set_id", "component", F.lit(False).alias("probe")).join(data, "set_id")
    return settle(links.unionByName(linked(placed(ours.unionByName(theirs), F.xxhash64("own", "cut")), num, den)))


def led(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): each set of a list, by size, with the list's first. A list ends where the next set is too
    large to be linked with the one before."""
    size = F.col("code").bitwiseAND(F.lit(SIZE_BITS))
    by = Window.partitionBy("tuple").orderBy("size", "code")
    begins = F.coalesce(F.col("size") - F.lag("size").over(by) > math.ceil(64 * math.log2(den / num)), F.lit(True))
    rows = entries.where("tuple is not null").select("tuple", "code", size.alias("size")).withColumn("_first", F.when(begins, F.col("code")))
    return rows.select(F.col("code").alias("a"), F.last("_first", True).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("b")).where("a <> b")


def components(docs: DataFrame, *, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(row_key, doc_id, n_shingles, component_id, component) for each row of ``docs``.

    Sets with Jaccard >= num / den are linked. ``component`` is a name of the component, null without
    shingles; ``component_id`` its smallest id.
    """
    first, folder = stored(listed(docs, n, num, den))
    merged, leaders = first.where("least is not null").select(F.col("code").alias("a"), F.col("least").alias("b")), led(first, num, den)
    rows = settle(first.where("row_key is not null").select("row_key", "doc_id", "n_shingles", "set_id", "code"))
    merged, leaders = settle(merged.distinct()), settle(leaders.distinct())
    discard(folder)
    groups = smallest_reachable(merged.unionByName(leaders))
    wanted = rows.join(groups, F.col("code") == F.col("node")).groupBy("set_id").agg(F.min("row_key").alias("row_key"), F.min("n_shingles").alias("n"), F.min("code").alias("code"), F.min("label").alias("label"))
    wanted = settle(wanted)
    size = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("parts")

    def split(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of groups that fit, and of others."""
        large = members.groupBy("label").agg(size).where("parts > 1").select("label")
        return members.join(large, "label", "left_anti"), members.join(large, "label", "left_semi")

    none = F.lit(None).cast("long")
    whole, rest = split(wanted)
    if rest.take(1):
        own = leaders.unionByName(merged).unionByName(merged.join(leaders.toDF("_b", "_led"), F.col("b") == F.col("_b")).select("a", F.col("_led").alias("b")))
        own = own.unionByName(own.select(F.col("b").alias("a"), "b")).distinct().select(F.col("a").alias("code"), F.col("b").alias("_led"))
        lists, rest = split(settle(rest.join(own, "code").withColumn("label", F.col("_led")).drop("_led").distinct()))
        whole = whole.unionByName(lists)
    banded = rest.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))))
    cut = banded.join(banded.groupBy("label", "band").agg(size), ["label", "band"]).withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")))
    cut = settle(cut)
    placed = whole.withColumns({"band": none, "parts": none, "part": none}).unionByName(cut)
    tasks = contents(docs, placed, n).select(F.col("label").alias("one"), F.xxhash64("band", "part").alias("two"), F.lit(0).cast("long").alias("three"), "set_id", "data", F.lit(True).alias("probe"), F.lit(None).cast("binary").alias("component"))
    links = settle(linked(tasks, num, den))
    if cut.take(1):
        sets, own = stored(contents(docs, cut, n).drop("row_key"))
        links = in_rounds(sets, links, num, den)
        discard(own)
    labels = smallest_reachable(links)
    classes = rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    named = classes.join(labels, F.col("set_id") == F.col("node"), "left").select("set_id", "rep", F.coalesce("label", "set_id").alias("component"))
    named = settle(named)
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("set_id", "component_id", "component")
    return rows.join(named, "set_id", "left").select("row_key", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component")
