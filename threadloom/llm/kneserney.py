"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over words (runs of anything but ASCII white space), order ``ORDER``, and has as many entries
as trusted text has n-grams: nothing is cut off, nothing of it passes through the driver but the counts of
counts and its ``HOT`` most frequent entries. N-grams are 64-bit hashes. Tasks count them, the counts are summed
by n-gram; continuation counts, discounts, context totals and interpolated probabilities follow by groupings
and joins by n-gram.

A word's log probability is that of the longest of its n-grams that is seen, and the log weights that the longer
contexts leave to it. That is a sum over n-grams that are looked up apart from each other: log p of the word; for
each context the log of the weight it leaves; and for each longer n-gram that is seen what it adds to its
context's weight and the probability one word shorter. So a document's n-grams, counted per document first, meet
the model's in one inner join, what is unseen drops out, and the sums are by document.

N-grams that are frequent in trusted text would be skewed keys and most of the rows: they go to all tasks and are
added up where the text is read. The others are joined in parts of the hashes, one after another, each of which
reads all texts, so that only one part's shuffle files stand at a time: one part for ``PART_CHARS`` characters of
trusted text, ``PARTS`` at most. A part's n-grams are dealt to tasks by ranges of the hashes, those of a block of
documents in one row as packed columns, and meet the range of the model there; what a range adds to a block's
documents goes back in one row, too, to where the block is added up. Bits by leading bits of the part's n-grams tell
most of the unseen ones where texts are read; those that pass drop out in the join.
A document is kept if its perplexity per word lies between two quantiles of trusted documents in its
language, which should be kept out of the model; quantiles are read from histograms of fixed bin width. By default only high perplexity is
rejected (``low`` = 0).

Defined cases: null texts and texts without words have perplexity null and are not kept; a language without
trusted documents takes the thresholds of all; without any trusted text all documents with words are kept;
repeated rows are scored alike; other columns are carried along, those named like the added ones replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import discard, settle, shared_folder

ORDER = 2
#: Width of a histogram bin of the log perplexity.
BIN = 0.002
#: N-grams that a task counts before it gives them on, texts whose n-grams it makes at a time.
MERGED, TEXTS = 1_000_000, 500
#: The most parts of the n-grams, a power of 2, and characters of trusted text for each; the most n-grams that all tasks hold.
PARTS, PART_CHARS, HOT = 8, 1 << 22, 1 << 17
#: Leading bits of a frequent n-gram that give its place; documents in a block, two bytes for each.
PLACE, BLOCK = 20, 1 << 16
#: The logarithm of the most bits that mark a part's n-grams, about eight for each.
MARKS = 28
#: Kinds of packed rows: a range's part of the model, n-grams of a block's documents, those documents, and what they add up to.
_MODEL, _GRAMS, _DOCS, _SUMS = range(4)
#: Words up to this many bytes are hashed together.
SHORT = 64
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x165667B19E3779F9)
_SPACE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
#: The first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The place of the text and a hash, not 0, of each word: MurmurHash64A's steps over eight bytes of all words at a time."""
    texts = texts.fill_null("").cast("large_string")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.zeros(offsets[-1] - offsets[0] + 8, np.uint8)  # eight bytes can be read from each place
    data[:-8] = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    solid, cut = ~_SPACE[data[:-7]], np.zeros(len(data) - 6, bool)
    solid[-1] = False
    cut[offsets] = True
    starts = np.flatnonzero(solid & (cut[:-1] | ~np.append(False, solid[:-1])))
    stops = np.flatnonzero(solid[:-1] & (cut[1:-1] | ~solid[1:])) + 1
    rows = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    eight, size = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)), stops - starts
    m, r = np.uint64(0xC6A4A7935BD1E995), np.uint64(47)
    h = size.astype(np.uint64) * m
    for j in range(0, min(SHORT, int(size.max(initial=0))), 8):
        own = np.flatnonzero(size > j) if j else slice(None)
        k = (eight[starts[own] + j] & _FIRST[np.minimum(size[own] - j, 8)]) * m
        h[own] = (h[own] ^ ((k ^ (k >> r)) * m)) * m
    h = (h ^ (h >> r)) * m
    h ^= h >> r
    for i in np.flatnonzero(size > SHORT):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]])
    return rows, np.maximum(h, np.uint64(1))


def _laid(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each word the places of its text and among all words laid out with order - 1 zeros before each text; the
    n-grams that end at each place, for n up to the order."""
    rows, words = _words(texts)
    at = np.arange(len(words)) + (rows + 1) * (order - 1)
    laid = np.zeros(len(words) + len(texts) * (order - 1), np.uint64)
    laid[at] = words
    levels = [laid]
    for k in range(1, order):
        g = np.zeros(len(laid), np.uint64)
        g[k:] = (levels[-1][k:] ^ (levels[-1][k:] >> np.uint64(31))) * _MIX[0] + laid[: len(laid) - k] * _MIX[1] + np.uint64(k * _MIX[2] % 2**64)
        levels.append(g ^ (g >> np.uint64(29)))
    return rows, at, levels


def grams(texts: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each word the place of its text, [g1, g2, ...] and [c2, c3, ...]: g_k the last k words, c_k the k - 1
    words before the last; a word of 0 stands for what lies before the text."""
    rows, at, levels = _laid(texts, order)
    return rows, [x[at].view(np.int64) for x in levels], [x[at - 1].view(np.int64) for x in levels[:-1]]


def names(order: int) -> list[str]:
    return ["g1", *(f"{c}{k}" for k in range(2, order + 1) for c in "gc")]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, TEXTS) for i in range(0, len(batch), TEXTS))


def _of_part(column: str, part: int, parts: int) -> Column:
    return F.col(column).bitwiseAND(F.lit(parts - 1)) == part


def count(texts: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """The distinct n-grams of the highest order with all their parts (``names``) and n, over all rows; a table
    for each part of them."""
    columns, size = names(order), texts.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    parts = min(PARTS, 1 << (size // PART_CHARS).bit_length())
    mask = parts - 1

    def counted(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            parts = dict(zip(columns, map(np.concatenate, zip(*held, strict=True)), strict=True))
            _, first, n = np.unique(parts[f"g{order}"], return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([*(pa.array(p[first]) for p in parts.values()), pa.array(n.astype(np.int64))], names=[*columns, "n"])

        for batch in batches:
            for piece in _pieces(batch):
                _, ends, contexts = grams(piece["text"], order)
                own = (ends[-1] & mask) == part
                made = {f"g{k + 1}": x for k, x in enumerate(ends)} | {f"c{k + 2}": x for k, x in enumerate(contexts)}
                held.append([made[c][own] for c in columns])
                size += len(held[-1][0])
                if size > MERGED:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    schema = ", ".join(f"{c} long" for c in [*columns, "n"])
    every = [texts.select("text").mapInArrow(lambda batches, part=part: counted(batches, part), schema) for part in range(parts)]
    return [rows.groupBy(*columns).agg(F.sum("n").alias("n")).sortWithinPartitions(columns[-1]) for rows in every]


def discounts(level: DataFrame) -> Column:
    """How much of each count goes to the lower order: modified Kneser-Ney, by counts of counts."""
    c = level.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    y = c.n1 / (c.n1 + 2 * c.n2) if c.n1 and c.n2 else 0.5
    d = [min(k, max(0.0, k - (k + 1) * y * c[k] / c[k - 1])) if c[k - 1] and c[k] else 0.5 * y for k in (1, 2, 3)]
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


class Table:
    """Rows in a shared folder, those of each part in a folder below it, written one after another."""

    def __init__(self, parts: Iterable[DataFrame]):
        self.folder, self.schema = None, None
        for k, df in enumerate(parts):
            self.spark, self.schema = df.sparkSession, df.schema
            self.folder = self.folder or f"{shared_folder(self.spark)}/stored-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{k}")
        self.folders = [f"{self.folder}/{i}" for i in range(k + 1)]

    def rows(self, part: int | None = None, by: str = "", parts: int = 1) -> DataFrame:
        """All rows, or those of one of so many parts: where there is but one folder, by the column ``by``."""
        whole = part is None or len(self.folders) == 1
        read = self.spark.read.schema(self.schema).parquet(*(self.folders if whole else self.folders[part : part + 1]))
        return read if part is None or not whole else read.where(_of_part(by, part, parts))


class Model:
    """Tables by order: seen[k] (g_k, n, p, adds, free), rest[k] (c_k, gamma, total); unknown: the probability of a word that
    trusted text lacks. None of them without trusted text. ``adds`` is what the n-gram adds to the log weight of its context and
    the log probability one word shorter (for a word: to that of an unknown one), and ``free`` whether that weight is 0, for
    which its log is taken as 0 and counted. They lie in folders until ``discard`` is called, once
    the scores are written; counts go as soon as they are used."""

    def __init__(self, counts: list[DataFrame], order: int = ORDER):
        self.order, self.seen, self.rest, self.unknown, self.folders = order, {}, {}, None, []
        self.parts, levels = len(counts), {order: self.keep(counts)}
        for k in range(order - 1, 0, -1):  # continuation counts: the words that an n-gram is seen after
            lower = names(k)
            levels[k] = self.keep([levels[k + 1].rows().groupBy(f"g{k}").agg(*(F.min(c).alias(c) for c in lower if c != f"g{k}"), F.count("*").alias("n"))])
        whole = levels[1].rows().agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
        if not whole.v:
            return
        for k in range(1, order + 1):
            off = discounts(levels[k].rows())
            if k == 1:
                held = levels[k].rows().agg(F.sum(off).alias("off")).first().off / whole.n
                self.unknown = held / (whole.v + 1)
                p = (F.col("n") - off) / whole.n + self.unknown
                self.seen[1] = self.keep([levels[1].rows().select("g1", "n", p.alias("p"), F.log(p / self.unknown if self.unknown else p).alias("adds"), F.lit(False).alias("free"))])
            else:
                totals = levels[k].rows().groupBy(f"c{k}").agg(F.sum("n").alias("total"), F.sum(off).alias("_held"))
                self.rest[k] = self.keep([totals.select(f"c{k}", (F.col("_held") / F.col("total")).alias("gamma"), "total")])
                self.seen[k] = self.keep(self.interpolated(k, levels[k], off))
            self.release(levels[k])

    def interpolated(self, k: int, level: Table, off: Column) -> Iterator[DataFrame]:
        below, left = self.seen[k - 1].rows().select(f"g{k - 1}", F.col("p").alias("_p")), self.rest[k].rows()
        p = (F.col("n") - off) / F.col("total") + F.col("gamma") * F.col("_p")
        adds = F.log(F.col("p") / F.col("_p") / F.when(F.col("gamma") > 0, F.col("gamma")).otherwise(1.0))
        for part in range(self.parts):
            own = level.rows(part, f"g{k}", self.parts).join(left.hint("shuffle_hash"), f"c{k}").join(below.hint("shuffle_hash"), f"g{k - 1}").withColumn("p", p)
            yield own.select(f"g{k}", "n", *["p"][: k < self.order], adds.alias("adds"), (F.col("gamma") == 0).alias("free"))
            if len(level.folders) > 1:
                discard(level.folders[part])

    def entries(self, part: int | None = None) -> DataFrame:
        """(gram, often, adds, free, log_gamma, none): what an n-gram adds where it ends at a word, and the log of what it
        leaves as a context, where ``none`` counts weights of 0; a row for each, the other's columns 0."""
        zero = F.lit(0.0)
        out = [t.rows(part, f"g{k}", self.parts).select(F.col(f"g{k}").alias("gram"), F.col("n").alias("often"), "adds", F.col("free").cast("int").alias("free"), zero.alias("log_gamma"), F.lit(0).alias("none")) for k, t in self.seen.items()]
        some = F.col("gamma") > 0
        out += [t.rows(part, f"c{k}", self.parts).select(F.col(f"c{k}").alias("gram"), F.col("total").alias("often"), zero.alias("adds"), F.lit(0).alias("free"), F.when(some, F.log("gamma")).otherwise(zero).alias("log_gamma"), F.when(some, 0).otherwise(1).alias("none")) for k, t in self.rest.items()]
        every = out[0]
        for more in out[1:]:
            every = every.unionByName(more)
        return every

    def frequent(self) -> list[np.ndarray]:
        """gram (ascending), adds, free, log_gamma, none of the most frequent n-grams, ``HOT`` at most, and of those
        with the same ``PLACE`` leading bits the most frequent one."""
        every = self.entries().withColumn("_bin", F.floor(16 * F.log2("often")))
        bins, most, taken = every.groupBy("_bin").agg(F.count("*").alias("n")).collect(), None, 0
        self.size = sum(r.n for r in bins)
        for r in sorted(bins, reverse=True):
            taken += r.n
            if taken > HOT:
                break
            most = r._bin
        keys = every.where(F.col("_bin") >= F.lit(most)).select("gram").distinct()
        values = ["adds", "free", "log_gamma", "none"]
        rows = every.join(F.broadcast(keys), "gram").groupBy("gram").agg(F.max("often").alias("often"), *(F.sum(c).alias(c) for c in values)).toArrow()
        gram, often = rows["gram"].to_numpy(), rows["often"].to_numpy()
        place = gram.view(np.uint64) >> np.uint64(64 - PLACE)
        by = np.lexsort((-often, place))
        by = by[np.append(True, place[by][1:] != place[by][:-1])[: len(by)]]
        return [gram[by].view(np.uint64), *(rows[c].to_numpy()[by] for c in values)]

    def marks(self, part: int) -> np.ndarray:
        """A bit for each value of the leading bits: whether an n-gram of the part has it; 64 to a number."""
        bits = min(MARKS, max(6, (8 * self.size // self.parts).bit_length()))
        at = f"shiftrightunsigned(gram, {64 - bits})"
        words = self.entries(part).groupBy(F.expr(f"{at} div 64").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, int({at} & 63)))").alias("bits")).toArrow()
        marks = np.zeros(1 << bits - 6, np.int64)
        marks[words["word"].to_numpy()] = words["bits"].to_numpy()
        return marks.view(np.uint64)

    def keep(self, parts: Iterable[DataFrame]) -> Table:
        held = Table(parts)
        self.folders.append(held)
        return held

    def release(self, held: Table) -> None:
        self.folders.remove(held)
        discard(held.folder)

    def discard(self) -> None:
        while self.folders:
            self.release(self.folders[-1])


def _own() -> Column:
    return F.xxhash64("doc_id", "text")


def _places(keys: np.ndarray) -> np.ndarray:
    """By the leading bits: where among the keys the one with these bits is; elsewhere 0."""
    places = np.zeros(1 << PLACE, np.int32)
    places[keys >> np.uint64(64 - PLACE)] = np.arange(len(keys))
    return places


def _looked_up(keys: np.ndarray, places: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each is among the keys, and where."""
    if not len(keys):
        return np.zeros(len(sought), bool), np.zeros(len(sought), np.int32)
    at = places[sought >> np.uint64(64 - PLACE)]
    return keys[at] == sought, at


def _marked(marks: np.ndarray, sought: np.ndarray) -> np.ndarray:
    at = sought >> np.uint64(64 - (len(marks).bit_length() + 5))
    return (marks[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length as bytes: all first ones of a column, all second ones and so on, which compress."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns if len(c))


def _unpacked(data: memoryview, *types: str) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    n, start, out = len(data) // sum(sizes), 0, []
    for t, size in zip(types, sizes, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, start).reshape(size, n).T).view(t).ravel())
        start += n * size
    return out


_ROW = "range int, kind int, block long, data binary"
_OF = {_MODEL: ("u8", "f8", "u1", "f8", "u1"), _GRAMS: ("u8", "u2", "u4", "u4"), _DOCS: ("i8", "i8", "f8", "i8"), _SUMS: ("u2", "f8", "i8")}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"range": pa.int32(), "kind": pa.int32(), "block": pa.int64(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in ("range", "kind", "block")), (memoryview(x.as_buffer()) for x in batch["data"]), strict=True)


def _dealt(gram: np.ndarray, ranges: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each range that has some: its number, where they are, and the n-grams less what all of the range's part share."""
    n, half = np.uint64(ranges), np.uint64(32)
    of = ((gram >> half) * n >> half).astype(np.uint16 if ranges <= 1 << 16 else np.int64)
    by = np.argsort(of, kind="stable")
    stops = np.cumsum(np.bincount(of, minlength=ranges))
    for r in np.flatnonzero(np.diff(stops, prepend=0)).tolist():
        own = by[stops[r - 1] if r else 0 : stops[r]]
        least = np.uint64(-(-(r << 32) // ranges) << 32)
        yield r, own, (gram[own] - least) >> np.uint64(bits)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))[: len(columns[0])])


def _steps(x: np.ndarray) -> np.ndarray:
    """From each to the next, modulo 65,536: sums of two bytes are the numbers."""
    return np.diff(x, prepend=0).astype(np.uint16)


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy("_own").agg(*(F.sum(c).alias(c) for c in "nsz"))


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """(_own, perplexity) of each document with words, by a hash of id and text."""
    order, mask, bits, spark = model.order, np.uint64(model.parts - 1), model.parts.bit_length() - 1, docs.sparkSession
    texts, sums = docs.select(_own().alias("_own"), "text"), "_own long, n long, s double, z long"
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                n = np.bincount(_words(piece["text"])[0], minlength=len(piece))
                zero = np.zeros(len(piece), np.int64)
                yield pa.RecordBatch.from_arrays([piece["_own"], pa.array(n), pa.array(zero.astype(float)), pa.array(zero)], names=["_own", "n", "s", "z"]).filter(pa.array(n > 0))

    if model.unknown is None:
        return _added(texts.mapInArrow(words, sums)).select("_own", F.lit(1.0).alias("perplexity"))
    hot = spark.sparkContext.broadcast(model.frequent())

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The part's model by ranges."""
        held, size = [], 0

        def out() -> pa.RecordBatch:
            gram, adds, free, log_gamma, none = map(np.concatenate, zip(*held, strict=True))
            return _batch([(r, _MODEL, 0, _packed(key, adds[own], free[own], log_gamma[own], none[own])) for r, own, key in _dealt(gram, ranges, bits)])

        for batch in batches:
            held.append([batch[c].to_numpy().astype(t) for c, t in zip(("gram", "adds", "free", "log_gamma", "none"), _OF[_MODEL], strict=True)])
            size += len(batch)
            if size > MERGED:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def rare(batches: Iterator[pa.RecordBatch], part: int, marks: Broadcast) -> Iterator[pa.RecordBatch]:
        """The part's n-grams that are not frequent by ranges: for each document how often they end at a word and are a
        context. With the first part go numbers of words and sums of frequent n-grams."""
        keys, adds, free, log_gamma, none = hot.value
        places, held, made, size = _places(keys), [], [], 0

        def out() -> pa.RecordBatch:
            own, n, s, z = map(np.concatenate, zip(*held, strict=True))
            data = _packed(own, n, s, z)
            block = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)  # the same documents, should the task run again
            rows, most = [(block % ranges, _DOCS, block, data)], 4 * size // ranges + 1000
            gram, doc, end, context = map(np.concatenate, zip(*made, strict=True))
            for r, at, key in _dealt(gram, ranges, bits):
                doc_, end_, context_ = doc[at], end[at].astype(np.uint32), context[at].astype(np.uint32)
                if len(at) > most:  # one that is frequent in these documents only
                    by = np.lexsort((key, doc_))
                    first = _firsts(key[by], doc_[by])
                    key, doc_, end_, context_ = key[by][first], doc_[by][first], np.add.reduceat(end_[by], first), np.add.reduceat(context_[by], first)
                rows.append((r, _GRAMS, block, _packed(key, _steps(doc_), end_, context_)))
            return _batch(rows)

        docs_ = 0
        for batch in batches:
            for piece in _pieces(batch):
                rows, at, levels = _laid(piece["text"], order)
                n = np.bincount(rows, minlength=len(piece))
                row = np.repeat(np.arange(len(piece)), n + order - 1)
                ends = np.zeros(len(row) + 1, np.uint8)
                ends[at] = 1
                ends, contexts = ends[:-1], ends[1:]  # a context is where the next place has a word; zeros stand between texts
                s, z = np.zeros(len(piece)), np.zeros(len(piece), np.int64)
                for k, gram in enumerate(levels):
                    leaves = contexts if k < order - 1 else np.zeros_like(contexts)
                    counts = (ends | leaves).view(bool)
                    sought = np.flatnonzero(counts if part == 0 else counts & ((gram & mask) == np.uint64(part)))
                    x = gram[sought]
                    found, place = _looked_up(keys, places, x)
                    if part == 0:
                        w, place = sought[found], place[found]
                        e, c = ends[w].astype(np.int64), leaves[w].astype(np.int64)
                        s += np.bincount(row[w], e * adds[place] + c * log_gamma[place], len(piece))
                        z += np.bincount(row[w], c * none[place] - e * free[place], len(piece)).astype(np.int64)
                        found |= (x & mask) != 0
                    left = sought[~found]
                    left = left[_marked(marks.value, gram[left])]
                    made.append((gram[left], row[left] + docs_, ends[left], leaves[left]))
                    size += len(left)
                held.append((piece["_own"].to_numpy(), n if part == 0 else np.zeros_like(n), s, z))
                docs_ += len(piece)
                if size > MERGED or docs_ + TEXTS > BLOCK:
                    yield out()
                    held, made, size, docs_ = [], [], 0, 0
        if docs_:
            yield out()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a range adds to the documents of each block; the model's rows of a range come first."""
        at_range, held, model_ = None, [], None
        for range_, kind, block, data in _each(batches):
            if range_ != at_range:
                at_range, held, model_ = range_, [], None
            if kind == _MODEL:
                held.append(_unpacked(data, *_OF[kind]))
                continue
            if kind == _DOCS:
                yield _batch([(0, kind, block, bytes(data))])
                continue
            if not held:
                continue
            if model_ is None:
                model_ = [np.concatenate(c) for c in zip(*held, strict=True)]
                by = np.argsort(model_[0])
                first = _firsts(model_[0][by])
                model_ = [model_[0][by][first], *(np.add.reduceat(c[by].astype("f8"), first) for c in model_[1:])]
            key, doc, end, context = _unpacked(data, *_OF[kind])
            keys, adds, free, log_gamma, none = model_
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == key)
            if len(hit):
                doc = np.cumsum(doc, dtype=np.uint16)[hit]
                by = np.argsort(doc, kind="stable")
                hit, doc = hit[by], doc[by]
                at, end, context = at[hit], end[hit].astype("f8"), context[hit].astype("f8")
                first = _firsts(doc)
                s, z = np.add.reduceat(end * adds[at] + context * log_gamma[at], first), np.add.reduceat(context * none[at] - end * free[at], first)
                yield _batch([(0, _SUMS, block, _packed(_steps(doc[first]), s, z.astype(np.int64)))])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's documents with what all ranges add; the documents' rows of a block come first."""
        block, columns = None, None

        def out() -> pa.RecordBatch:
            own, n, s, z, some = columns
            return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (own, n, s, z)], names=["_own", "n", "s", "z"])

        for _, kind, block_, data in _each(batches):
            if block_ != block:
                if columns:
                    yield out()
                block, columns = block_, None
            if kind == _DOCS:
                own, n, s, z = _unpacked(data, *_OF[kind])
                if columns:  # other rows of the same documents
                    n, s, z = n + columns[1], s + columns[2], z + columns[3]
                columns = [own, n, s, z, n > 0]
                continue
            if not columns:
                raise ValueError("the rows of a task came in another order when it ran again")
            doc, s, z = _unpacked(data, *_OF[kind])
            at = np.cumsum(doc, dtype=np.uint16)
            columns[2][at] += s
            columns[3][at] += z
            columns[4][at] = True
        if columns:
            yield out()

    total = None
    for part in range(model.parts):
        marks = spark.sparkContext.broadcast(model.marks(part))
        dealt = texts.mapInArrow(lambda batches, part=part, marks=marks: rare(batches, part, marks), _ROW).unionByName(model.entries(part).drop("often").mapInArrow(entries, _ROW))
        back = dealt.repartitionById(ranges, "range").sortWithinPartitions("range", "kind").mapInArrow(met, _ROW)
        found = back.repartition(ranges, "block").sortWithinPartitions("block", "kind").mapInArrow(summed, sums)
        before, total = total, model.keep([_added(found if total is None else found.unionByName(total.rows()))])
        marks.destroy()
        if before:
            model.release(before)
    total = total.rows()
    mean = F.col("s") / F.col("n") + F.lit(float(np.log(model.unknown or 1.0)))
    return total.select("_own", F.when(F.col("z") > 0, float("inf")).otherwise(F.exp(-mean)).alias("perplexity"))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without text, with perplexity."""
    held = perplexities(docs, model).toDF("_kneserney_hash_", "perplexity")
    rows = docs.drop("perplexity").withColumn("_kneserney_own_", _own()).drop("text")
    return rows.join(held, rows["_kneserney_own_"] == held["_kneserney_hash_"], "left").drop("_kneserney_hash_", "_kneserney_own_")


def quantiles(scored_: DataFrame, low: float, high: float) -> DataFrame:
    """(lang, least, most) of log perplexity, from counts of its bins; one more row, all, for the rest."""
    bins = scored_.where(F.col("perplexity").isNotNull()).select("lang", F.floor(F.log("perplexity") / BIN).cast("long").alias("bin"))
    counts = bins.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    counts = counts.withColumn("all", F.lit(False)).unionByName(counts.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n", F.lit(True).alias("all")))
    own = Window.partitionBy("all", "lang")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    share = counts.select("all", "lang", "bin", (F.sum("n").over(upto) / F.sum("n").over(own)).alias("share"))
    return share.groupBy("all", "lang").agg((F.min(F.when(F.col("share") >= low, F.col("bin"))) * BIN).alias("least"), ((F.min(F.when(F.col("share") >= high, F.col("bin"))) + 1) * BIN).alias("most"))


def classify(scored_: DataFrame, trusted: DataFrame, *, low: float = 0.0, high: float = 0.99, margin: float = 0.02) -> DataFrame:
    """Add least, most (perplexities) and kept. ``margin`` widens both thresholds on the log scale."""
    q = settle(quantiles(trusted, low, high))
    whole = q.where("all").select(F.col("least").alias("_a"), F.col("most").alias("_b")).first()
    s, own = scored_.drop("least", "most", "kept").alias("s"), q.where("not all").withColumnRenamed("lang", "_lang").drop("all").alias("q")
    out = s.join(own, F.col("s.lang").eqNullSafe(F.col("q._lang")), "left")
    a, b = (whole._a, whole._b) if whole else (None, None)
    least = F.exp(F.coalesce("least", F.lit(a).cast("double")) - margin) if low > 0 else F.when(F.col("perplexity").isNotNull(), 0.0)
    out = out.withColumn("least", least).withColumn("most", F.exp(F.coalesce("most", F.lit(b).cast("double")) + margin))
    fits = F.coalesce(F.col("perplexity").between(F.col("least"), F.col("most")), F.col("perplexity").isNotNull())
    return out.withColumn("kept", fits).drop("_lang")
