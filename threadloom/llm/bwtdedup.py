"""Removal of long repeated byte strings by backward extension of suffix intervals.

1. Every window of ``length`` bytes has an anchor: the leftmost of its ``GRAM``-byte grams with the
   smallest hash. It follows from the window's bytes alone, so equal windows have equal anchors.
   Neighbouring windows with one anchor form a fragment; a text is a chain of fragments.
2. Fragments are counted by their anchor's hash. What stands alone can't repeat. Where all fragments of
   an anchor are equal, all their windows repeat. The rest is mixed; of equal fragments one goes on.
3. Mixed fragments meet in shards by anchor. There, windows are grouped by their last bytes, in suffix
   order, and the groups extended backward, a byte at a time and all at once: the windows of a group,
   stably sorted by the byte before (the step from a row of the Burrows-Wheeler transform to the row of
   the preceding suffix), fall into the groups of the next length. Groups of one window are dropped, and
   at the threshold the search stops: what is left repeats. Common lengths are found in rising order.
4. An anchor with more than ``HOT`` different fragments goes another, distributed way: ranges of window
   offsets, whose common and united bytes are counted by hash, are halved as long as their common bytes
   repeat and the united ones don't. It is exact too, and a fragment takes part with few rows.
5. Each document gets back its covered intervals and drops them.

Defined cases: null text counts as empty; texts shorter than the threshold stay whole; rows with equal id
and text repeat each other; matches never cross documents; empty tables give empty results; other columns
are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import settle, small_batches

GRAM = 32
#: Different fragments of one anchor that a task takes at most, and bytes of fragments a shard should hold.
HOT, SHARD_BYTES = 2_000, 3_000_000
_BLOCK = 1 << 20
_POSITION_BITS = 24  # a place within a block
_BYTE_HASH = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes (a power of two)."""
    h, size = _BYTE_HASH[raw], 1
    for odd in _ODD:
        h = h[:-size] * odd + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
    return h


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    m, have = keys, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` bytes the place of its anchor, and the hash there."""
    width, windows = length - GRAM + 1, len(raw) - length + 1
    at, hashes = [], []
    for lo in range(0, max(0, windows), _BLOCK):
        h = gram_hashes(raw[lo : min(len(raw), lo + _BLOCK + length - 1)])
        low = np.uint64((1 << _POSITION_BITS) - 1)
        place = (window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), width) & low).astype(np.int64)
        at.append(place + lo)
        hashes.append(h[place])
    return (np.concatenate(at), np.concatenate(hashes)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def fragments(text: str | None, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor hash, fragment hash, first window, windows - 1, anchor's offset) of a text."""
    data = (text or "").encode()
    if len(data) < length:
        return
    at, hashes = anchors(np.frombuffer(data, np.uint8), length)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    for g, lo, hi, p in zip(hashes[first].astype(np.int64).tolist(), first.tolist(), last.tolist(), at[first].tolist(), strict=True):
        f = xxhash.xxh3_64_intdigest(data[lo : hi + length], seed=p - lo)
        yield g, f - (1 << 64) if f >> 63 else f, lo, hi - lo, p - lo


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text its windows that stand twice or more in all of them: interval expansion.

    ``start`` holds the windows in suffix order of their last ``depth`` bytes; ``group`` marks where a new
    interval begins.
    """
    base = np.cumsum([0, *(len(t) for t in texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    counts = [max(0, len(t) - length + 1) for t in texts]
    start = np.concatenate([np.arange(b, b + n) for b, n in zip(base, counts, strict=False)]) if texts else np.zeros(0, np.int64)
    depth = min(8, length)
    key = np.zeros(len(start), np.uint64)
    for k in range(depth):
        key = (key << np.uint64(8)) | data[start + (length - depth + k)]
    order = np.argsort(key, kind="stable")
    start, key = start[order], key[order]
    new = np.diff(key, prepend=key[:1] ^ np.uint64(1)) != 0

    def several(start: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without intervals of one window."""
        alone = new & np.append(new[1:], True)
        return (start[~alone], new[~alone]) if alone.any() else (start, new)

    start, new = several(start, new)
    while depth < length and len(start):
        depth += 1
        interval = np.cumsum(new)
        symbol = data[start + (length - depth)]
        order = np.argsort(symbol, kind="stable")
        start, symbol, interval = start[order], symbol[order], interval[order]
        new = np.ones(len(start), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        start, new = several(start, new)
    start = np.sort(start)
    cut = np.searchsorted(start, base)
    return [start[a:b] - base[i] for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered intervals of sorted window starts; neighbours are merged."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [(int(a), int(b) + length) for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)]


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(rk, *f) for rk, t in zip(pdf["rk"], pdf["text"], strict=True) for f in fragments(t, length)]
            yield pd.DataFrame(out, columns=["rk", "g", "f", "first", "more", "off"])

    return docs.select("rk", "text").mapInPandas(rows, "rk long, g long, f long, first long, more int, off int")


def halved(hot: DataFrame, length: int) -> DataFrame:
    """(rk, lo, hi) covered in fragments of hot anchors. ``hot``: g, c, rk, first, data, at (the anchor's
    place in data), p (its place in the text), more (windows - 1).

    A row stands for the windows of a fragment that start ``lo`` to ``hi`` bytes before the anchor. Rows
    whose united bytes repeat are covered; one of equal ones stays as a reference for others, as long as
    rows that share its common bytes are open.
    """
    width = length - GRAM + 1
    rows = hot.withColumn("lo", F.lit(0)).withColumn("hi", F.lit((1 << (width - 1).bit_length()) - 1)).withColumn("ref", F.lit(False))
    covered = None

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            common, united = [], []
            for data, at, more, lo, hi in zip(pdf["data"], pdf["at"], pdf["more"], pdf["lo"], pdf["hi"], strict=True):
                inside = at - more <= lo and hi <= at
                united.append(xxhash.xxh3_128_hexdigest(data[at - hi : at - lo + length]) if inside else None)
                a, b = at - lo, at - hi + length
                common.append(xxhash.xxh3_128_hexdigest(data[a:b]) if 0 <= a and b <= len(data) and b - a >= GRAM else None)
            yield pdf.assign(common=common, united=united)

    own = ("g", "c", "rk", "first", "data", "at", "p", "more", "lo", "hi", "ref")
    schema = "g long, c long, rk long, first long, data binary, at int, p long, more int, lo int, hi int, ref boolean, common string, united string"
    weight = F.sum(F.least("c", F.lit(2)))
    while True:
        level = rows.where((F.col("lo") <= F.col("at")) & (F.col("hi") >= F.col("at") - F.col("more"))).select(*own).mapInPandas(keyed, schema)
        level = settle(level)
        if not level.where("not ref").take(1):
            break
        us = level.where("united is not null").groupBy("g", "lo", "united").agg(weight.alias("nu"))
        seen = level.join(us, ["g", "lo", "united"], "left").withColumn("done", F.coalesce(F.col("nu"), F.lit(0)) >= 2)
        cs = seen.where("common is not null").groupBy("g", "lo", "common").agg(weight.alias("nc"), F.count_if(~F.col("done") & ~F.col("ref")).alias("waiting"))
        seen = settle(seen.join(cs, ["g", "lo", "common"], "left"))
        new = seen.where("done and not ref").select("rk", (F.col("p") - F.col("hi")).alias("lo"), (F.col("p") - F.col("lo") + length).alias("hi"))
        covered = new if covered is None else covered.unionByName(new)
        still = seen.where("not done and not ref and (common is null or nc >= 2)")
        refs = seen.where("(done or ref) and waiting > 0").dropDuplicates(["g", "lo", "united"]).withColumns({"ref": F.lit(True), "c": F.lit(2).cast("long")})
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi"))))
        rows = still.unionByName(refs).where("hi > lo").withColumn("_h", halves).withColumns({"lo": F.col("_h.lo"), "hi": F.col("_h.hi")})
    return covered if covered is not None else hot.select("rk", F.col("p").alias("lo"), F.col("p").alias("hi")).limit(0)


def dedup_bytes(docs: DataFrame, *, length: int = 200, hot_fragments: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row; kept are the bytes that stay."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", "text")
    found = occurrences(texts, length)
    several = settle(found.groupBy("g").agg(F.count("*").alias("n"), F.min("f").alias("a"), F.max("f").alias("b")).where("n > 1").select("g", (F.col("a") != F.col("b")).alias("mixed")))
    found = settle(found.join(several, "g"))
    end = F.col("first") + F.col("more") + length
    same = found.where("not mixed").select("rk", F.col("first").alias("lo"), end.alias("hi"))
    mixed = found.where("mixed").groupBy("g", "f").agg(F.count("*").alias("c"), F.min(F.struct("rk", "first", "more", "off")).alias("one"))
    mixed = settle(mixed.select("g", "f", "c", "one.*"))
    again = found.where("mixed").join(mixed.where("c > 1").select("g", "f"), ["g", "f"]).select("rk", F.col("first").alias("lo"), end.alias("hi"))
    hot = settle(mixed.groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") > hot_fragments).select("g"))
    size = mixed.agg(F.sum(F.col("more") + length)).first()[0] or 0
    shards = max(1, -(-int(size) // SHARD_BYTES))
    wanted = mixed.join(hot.withColumn("is_hot", F.lit(True)), "g", "left").groupBy("rk").agg(F.collect_list(F.struct("g", "c", "first", "more", "off", F.coalesce("is_hot", F.lit(False)).alias("hot"))).alias("parts"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rk, text, parts in zip(pdf["rk"], pdf["text"], pdf["parts"], strict=True):
                data = (text or "").encode()
                for x in parts:
                    p = x["first"] + x["off"]
                    out.append((rk, x["g"], x["c"], x["first"], x["off"], p, x["more"], x["hot"], data[x["first"] : x["first"] + x["more"] + length]))
            yield pd.DataFrame(out, columns=["rk", "g", "c", "first", "at", "p", "more", "hot", "data"])

    def expanded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["rk", "first"])
        out = [(rk, first + a, first + b) for rk, first, w in zip(pdf["rk"], pdf["first"], repeated_windows(pdf["data"].tolist(), length), strict=True) for a, b in runs(w, length)]
        return pd.DataFrame(out, columns=["rk", "lo", "hi"])

    parts = texts.join(wanted, "rk").select("rk", "doc_id", "text", "parts").mapInPandas(cut, "rk long, g long, c long, first long, at int, p long, more int, hot boolean, data binary")
    spans = parts.where("not hot").groupBy(F.pmod(F.xxhash64("g"), F.lit(shards)).alias("shard")).applyInPandas(expanded, "rk long, lo long, hi long")
    spans = spans.unionByName(same).unionByName(again)
    if hot.take(1):
        spans = spans.unionByName(halved(settle(parts.where("hot")), length))
    spans = spans.groupBy("rk").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def dropped(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for own, lists in batches:
            out = []
            for text, list_ in zip(own, lists, strict=True):
                data = (text or "").encode()
                merged: list[list[int]] = []
                for s in list_ if list_ is not None else ():
                    if merged and s["lo"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["hi"])
                    else:
                        merged.append([s["lo"], s["hi"]])
                edges = [0, *(e for m in merged for e in m), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(merged), kept))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return texts.join(spans, "rk", "left").select("doc_id", "text", "spans").withColumn("_d", dropped("text", "spans")).select("doc_id", "_d.*")

