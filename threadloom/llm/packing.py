"""Best-fit packing of token sequences by hierarchical residual packing.

Each task packs its own pieces best-fit in order of falling length and hands out the bins that are
nearly full. The rest - underfull bins - become items themselves and meet those of other tasks in
ever fewer partitions, round after round, until rounds stop paying. A task never holds more than
``ITEMS`` items: the number of partitions follows the number of items. Every round is settled in the
shared folder, so a lost executor costs a part of one round.

Defined cases: a null or empty text is the end id alone; rows with equal ids are packed each on its
own; empty tables give empty results.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import settle, small_batches

END_ID = 2
#: Items that one task packs at most (each is a bin of up to ``capacity`` pieces).
ITEMS = 50_000
#: A bin with at most this share of its capacity free is done.
NEARLY_FULL = 0.01

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "fill int, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"
SPECIAL = "<|endoftext|>"


@cache
def _encoders():
    import public_tokenizers as places
    import tiktoken
    from tokenizers import Tokenizer

    with open(places.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=places.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(places.path("byte_bpe_50k.json"))


def token_ids(text: str | None) -> np.ndarray:
    """Ids of a whole text and the end id. The same vocabulary in two libraries: the faster one, but
    for texts that spell out the special token."""
    fast, full = _encoders()
    if not text:
        ids = []
    elif SPECIAL in text:
        ids = full.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
    return np.append(np.asarray(ids, "<u4"), np.uint32(END_ID)).astype("<u4")


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first are of full length."""
    first = len(ids) % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, len(ids), capacity)]


def pieces(docs: DataFrame, *, capacity: int = 1024) -> DataFrame:
    small_batches(docs.sparkSession)

    def tokenized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                ids = token_ids(text)
                for k, (at, n) in enumerate(cut(ids, capacity)):
                    rows.append((doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(tokenized, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items (by index) of each bin: falling sizes, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted; full bins are left out
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free > sizes[i]:
            bisect.insort(room, (free - sizes[i], b))
    return bins


def pack(parts: DataFrame, *, capacity: int = 1024, items: int = ITEMS, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """Add sequence_id and offset to rows as ``pieces`` makes them."""
    parts = settle(parts)
    done = [parts.where(F.col("length") >= capacity).select(F.col("length").cast("int").alias("fill"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("pieces"))]
    rest = parts.where(F.col("length") < capacity).select(F.col("length").cast("int").alias("fill"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("pieces"))
    n, width = rest.count(), max(1, parts.rdd.getNumPartitions())

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0

        def flush() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            fills, lists = pdf["fill"].tolist(), pdf["pieces"].tolist()
            bins = best_fit(fills, capacity)
            return pd.DataFrame({"fill": [sum(fills[i] for i in b) for b in bins], "pieces": [[p for i in b for p in lists[i]] for b in bins]})

        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                count += len(pdf)
                if count >= 2 * items:  # uneven partitions: still bounded
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    while n:
        fewer = max(1, -(-n // items))
        width = fewer if width <= 4 or fewer * 4 >= width else width // 4
        packed = settle(rest.repartition(width).mapInPandas(merged, BINS))
        full = F.col("fill") >= capacity * (1 - nearly_full)
        done.append(packed.where(full))
        rest = packed.where(~full)
        before, n = n, rest.count()
        if width == fewer and (fewer == 1 or n > 0.98 * before):
            break
    done.append(rest)
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    bins = settle(bins.withColumn("sequence_id", F.monotonically_increasing_id()))
    parts_of = "pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece with the lengths of those before it in its bin."""
        for batch in batches:
            flat, ends = batch["pieces"].flatten(), np.cumsum(batch["pieces"].value_lengths().to_numpy(zero_copy_only=False))
            sizes = np.diff(ends, prepend=0)
            length = flat.field("length").to_numpy()
            before = np.cumsum(length) - length
            first = np.repeat(before[np.minimum(ends - sizes, len(before) - 1)], sizes)
            names = [f.name for f in flat.type]
            rows = pa.StructArray.from_arrays([*(flat.field(n) for n in names), pa.array(before - first)], names=[*names, "offset"])
            yield pa.RecordBatch.from_arrays([batch["sequence_id"], pa.ListArray.from_arrays(pa.array(np.append(0, ends), "int32"), rows)], names=["sequence_id", "pieces"])

    laid = bins.select("sequence_id", "pieces").mapInArrow(summed, f"sequence_id long, {parts_of}")
    return laid.select("sequence_id", F.explode("pieces").alias("p")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
