"""Toxicity: a factorization machine over hashed terms.

A document's terms are its lower-cased words and their first four letters, hashed to ``2**BITS``
slots, each present or absent and counting by how much it goes with the label in the sample. The machine
scores ``b + sum w_i x_i + sum <v_i, v_j> x_i x_j`` over the present terms, so that pairs of terms can weigh more (or less) than both alone. It is fitted in one
task on a bounded sample of labelled rows: those with the smallest id hashes, ``MAX_ROWS`` at most and as
many as hold ``MAX_TERMS`` terms together. Their texts are hashed where they lie, only terms are sent on.
The model has a fixed size and is broadcast to score every row.

Defined cases: null and empty texts score as the bias alone; a document with several labels counts as
toxic if any says so; of rows with equal ids the one with the least hash of its text is learned from; labels without a document or without a value are left out; without labels of
both classes every score is 0; other columns are carried along, those named score or predicted are
replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import settle, small_batches

BITS, FACTORS, PREFIX = 18, 8, 4
#: Labelled rows used for fitting at most, and distinct terms of all these rows (4 bytes each).
MAX_ROWS, MAX_TERMS = 20_000, 40_000_000
#: Documents of the sample that must hold a term before it gets weights.
MIN_DOCS = 8

_STRIP = ".,;:!?\"'()[]{}<>|#*$%&-_"


class Terms:
    """Slots of a text's terms. Remembers words; forgets all when there are too many."""

    def __init__(self, most: int = 400_000):
        self.known: dict[str, tuple[int, ...]] = {}
        self.most = most

    def of_word(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            w, mask = word.strip(_STRIP), (1 << BITS) - 1
            got = (zlib.crc32(w.encode()) & mask, zlib.crc32(b"^" + w[:PREFIX].encode()) & mask) if w else ()
            if len(word) <= 60:
                self.known[word] = got
        return got

    def __call__(self, text: str | None) -> np.ndarray:
        slots: set[int] = set()
        for word in set((text or "").lower().split()):
            slots.update(self.of_word(word))
        return np.fromiter(slots, np.int64, len(slots))


def strength(rows: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    """How much a term's presence counts, by its chi-square with the label: half for terms that stand
    in both classes alike, up to 3. Rare terms of one class can't outweigh what tells the classes apart."""
    at = np.concatenate(rows)
    label = np.repeat(y, [len(r) for r in rows])
    both, toxic = np.bincount(at, minlength=n), np.bincount(at, label, n)
    expected = both * y.mean()
    spread = np.maximum(expected * (1 - y.mean()) * (1 - both / len(y)), 1e-9)
    return np.clip(np.abs(toxic - expected) / np.sqrt(spread) / 8, 0.5, 3)


def fit(rows: list[np.ndarray], labels: np.ndarray, *, rows_seen: int = 160_000, batch: int = 128, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> dict[str, np.ndarray] | None:
    """AdaGrad on the log loss of the rows' terms, both classes weighing the same. None without both classes.

    A tenth of the rows is kept apart to place the threshold: the bias is moved so that a score of 0.5
    lies midway between the highest clean and the lowest toxic rows there, if these don't overlap.
    """
    y = labels.astype(np.float64)
    if not 0 < y.sum() < len(y):
        return None
    docs = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    live = np.flatnonzero(docs >= min(MIN_DOCS, max(1, len(rows) // 50)))
    place = np.full(1 << BITS, -1)
    place[live] = np.arange(len(live))
    rows = [r[r >= 0] for r in (place[r] for r in rows)]
    rng = np.random.default_rng(seed)
    apart = (rng.random(len(y)) < 0.1) & (len(y) >= 1000)
    own = np.flatnonzero(~apart)
    if not 0 < y[own].sum() < len(own):
        own, apart = np.arange(len(y)), np.zeros(len(y), bool)
    c = strength([rows[i] for i in own], y[own], len(live))
    w, v, b = np.zeros(len(live)), rng.normal(0, 0.01, (FACTORS, len(live))), 0.0
    gw, gv, gb = np.full(len(live), 1e-2), np.full((FACTORS, len(live)), 1e-1), 1e-2
    weight = np.where(y == 1, len(own) / (2 * y[own].sum()), len(own) / (2 * (len(own) - y[own].sum())))

    def sums(picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms and documents of a batch, the factors' sums and the scores."""
        at = np.concatenate([rows[i] for i in picked])
        doc = np.repeat(np.arange(len(picked)), [len(rows[i]) for i in picked])
        s = np.stack([np.bincount(doc, f[at], len(picked)) for f in v * c])
        z = b + np.bincount(doc, (w * c)[at], len(picked)) + 0.5 * ((s**2).sum(0) - np.bincount(doc, ((v * c) ** 2).sum(0)[at], len(picked)))
        return at, doc, s, z

    for _ in range(int(np.clip(rows_seen // len(own), 4, 60))):
        order = rng.permutation(own)
        for lo in range(0, len(order), batch):
            picked = order[lo : lo + batch]
            at, doc, s, z = sums(picked)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[picked]) * weight[picked] / len(picked)
            de = np.bincount(at, e[doc], len(live))
            dw = c * de + decay * w
            dv = c * np.stack([np.bincount(at, (e * f)[doc], len(live)) for f in s]) - v * c**2 * de + decay * v
            gw += dw**2
            gv += dv**2
            gb += e.sum() ** 2
            w -= rate * dw / np.sqrt(gw)
            v -= 0.3 * rate * dv / np.sqrt(gv)
            b -= rate * e.sum() / np.sqrt(gb)
    held = np.flatnonzero(apart)
    if len(held) and 0 < y[held].sum() < len(held):
        z = sums(held)[3]
        clean, toxic = np.quantile(z[y[held] == 0], 0.999), np.quantile(z[y[held] == 1], 0.02)
        if clean < toxic:
            b -= float(np.clip((clean + toxic) / 2, -2, 2))
    weights, factors = np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32)
    weights[live], factors[live] = w * c, (v * c).T
    return {"w": weights, "v": factors, "b": np.array([b], np.float32)}


def score_one(model: dict[str, np.ndarray] | None, slots: np.ndarray) -> float:
    if model is None:
        return 0.0
    v = model["v"][slots]
    z = float(model["b"][0]) + float(model["w"][slots].sum()) + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def slots(text: str) -> Column:
    """Slots of a text's terms, each once."""

    @F.pandas_udf("array<int>")
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms()
        for batch in texts:
            yield pd.Series([terms(t).astype(np.int32) for t in batch], dtype=object)

    return hashed(text)


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS):
    """Fit on the labelled rows whose crc32(id) mod 5 is not 0. Returns the model, of fixed size."""
    small_batches(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    marks = labels.where(F.col("toxic").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    hashed = rows.select("doc_id", F.struct("toxic", slots("text").alias("slots")).alias("row"), F.xxhash64("text").alias("_of"))
    hashed = settle(hashed.groupBy("doc_id").agg(F.min_by("row", "_of").alias("row")).select("doc_id", "row.*"))
    upto = F.sum(F.size("slots")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # numbers of max_rows rows at most
    within = hashed.select("doc_id", upto.alias("_upto")).where(F.col("_upto") <= max_terms).select("doc_id")
    rows = hashed.join(F.broadcast(within), "doc_id", "left_semi").withColumn("_all", F.lit(1))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        model = fit(pdf["slots"].tolist(), pdf["toxic"].to_numpy())
        parts = model or {"none": np.zeros(0, np.float32)}  # a row of its own: a frame without rows has no types
        return pd.DataFrame({"name": list(parts), "data": [m.tobytes() for m in parts.values()]})

    got = {r.name: np.frombuffer(r.data, np.float32) for r in rows.groupBy("_all").applyInPandas(one, "name string, data binary").where("name <> 'none'").collect()}
    return {"w": got["w"], "v": got["v"].reshape(-1, FACTORS), "b": got["b"]} if got else None


def score(docs: DataFrame, model, *, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` added."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, m = Terms(), shared.value
        for batch in texts:
            yield pd.Series([score_one(m, terms(t)) for t in batch], dtype=float)

    out = docs.drop("score", "predicted").withColumn("score", scored("text"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
