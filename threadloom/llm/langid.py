"""Language identification by unigrams of pieces, summed over all segmentations.

Pieces are the byte strings of a fixed public vocabulary; its fallback bytes make every text a string of
pieces, mostly in many ways. Each language has a probability for every piece. A text's letters come in units: a
run of letters in lower case, after a space, cut after every ``LONGEST_UNIT`` letters. The forward algorithm
sums a unit's probability over all its segmentations, for all languages at once; a text's is the product of
its units', times the language's share of documents. The score is the chosen language's posterior.

The probabilities are learned by expectation maximization from a sample of documents by hash,
about ``PER_LANG`` of each language: their units are counted by Spark, and in each round tasks send the expected counts of
the pieces in their units (forward and backward sums), which Spark adds up. The model has the size of
the vocabulary for each language and is broadcast; the vocabulary's file is read from its package's path.
Every text is scored whole; a task scores each unit once and remembers it.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as are all if no language was
learned; a text's equally likely languages give the first by code point; documents without lang are not
learned from; of one language, all texts with letters are it; repeated rows are scored alike; other columns
are carried along, those named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import settle

VOCABULARY = "piece_bpe_32k.model"
#: Documents of a language that are learned from (an expected number: rows are taken by hash), rounds, and what is added to each expected count.
PER_LANG, ROUNDS, ADDED = 1_000, 3, 0.1
LONGEST_UNIT = 16
#: Units that a task remembers, and numbers that it works on at once.
CACHE, CELLS = 400_000, 1 << 21
UNKNOWN = "und"

_RUN = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_SPACE = "▁"  # how the vocabulary writes a space


def units(text: str | None) -> list[str]:
    out = []
    for run in _RUN.findall((text or "").lower()):
        if len(run) <= LONGEST_UNIT:
            out.append(" " + run)
        else:
            out.append(" " + run[:LONGEST_UNIT])
            out += [run[k : k + LONGEST_UNIT] for k in range(LONGEST_UNIT, len(run), LONGEST_UNIT)]
    return out


class Pieces:
    """The vocabulary's byte strings and their trie, as sorted keys (node, byte) and the nodes they lead to."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = sorted(set(pieces))
        self.longest = max(map(len, self.pieces))
        edges: dict[tuple[int, int], int] = {}
        ends = {}
        for k, piece in enumerate(self.pieces):
            node = 0
            for byte in piece:
                node = edges.setdefault((node, byte), len(edges) + 1)
            ends[node] = k
        keys = np.array([n * 512 + b for n, b in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(edges.values(), np.int64)[order]
        self.piece = np.full(len(edges) + 1, -1)
        self.piece[list(ends)] = list(ends.values())

    def __len__(self) -> int:
        return len(self.pieces)

    def step(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next nodes of those that have one, and which these are."""
        key = node * 512 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        alive = self.keys[at] == key
        return self.to[at[alive]], alive

    def arcs(self, data: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all pieces in the rows of bytes, by start. No row twice in one item."""
        for start in range(data.shape[1]):
            rows = np.flatnonzero(lengths > start)
            node = np.zeros(len(rows), np.int64)
            for end in range(start + 1, min(data.shape[1], start + self.longest) + 1):
                node, alive = self.step(node, data[rows, end - 1])
                rows = rows[alive]
                if not len(rows):
                    break
                piece = self.piece[node]
                hit = piece >= 0
                if hit.any():
                    yield start, end, rows[hit], piece[hit]


@cache
def vocabulary(name: str = VOCABULARY) -> Pieces:
    import public_tokenizers as places
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=places.path(name))
    pieces = []
    for k in range(m.get_piece_size()):
        if m.is_byte(k):
            pieces.append(bytes([int(m.id_to_piece(k)[3:5], 16)]))
        elif not (m.is_control(k) or m.is_unknown(k)):
            pieces.append(m.id_to_piece(k).replace(_SPACE, " ").encode())
    return Pieces(pieces)


def blocks(found: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which units, their bytes filled up with 256, their lengths), units of like length together."""
    raw = [u.encode() for u in found]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        to = at + max(1, CELLS // ((int(size[order[min(at + 20_000, len(order)) - 1]]) + 1) * width))
        which = order[at : min(to, at + 20_000)]
        data = np.full((len(which), int(size[which].max())), 256, np.int64)
        for row, k in enumerate(which.tolist()):
            data[row, : size[k]] = np.frombuffer(raw[k], np.uint8)
        yield which, data, size[which]
        at += len(which)


def forward(pieces: Pieces, log_p: np.ndarray, found: list[str]) -> np.ndarray:
    """Log probability of each unit (row) in each language (column), over all segmentations."""
    out = np.zeros((len(found), log_p.shape[1]))
    for which, data, lengths in blocks(found, log_p.shape[1]):
        alpha = np.full((data.shape[1] + 1, len(which), log_p.shape[1]), -np.inf)
        alpha[0] = 0
        for start, end, rows, piece in pieces.arcs(data, lengths):
            alpha[end][rows] = np.logaddexp(alpha[end][rows], alpha[start][rows] + log_p[piece])
        out[which] = alpha[lengths, np.arange(len(which))]
    return out


def expected(pieces: Pieces, log_p: np.ndarray, found: list[str], lang: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces (rows) in n[k] occurrences of unit k in language lang[k] (columns)."""
    size = len(pieces)
    out = np.zeros(size * log_p.shape[1])
    for which, data, lengths in blocks(found, 4):
        own, each = lang[which], np.arange(len(which))
        arcs = list(pieces.arcs(data, lengths))
        alpha = np.full((data.shape[1] + 1, len(which)), -np.inf)
        beta = alpha.copy()
        alpha[0], beta[lengths, each] = 0, 0
        for start, end, rows, piece in arcs:
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + log_p[piece, own[rows]])
        for start, end, rows, piece in reversed(arcs):
            beta[start, rows] = np.logaddexp(beta[start, rows], beta[end, rows] + log_p[piece, own[rows]])
        whole = alpha[lengths, each]
        for start, end, rows, piece in arcs:
            use = np.exp(alpha[start, rows] + log_p[piece, own[rows]] + beta[end, rows] - whole[rows]) * n[which[rows]]
            np.add.at(out, own[rows] * size + piece, use)
    return out.reshape(-1, size).T


def normalized(counts: np.ndarray) -> np.ndarray:
    counts = counts + ADDED
    return np.log(counts / counts.sum(0))


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # pieces by languages
    prior: np.ndarray
    vocabulary: str = VOCABULARY


def _units_by_lang(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found: dict[str, Counter] = {}
        for lang, text in batch[["lang", "text"]].itertuples(index=False):
            found.setdefault(lang, Counter()).update(units(text))
        rows = [(lang, unit, n) for lang, counter in found.items() for unit, n in counter.items()]
        if rows:
            yield pd.DataFrame(rows, columns=["lang", "unit", "n"])


def train(docs: DataFrame, *, per_lang: int = PER_LANG, rounds: int = ROUNDS, name: str = VOCABULARY) -> Model | None:
    """Learn from text and lang of ``docs``; None without any lang. Reads lang, text and doc_id, the last to draw the sample."""
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull())
    size = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not size:
        return None
    langs = sorted(size)
    drawn = F.lit(False)
    for limit in sorted({min(1.0, per_lang / n) for n in size.values()}):
        own = [lang for lang in langs if min(1.0, per_lang / size[lang]) == limit]
        drawn = drawn | (F.col("lang").isin(own) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(limit * (1 << 30))))
    counted = settle(known.where(drawn).select("lang", "text").mapInPandas(_units_by_lang, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n")))
    pieces, place = vocabulary(name), {lang: k for k, lang in enumerate(langs)}
    log_p = normalized(np.zeros((len(pieces), len(langs))))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(log_p)

        def summed(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total = 0
            for b in batches:
                total = total + expected(vocabulary(name), shared.value, b["unit"].tolist(), b["lang"].map(place).to_numpy(), b["n"].to_numpy())
            if not np.isscalar(total):
                piece, lang = np.nonzero(total)
                yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        got = counted.mapInPandas(summed, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((len(pieces), len(langs)))
        counts[got["piece"].to_numpy(int), got["lang"].to_numpy(int)] = got["n"].round(6)  # sums of any order
        log_p = normalized(counts)
        shared.unpersist()
    total = sum(size.values())
    return Model(langs, log_p, np.log([size[lang] / total for lang in langs]), name)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.pieces = model, vocabulary(model.vocabulary)
        self.place: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.langs)))

    def __call__(self, texts: pd.Series) -> tuple[list[str], list[float]]:
        if len(self.place) > CACHE:
            self.place, self.logs = {}, self.logs[:0]
        new: list[str] = []
        rows = []
        for text in texts:
            found = Counter(units(text))
            at = np.empty(len(found), np.int64)
            for k, unit in enumerate(found):
                p = self.place.get(unit)
                if p is None:
                    self.place[unit] = p = len(self.place)
                    new.append(unit)
                at[k] = p
            rows.append((at, np.fromiter(found.values(), np.float64, len(found))))
        if new:
            self.logs = np.concatenate([self.logs, forward(self.pieces, self.model.log_p, new)])
        langs, scores = [], []
        for at, n in rows:
            if not len(at):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            z = self.model.prior + n @ self.logs[at]
            best = int(z.argmax())
            langs.append(self.model.langs[best])
            scores.append(round(float(1 / np.exp(z - z[best]).sum()), 6))
        return langs, scores


def _slices(texts: pd.Series, rows: int = 500) -> Iterator[pd.Series]:
    for lo in range(0, len(texts), rows):
        yield texts.iloc[lo : lo + rows]


def predicted(text: str | Column, model: Model | None, spark) -> Column:
    """A struct of lang_pred and score."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            langs, scores = [], []
            for part in _slices(batch):
                a, b = scorer(part)
                langs += a
                scores += b
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return scored(text)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added."""
    own = "_langid_predicted_"
    out = docs.drop("lang_pred", "score").withColumn(own, predicted("text", model, docs.sparkSession))
    return out.select("*", f"{own}.*").drop(own)
