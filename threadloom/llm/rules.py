"""Quality rules: a decision list learned by sequential covering.

Per document a few statistics are measured over the whole text. On a bounded sample of labelled
documents (``MAX_ROWS``), rules for low quality are grown one after the other - each a conjunction of
thresholds, extended by the condition with the best information gain, then pruned on rows kept
apart - and stop when a rule is not precise enough. The list is readable and is emitted as one ordered
Spark CASE expression.

Defined cases: null and empty texts have no words and fail the base rule; documents without label are
only scored; conflicting labels of a document count as their smallest quality; without labels of both
classes the list is empty and keeps what passes the base rule; other columns are carried along, those
named like the added ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import small_batches

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
MAX_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_lines", "n_distinct")
#: What rules may test: name and SQL over the counts.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "n_words": "cast(n_words as double)",
}


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    m = int(ids.max()) + 1
    if m < 1 << 20:
        windows = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * m + ids[2:]
    _, back, n = np.unique(windows, return_inverse=True, return_counts=True)
    again = n[back] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : k + len(again)] |= again
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space only
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    seen: set[bytes] = set()
    dup = 0
    lines = raw.split(b"\n")
    for line in lines:
        if line.strip():
            dup += line in seen
            seen.add(line)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dup, repeated_words(ids),
        upper, sum(map(raw.count, (b"%d" % d for d in range(10)))), len(lines), len(number),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts above, each a long."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([measure(t) for t in batch], columns=list(COUNTS), dtype="int64")

    return docs.drop(*COUNTS).withColumn("_rules_counts_", measured("text")).select("*", "_rules_counts_.*").drop("_rules_counts_")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    conditions: tuple[tuple[str, str, float], ...]

    def hits(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, at in self.conditions:
            hit &= x[name] >= at if sign == ">=" else x[name] <= at
        return hit

    def column(self) -> Column:
        hit = F.lit(True)
        for name, sign, at in self.conditions:
            value = F.expr(FEATURES[name])
            hit = hit & (value >= F.lit(at) if sign == ">=" else value <= F.lit(at))
        return hit

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {a:.4g}" for n, s, a in self.conditions)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def grow(x: dict[str, np.ndarray], low: np.ndarray, *, cuts: int = 64, longest: int = 4) -> Rule:
    rule, inside = (), np.ones(len(low), bool)
    for _ in range(longest):
        p0, n0 = int((low & inside).sum()), int((~low & inside).sum())
        if not p0 or not n0:
            break
        best = (1e-9, None, None)
        for name, values in x.items():
            own, bad = values[inside], low[inside]
            for at in np.unique(np.quantile(own[bad], np.linspace(0, 1, cuts))):
                for sign in (">=", "<="):
                    hit = own >= at if sign == ">=" else own <= at
                    p = int((hit & bad).sum())
                    gain = _gain(p, int(hit.sum()) - p, p0, n0)
                    if gain > best[0]:
                        best = (gain, (name, sign, float(at)), None)
        if best[1] is None:
            break
        rule = (*rule, best[1])
        inside &= Rule((best[1],)).hits(x)
    return Rule(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], low: np.ndarray) -> Rule:
    """The prefix of the rule with the best (p - n) / (p + n) on rows not used for growing."""

    def worth(k: int) -> float:
        hit = Rule(rule.conditions[:k]).hits(x)
        p, n = int((hit & low).sum()), int((hit & ~low).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return Rule(rule.conditions[: max(range(1, len(rule.conditions) + 1), key=lambda k: (worth(k), -k))]) if rule.conditions else rule


def cover(x: dict[str, np.ndarray], low: np.ndarray, *, precision: float = 0.95, most: int = 12, seed: int = 3) -> list[Rule]:
    """Rules for low quality in the order found."""
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    left = np.ones(len(low), bool)
    while len(rules) < most and (low & left).sum() >= 5 and (~low & left).any():
        at = np.flatnonzero(left)
        part = rng.random(len(at)) < 0.67
        a, b = at[part], at[~part]
        take = lambda rows: {k: v[rows] for k, v in x.items()}
        if not low[a].any() or not len(b):
            break
        rule = prune(grow(take(a), low[a]), take(b), low[b])
        if not rule.conditions:
            break
        hit = rule.hits(x) & left
        p = int((hit & low).sum())
        if p < 3 or p < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn(measured: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, **options) -> list[Rule]:
    """Rules from the labelled rows with the smallest id hashes, ``max_rows`` at most.

    Rows that the base rule fails are none of the list's business and are left out.
    """
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("_quality"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = measured.where(~base_failed()).join(F.broadcast(sample), "doc_id").select("doc_id", "_quality", *(F.expr(sql).alias(f) for f, sql in FEATURES.items())).dropDuplicates(["doc_id"])
    pdf = rows.toPandas().sort_values("doc_id")
    if not len(pdf):
        return []
    return cover({f: pdf[f].to_numpy(float) for f in FEATURES}, pdf["_quality"].to_numpy() == 0, **options)


def verdict(rules: list[Rule]) -> Column:
    """False for rows that a rule (or the base rule) rejects, in the order of the list."""
    case = F.when(base_failed(), F.lit(False))
    for rule in rules:
        case = case.when(rule.column(), F.lit(False))
    return case.otherwise(F.lit(True))
