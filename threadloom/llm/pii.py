"""Personal data: candidate spans, judged by gradient-boosted trees.

Generators of high recall propose overlapping spans. Those that match a base format and pass its check
are personal data by rule. Boosted trees over features of format and context judge the looser
candidates: numbers written like phones, keys and tokens, hidden addresses. Each of these kinds has its
own trees, fitted on what there is evidence for. Positives are base matches rewritten into the loose form
(a phone without its +, an address with its @ and dot spelled out, a key without the name before it) and
candidates behind a clue; negatives are failed checks and look-alikes (dates, decimals, long lists of
numbers, paths, checksums, names). Candidates with evidence for neither are not fitted on. A threshold
for each kind is calibrated on candidates kept apart; accepted spans that overlap no base span are added
to the base ones. A kind with fewer than 20 candidates, or of one outcome only, accepts nothing.

Fitting uses all candidates of all rows; a fifth of them, by a hash of text and place, is kept apart. Equal
ones are counted, binned by exact quantiles and laid in blocks. Each level of a tree is one pass over the
blocks that adds up gradients by node, feature and bin, as whole numbers, so that reruns agree; only these
sums, of fixed size, reach the driver. The trees have a fixed size and are broadcast. Every scan is linear
in the text.

Defined cases: null and empty texts have no spans; rows with equal ids are judged each; empty tables
give empty results; other columns are carried along, those named like the added ones are replaced.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import settle, small_batches

#: Kinds in the order in which spans with equal starts are listed: the base ones, then what is added.
BASE = ("email", "ip", "card", "phone")
LOOSE = ("secret", "number", "address")
KINDS = (*BASE, *LOOSE)
#: Rows of a kind that ``sampled_rows`` shows of a text; nothing is fitted on these.
SAMPLE_ROWS = 64
#: Bins of a feature, and of scores for the threshold. Different rows of a block, which one task holds.
BINS, STEPS, BLOCK = 24, 2_000, 20_000
#: Gradients are added up in such units.
UNIT = 2.0**-20

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_KEY = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_LOOSE = re.compile(r"[(+]?[0-9][\x20().0-9-]{5,}[0-9]")
_HIDDEN = re.compile(r"[A-Za-z0-9._-]{2,64}(?: ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]{2,64}(?: ?[\[(] ?dot ?[\])] ?| dot )[A-Za-z]{2,12}")
_NAMED = re.compile(r"(?i)(?:(?:token|key|secret|passw\w*|auth)\w*[\"']?\s*[=:]\s*[\"']?(?:bearer\s+)?|\bbearer\s+)$")
_CALLED = re.compile(r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell)\b[^0-9\n]{0,12}$")
_MAILED = re.compile(r"(?i)\b(?:e-?mail|mail|contact|write to|reach)\b[^\n]{0,12}$")
_SUM = re.compile(r"(?i)\b(?:sha-?\d*|md5|commit|checksum|digest|integrity|rev|uuid|etag)\b\W{0,4}$")
_NOT_A_PHONE = re.compile(r"(?:19|20)\d\d[-.][01]?\d[-.][0-3]?\d(?:[ -].*)?|[0-3]?\d[-.][01]?\d[-.](?:19|20)\d\d|\d+\.\d+|(?:19|20)\d\d *- *(?:19|20)\d\d")
_PROSE_AT = re.compile(r"\b([A-Za-z]{2,20}) at ([A-Za-z]{2,20}) ([A-Za-z]{2,12})\b")
_ENDING = re.compile(r"(?i)(?:com|org|net|edu|gov|info|biz|[a-z]{2})$")
_CLUE = re.compile(r"(?i)(mail|phone|tel|call|fax|mobile|card|visa|iban|ip|host|token|key|secret|passw|auth|bearer|contact)")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the run of local characters before it, the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def ips(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _DOTTED.finditer(text):
        if text.find(".", m.start(), m.end()) < 0:
            continue
        groups, at = [], m.start()
        for g in m.group().split("."):
            groups.append((at, at + len(g), g))
            at += len(g) + 1
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            yield four[0][0], four[3][1], all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for _, _, g in four)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """All matches of the base formats, with the outcome of their checks."""
    found = [("email", a, b, True) for a, b in emails(text)]
    found += [("ip", a, b, ok) for a, b, ok in ips(text)]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            d = only_digits(m.group())
            if len(d) >= 12:
                found.append(("card", m.start(), m.end(), len(d) <= 19 and luhn(d)))
    for m in _PHONE.finditer(text):
        found.append(("phone", m.start(), m.end(), 9 <= len(only_digits(m.group())) <= 15))
    return found


def base_spans(text: str) -> list[Span]:
    return [(k, a, b) for k, a, b, ok in matches(text) if ok]


def loose(text: str) -> list[Span]:
    """Candidates that no base format decides."""
    found = []
    for m in _KEY.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s):
            found.append(("secret", m.start(), m.end()))
    for m in _LOOSE.finditer(text):
        if 7 <= len(only_digits(m.group())) <= 19:
            found.append(("number", m.start(), m.end()))
    if " at " in text or "at]" in text or "at)" in text:
        found += [("address", m.start(), m.end()) for m in _HIDDEN.finditer(text)]
    return found


FEATURES = ("length", "digits", "letters", "upper", "marks", "distinct", "longest_digits", "groups", "plus", "paren", "dots", "at", "before_letter", "before_digit", "before_space", "before_quote", "after_letter", "after_digit", "clue", "assigned", "switches", "slashes", "ending", "brackets", "local_marks", "listed")


def features(text: str, a: int, b: int) -> list[float]:
    """Format of the span and what stands around it. Holds no checksum and no number range."""
    s = text[a:b]
    digits = sum("0" <= c <= "9" for c in s)
    letters = sum(c.isalpha() for c in s)
    runs = [len(r) for r in re.findall(r"[0-9]+", s)]
    before, after, context = text[a - 1 : a] if a else "", text[b : b + 1], text[max(0, a - 24) : a]
    kinds = ["d" if c.isdigit() else "l" if c.isalpha() else "o" for c in s]
    return [
        b - a, digits, letters, sum(c.isupper() for c in s), len(s) - digits - letters, len(set(s)) / len(s), max(runs, default=0), len(runs), s[0] == "+", "(" in s, s.count("."), "@" in s or " at " in s,
        before.isalpha(), before.isdigit(), before.isspace(), before in ("'", '"'), after.isalpha(), after.isdigit(), bool(_CLUE.search(context)), bool(re.search(r"[=:]\s*[\"']?$", context)),
        sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) / len(s),
        s.count("/"), bool(_ENDING.match(re.split(r"[\s.\])]+", s)[-1])), "[" in s, bool(re.search(r"[0-9._-]", re.split(r"[\s\[(@]", s)[0])), bool(_SUM.search(context)),
    ]


@dataclass
class Boosted:
    """Gradient-boosted trees of depth ``depth``, log loss."""

    depth: int = 3
    trees: list[list[tuple[int, float, float]]] = field(default_factory=list)  # heap of (feature, cut, value)
    start: float = 0.0

    def places(self, tree: list[tuple[int, float, float]], x: np.ndarray, steps: int) -> np.ndarray:
        """The node of a tree that each row has reached after some steps."""
        node = np.zeros(len(x), np.int64)
        feature, cut, _ = (np.array(c) for c in zip(*tree, strict=True))
        for _ in range(steps):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]), node)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for tree in self.trees:
            z += np.array([v for _, _, v in tree])[self.places(tree, x, self.depth)]
        return 1 / (1 + np.exp(-z))


@dataclass
class Block:
    """Different rows: kind (by number), kept apart or not, features by bin, how many they are and with outcome 1."""

    kind: np.ndarray
    apart: np.ndarray
    bins: np.ndarray
    n: np.ndarray
    ones: np.ndarray

    def of(self, kind: int, apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = (self.kind == kind) & (self.apart == apart)
        return self.bins[own], self.n[own], self.ones[own]


#: Adds up what a function gives for each block: arrays of whole numbers, of one shape.
Passes = Callable[[Callable[[Block], np.ndarray]], np.ndarray]


def totals(kinds: int) -> Callable[[Block], np.ndarray]:
    """By kind and kept apart or not: rows, those of outcome 1."""
    return lambda b: np.array([[[part.sum() for part in b.of(k, apart)[1:]] for apart in (False, True)] for k in range(kinds)], np.int64)


def gradients(models: dict[int, Boosted], trees: dict[int, list], level: int, width: int) -> Callable[[Block], np.ndarray]:
    """By kind, node of a level, feature and bin: sums of first and second derivatives, in ``UNIT``s."""

    def sums(block: Block) -> np.ndarray:
        out = np.zeros((len(models), 2**level, width, BINS, 2), np.int64)
        for at, (k, model) in enumerate(models.items()):
            x, n, ones = block.of(k)
            p = model.predict(x)
            node = model.places(trees[k], x, level) - (2**level - 1)
            here = node >= 0  # the others stand on a leaf above
            for part, values in enumerate((ones - n * p, n * p * (1 - p))):
                units = np.rint(values[here] / UNIT)
                for j in range(width):
                    out[at, :, j, :, part] += np.bincount(node[here] * BINS + x[here, j], units, 2**level * BINS).reshape(-1, BINS).astype(np.int64)
        return out

    return sums


def scores_apart(models: dict[int, Boosted]) -> Callable[[Block], np.ndarray]:
    """By kind and score, in ``STEPS`` bins: rows kept apart, those of outcome 1."""

    def sums(block: Block) -> np.ndarray:
        out = np.zeros((len(models), STEPS + 1, 2), np.int64)
        for at, (k, model) in enumerate(models.items()):
            x, n, ones = block.of(k, True)
            score = np.floor(model.predict(x) * STEPS).astype(np.int64)
            for part, values in enumerate((n, ones)):
                out[at, :, part] += np.bincount(score, values, STEPS + 1).astype(np.int64)
        return out

    return sums


def judges(passes: Passes, cuts: list[list[np.ndarray]], *, precision: float = 0.98, rounds: int = 40, rate: float = 0.2, least: float = 1.0) -> list[Judge]:
    """One for each kind, from blocks and the cuts of its features: the threshold is the lowest with this precision
    on the rows kept apart, 0.5 at least."""
    width = len(cuts[0])
    models = {}
    for k, (own, apart) in enumerate(passes(totals(len(cuts))).tolist()):
        if own[0] and own[0] + apart[0] >= 20 and 0 < own[1] + apart[1] < own[0] + apart[0]:
            mean = float(np.clip(own[1] / own[0], 1e-3, 1 - 1e-3))
            models[k] = Boosted(start=float(np.log(mean / (1 - mean))))
    if not models:
        return [Judge() for _ in cuts]
    depth = Boosted.depth
    for _ in range(rounds):
        trees = {k: [(-1, 0.0, 0.0)] * (2 ** (depth + 1) - 1) for k in models}
        reached: dict[int, dict[int, tuple[float, float]]] = {k: {} for k in models}  # node: its sums
        for level in range(depth):
            got = passes(gradients(models, trees, level, width)) * UNIT
            for at, (k, tree) in enumerate(trees.items()):
                if level == 0:
                    reached[k][0] = tuple(got[at, 0, 0].sum(0))
                for i in range(2**level):
                    node = 2**level - 1 + i
                    if node not in reached[k]:
                        continue
                    gs, hs = reached[k][node]
                    best = (1e-6, -1, 0, 0.0, 0.0)
                    for j, c in enumerate(cuts[k]):
                        gl, hl = np.cumsum(got[at, i, j], 0)[: len(c)].T
                        gain = gl**2 / (hl + least) + (gs - gl) ** 2 / (hs - hl + least) - gs**2 / (hs + least)
                        if len(gain) and gain.max() > best[0]:
                            b = int(gain.argmax())
                            best = (float(gain[b]), j, b, float(gl[b]), float(hl[b]))
                    tree[node] = (best[1], float(best[2]), 0.0) if best[1] >= 0 else (-1, 0.0, float(rate * gs / (hs + least)))
                    if best[1] >= 0:
                        reached[k][2 * node + 1], reached[k][2 * node + 2] = best[3:], (gs - best[3], hs - best[4])
        for k, tree in trees.items():
            for node in range(2**depth - 1, len(tree)):
                if node in reached[k]:
                    tree[node] = (-1, 0.0, float(rate * reached[k][node][0] / (reached[k][node][1] + least)))
            models[k].trees.append(tree)
    out = [Judge() for _ in cuts]
    for (k, model), counts in zip(models.items(), passes(scores_apart(models)), strict=True):
        n, ones = np.cumsum(counts[::-1], 0)[::-1].T
        good = np.flatnonzero((counts[:, 0] > 0) & (ones >= precision * n))
        if len(good):
            trees = [[(f, float(cuts[k][f][int(cut)]) if f >= 0 else 0.0, value) for f, cut, value in tree] for tree in model.trees]
            out[k] = Judge(Boosted(trees=trees, start=model.start), max(0.5, int(good[0]) / STEPS))
    return out


class Taken:
    """Disjoint spans; those given at the start may overlap and are merged."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> int | None:
        """Where the span would go, None if it overlaps another."""
        at = bisect.bisect_left(self.starts, b)
        return None if at and self.ends[at - 1] > a else at

    def take(self, a: int, b: int) -> bool:
        if (at := self.free(a, b)) is None:
            return False
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True


@dataclass
class Judge:
    """Trees and threshold of one kind; the judge of texts has one for each kind in ``kinds``."""

    trees: Boosted | None = None
    threshold: float = 2.0  # accepts nothing
    kinds: dict[str, Judge] = field(default_factory=dict)

    def extra(self, text: str, base: list[Span]) -> list[Span]:
        """Accepted candidates beside the base spans, which they must not touch, nor each other."""
        if not self.kinds:
            return []
        candidates = [c for c in loose(text) if c[0] in self.kinds]
        if not candidates:
            return []
        x = np.array([features(text, a, b) for _, a, b in candidates], float)
        kind, score, enough = np.array([k for k, _, _ in candidates]), np.zeros(len(x)), np.zeros(len(x), bool)
        for k, own in self.kinds.items():
            if (kind == k).any():
                score[kind == k] = own.trees.predict(x[kind == k])
                enough[kind == k] = score[kind == k] >= own.threshold
        taken = Taken((a, b) for _, a, b in base)
        out = []
        for i in sorted(np.flatnonzero(enough).tolist(), key=lambda i: (-score[i], candidates[i][1], candidates[i][0])):
            if taken.take(*candidates[i][1:]):
                out.append(candidates[i])
        return out


def outcome(kind: str, text: str, a: int, b: int) -> int | None:
    """What the context and look of a loose candidate say: 1, 0, or None for neither."""
    s, context = text[a:b], text[max(0, a - 40) : a]
    if kind == "secret":
        if _NAMED.search(context):
            return 1
        digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
        words = sum(w.isalpha() for w in re.split(r"[_/=+-]", s) if len(w) > 1)
        return 0 if _SUM.search(context) or s.count("/") > 1 or words > 1 or not letters or digits < 2 else None
    if kind == "number":
        digits, runs = len(only_digits(s)), re.findall(r"[0-9]+", s)
        if _NOT_A_PHONE.fullmatch(s) or digits > 15 or len(runs) > 6 or text[a - 1 : a].isalpha() or text[b : b + 1].isalpha():
            return 0
        if _CALLED.search(context):
            return 1
        return 0 if len(runs) == 1 and not _CLUE.search(context) else None
    if _MAILED.search(context) or "[" in s or "(" in s:
        return 1
    return None if _ENDING.fullmatch(s.split()[-1]) else 0


def training_rows(text: str) -> list[tuple[str, int, list[float], int]]:
    """(kind, place, features, outcome) of a text's candidates for which there is evidence."""
    out: list[tuple[str, int, list[float], int]] = []

    def rewritten(kind: str, a: int, b: int, s: str, y: int, cut: int = 0) -> None:
        """The span written as ``s``, without the last ``cut`` characters before it."""
        left, right = text[max(0, a - cut - 64) : a - cut], text[b : b + 64]
        if (kind, len(left), len(left) + len(s)) in loose(left + s + right):
            out.append((kind, a, features(left + s + right, len(left), len(left) + len(s)), y))

    taken = Taken((a, b) for _, a, b, ok in matches(text) if ok)
    for kind, a, b, ok in matches(text):
        s = text[a:b]
        if kind == "phone" and ok:
            rewritten("number", a, b, s[1:], 1)
        elif kind == "email":
            user, _, domain = s.rpartition("@")
            name, _, end = domain.rpartition(".")
            at, dot = (" at ", " dot ") if xxhash.xxh3_64_intdigest(s.encode()) % 2 else (" [at] ", " [dot] ")
            rewritten("address", a, b, f"{user}{at}{name}{dot}{end}", 1)
        elif not ok and (kind != "card" or len(only_digits(s)) > 15):
            out.append(("number", a, features(text, a, b), 0))
    for kind, a, b in loose(text):
        if taken.free(a, b) is None:
            continue
        y = outcome(kind, text, a, b)
        if y is not None:
            out.append((kind, a, features(text, a, b), y))
        if kind == "secret" and y and (named := _NAMED.search(text[max(0, a - 40) : a])):
            rewritten(kind, a, b, text[a:b], 1, len(named.group()))
    for m in _PROSE_AT.finditer(text):
        if not _ENDING.fullmatch(m[3]):
            rewritten("address", m.start(), m.end(), f"{m[1]} at {m[2]} dot {m[3]}", 0)
    return out


def sampled_rows(doc_id: int, text: str) -> list[tuple[str, int, list[float], int]]:
    """Of each kind the ``SAMPLE_ROWS`` rows with the smallest hashes, wherever they stand: to look at, not to fit on."""
    rows = sorted(training_rows(text), key=lambda r: xxhash.xxh3_64_intdigest(f"{doc_id} {r[0]} {r[1]}".encode()))
    return [r for k in LOOSE for r in [r for r in rows if r[0] == k][:SAMPLE_ROWS]]


def quantile_cuts(values: list[float]) -> np.ndarray:
    return np.unique(np.array(values, float))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1).astype(np.uint8)


SHARES = [k / BINS for k in range(1, BINS)]


def calibrated(x: np.ndarray, y: np.ndarray, *, precision: float = 0.98) -> Judge:
    """One kind, from rows at hand; every fifth is kept apart."""
    apart = np.arange(len(y)) % 5 == 0
    cuts = [quantile_cuts(np.quantile(c, SHARES)) for c in x[~apart].T]
    block = Block(np.zeros(len(y), np.int64), apart, binned(x, cuts), np.ones(len(y), np.int64), y.astype(np.int64))
    return judges(lambda work: work(block), [cuts], precision=precision)[0]


def evidence(docs: DataFrame) -> DataFrame:
    """(kind, apart, x, n, ones): the different candidates of all texts, how many they are and with outcome 1."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, ones = Counter(), Counter()
            for t in pdf["text"]:
                own = xxhash.xxh3_64_intdigest(t.encode())
                for i, (kind, _, x, y) in enumerate(training_rows(t)):
                    row = LOOSE.index(kind), xxhash.xxh3_64_intdigest(f"{own} {i}".encode()) % 5 == 0, tuple(map(float, x))
                    n[row] += 1
                    ones[row] += y
            yield pd.DataFrame([(*row, n[row], ones[row]) for row in n], columns=["kind", "apart", "x", "n", "ones"])

    found = docs.select("text").where("text is not null").mapInPandas(rows, "kind int, apart boolean, x array<double>, n long, ones long")
    return found.groupBy("kind", "apart", "x").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))


def over_blocks(rows: DataFrame) -> Passes:
    """Over rows (kind, apart, bins, n, ones), a block for each of its partitions."""

    def passes(work: Callable[[Block], np.ndarray]) -> np.ndarray:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if sum(b.num_rows for b in held):
                t = pa.Table.from_batches(held)
                bins = np.frombuffer(b"".join(t["bins"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
                got = work(Block(t["kind"].to_numpy(), t["apart"].to_numpy(), bins, t["n"].to_numpy(), t["ones"].to_numpy()))
                yield pa.RecordBatch.from_pydict({"shape": [list(got.shape)], "sums": [got.tobytes()]})

        sums = rows.mapInArrow(summed, "shape array<long>, sums binary").rdd
        return sums.map(lambda r: np.frombuffer(r["sums"], np.int64).reshape(r["shape"])).treeReduce(np.add)

    return passes


def train(docs: DataFrame) -> Judge:
    small_batches(docs.sparkSession)
    found = settle(evidence(docs))
    values = found.where("not apart").select("kind", "n", F.posexplode("x").alias("feature", "value"))
    quantiles = values.groupBy("kind", "feature").agg(F.percentile("value", SHARES, F.col("n")).alias("cuts")).collect()
    if not quantiles:
        return Judge()
    by_place = {(r.kind, r.feature): quantile_cuts(r.cuts) for r in quantiles}
    cuts = [[by_place.get((k, j), np.empty(0)) for j in range(len(FEATURES))] for k in range(len(LOOSE))]

    @F.pandas_udf("binary")
    def bins(kinds: pd.Series, x: pd.Series) -> pd.Series:
        out = pd.Series([b""] * len(x))
        for k in kinds.unique():
            own = (kinds == k).to_numpy()
            out[own] = [r.tobytes() for r in binned(np.array(x[own].tolist(), float), cuts[k])]
        return out

    rows = settle(found.select("kind", "apart", bins("kind", "x").alias("bins"), "n", "ones").groupBy("kind", "apart", "bins").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")))
    blocks = settle(rows.repartition(-(-rows.count() // BLOCK)))
    return Judge(kinds={k: j for k, j in zip(LOOSE, judges(over_blocks(blocks), cuts), strict=True) if j.trees is not None})


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span (the first of overlapping ones) replaced by its kind."""
    out, end = [], 0
    for kind, a, b in ordered(spans):
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
            end = b
    return "".join([*out, text[end:]])


def find(docs: DataFrame, judge: Judge, *, with_text: bool = False) -> DataFrame:
    """Add n_<kind> of the base kinds, n_added (spans beyond these), base_sha256 and spans (and redacted_text, if
    asked)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(judge)
    names = [*(f"n_{k}" for k in BASE), "n_added"]
    columns = [*names, "base_sha256", "spans", *(["redacted_text"] if with_text else [])]

    def one(text: str | None) -> tuple:
        text = text or ""
        base = base_spans(text)
        every = base + shared.value.extra(text, base)
        own = (*(sum(k == b for k, _, _ in base) for b in BASE), len(every) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))
        return (*own, redact(text, every)) if with_text else own

    @F.pandas_udf(", ".join(f"{c} {'long' if c in names else 'string'}" for c in columns))
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([one(t) for t in batch], columns=columns).astype({n: "int64" for n in names})

    return docs.drop(*columns).withColumn("_pii_found_", found("text")).select("*", "_pii_found_.*").drop("_pii_found_")
