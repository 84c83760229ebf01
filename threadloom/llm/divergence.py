"""Source divergence audit: how far each source's use of terms lies from the other sources' and the language's.

Terms are runs of ASCII letters and non-ASCII characters, A-Z in lower case. They are found in the bytes:
a table of 256 entries says which bytes belong to terms, over the buffer in which Arrow keeps a batch's texts
one after another; borders are where that changes or a text begins. Slices are hashed, equal hashes form a
group, and every slice is compared byte by byte with its group's first one; those that differ are told apart
by their bytes. Counts of a block (documents by terms) are summed to rows (lang, source, term) before they
are shuffled, and again by Spark.

A language keeps the terms of at least ``least`` of its documents. Each kept term's counts by source are
one row of a compressed sparse matrix, as Arrow's lists are. With p = 1 + floor(10^9 (n + 2) / (N + 2 V)) the
divergence of two shares is floor((p - q)^2 / (p + q)), all in whole numbers. Only stored counts are computed
against the other sources and summed by ``reduceat``; terms that neither source has all give the same value,
taken as often as there are such terms.

What reaches all tasks is one number for each pair of language and source; the result has a row for each
pair of sources of a language, the square of that. Languages and sources may be hot: counts are spread by term.

Defined cases: null text, lang and source are empty; rows with equal ids are documents of their own; a
source without terms has shares by the added two alone; a language with no kept term has pairs of value 0
and no terms; a language's only source has no pairs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import settle

LEAST, TOP, ADDED = 10, 10, 2
#: Bytes of text that are cut into terms at once, and divergences that are computed at once.
BLOCK, CELLS = 4 << 20, 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_TERM = np.zeros(256, bool)
IN_TERM[ord("a") : ord("z") + 1] = IN_TERM[ord("A") : ord("Z") + 1] = IN_TERM[0x80:] = True


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each term. Text k is ``data[offsets[k]:offsets[k + 1]]``."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_TERM[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def same_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each slice equals the slice of the same length at its other place."""
    borders = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(borders, lengths)
    equal = data[at + np.repeat(starts, lengths)] == data[at + np.repeat(others, lengths)]
    return np.logical_and.reduceat(equal, borders) if len(borders) else np.zeros(0, bool)


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, a slice of each group): equal groups are equal bytes."""
    raw, lengths = data.tobytes(), ends - starts
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    fits = lengths == lengths[first][group]
    fits[fits] = same_bytes(data, starts[fits], lengths[fits], starts[first][group[fits]])
    chosen, apart = first.tolist(), {}
    for k in np.flatnonzero(~fits).tolist():
        term = raw[starts[k] : ends[k]]
        if term not in apart:
            apart[term] = len(chosen)
            chosen.append(k)
        group[k] = apart[term]
    return group, np.array(chosen, np.int64)


def counts(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(owner, term, occurrences, documents) of the texts of a block, of which text k belongs to owner[k]."""
    data = LOWER[data]
    starts, ends, text = slices(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    group, chosen = grouped(data, starts, ends)
    cells, n = np.unique(text * len(chosen) + group, return_counts=True)  # the matrix of documents and terms
    rows = owner[cells // len(chosen)] * len(chosen) + cells % len(chosen)
    order = np.argsort(rows, kind="stable")
    keys, at, docs = np.unique(rows[order], return_index=True, return_counts=True)
    raw = data.tobytes()
    terms = [raw[starts[k] : ends[k]] for k in chosen[keys % len(chosen)].tolist()]
    return keys // len(chosen), terms, np.add.reduceat(n[order], at), docs


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in blocks that end outside terms (a longer term is one block)."""
    at = 0
    while at < len(data):
        to = at + BLOCK
        if to < len(data):
            gap = np.flatnonzero(~IN_TERM[data[at:to]])
            while not len(gap) and to < len(data):
                to += BLOCK
                gap = np.flatnonzero(~IN_TERM[data[at:to]])
            to = at + int(gap[-1]) + 1 if len(gap) else len(data)
        yield data[at:to]
        at = to


def long_text(data: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    found: dict[bytes, int] = {}
    for block in pieces(data):
        _, terms, n, _ = counts(block, np.array([0, len(block)]), np.zeros(1, np.int64))
        for term, k in zip(terms, n.tolist(), strict=True):
            found[term] = found.get(term, 0) + k
    return list(found), np.fromiter(found.values(), np.int64, len(found)), np.ones(len(found), np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(lang, source, terms, n, docs):
        return pa.RecordBatch.from_arrays([lang, source, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        lang, source, text = batch.column("lang"), batch.column("source"), batch.column("text").cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        if not len(text) or text.buffers()[2] is None:
            continue
        data = np.frombuffer(text.buffers()[2], np.uint8)
        pair = pa.StructArray.from_arrays([lang, source], names=["lang", "source"])
        names = pd.MultiIndex.from_arrays([lang.to_pylist(), source.to_pylist()])
        owner, _ = pd.factorize(names)
        example = np.unique(owner, return_index=True)[1]
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
            block = data[offsets[at] : offsets[to]]
            if len(block) > BLOCK:
                terms, n, docs = long_text(block)
                own = np.full(len(terms), owner[at])
            else:
                own, terms, n, docs = counts(block, offsets[at : to + 1] - offsets[at], owner[at:to])
            if len(terms):
                which = pair.take(pa.array(example[own]))
                yield rows(which.field(0), which.field(1), terms, n, docs)
            at = to


def term_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, cells): kept terms and their counts (source, n)."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    summed = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return terms.where(F.col("docs") >= least).drop("docs")


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 n / total), in steps of 1,000 so that 64 bits suffice for totals below 9 * 10^15."""
    whole, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_sums(row: np.ndarray, col: np.ndarray, n: np.ndarray, n_rows: int, totals: np.ndarray) -> np.ndarray:
    """Divergences of each two sources, summed over ``n_rows`` terms. Entry k of the matrix: term row[k],
    source col[k], n[k] occurrences; entries are in order of sources."""
    size = len(totals)
    dense = np.zeros((n_rows, size), np.int64)
    dense[row, col] = n
    out = np.zeros((size, size), np.int64)
    both = np.zeros((size, size), np.int64)
    step = max(1, CELLS // size)
    for lo in range(0, len(row), step):
        r, c, k = row[lo : lo + step], col[lo : lo + step], n[lo : lo + step]
        other = dense[r]
        f = divergence(share(k + ADDED, totals[c])[:, None], share(other + ADDED, totals))
        at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        has = other > 0
        out[c[at]] += np.add.reduceat(f, at)
        out[:, c[at]] += np.add.reduceat(np.where(has, 0, f), at).T
        both[c[at]] += np.add.reduceat(has.astype(np.int64), at)
    own = np.diag(both)
    none = share(np.full(size, ADDED), totals)
    return out + (n_rows - own[:, None] - own + both) * divergence(none[:, None], none)


def _audited(groups: dict[str, tuple[list[str], np.ndarray, int]], top: int):
    names = ["lang", "source", "part", "item", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, indptr = np.array(batch.column("lang").to_pylist(), object), batch.column("cells").offsets.to_numpy()
            cells, terms = batch.column("cells").values, batch.column("term")
            source, n = cells.field("source").to_pylist(), cells.field("n").to_numpy()
            place = np.empty(len(terms), np.int64)
            place[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
            for lang in sorted(set(langs)):
                sources, totals, v = groups[lang]
                index = {s: k for k, s in enumerate(sources)}
                own = np.flatnonzero(langs == lang)
                sizes = indptr[own + 1] - indptr[own]
                at = np.repeat(indptr[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                row, col, k = np.repeat(np.arange(len(own)), sizes), np.array([index[source[j]] for j in at.tolist()], np.int64), n[at]
                order = np.argsort(col, kind="stable")
                row, col, k = row[order], col[order], k[order]
                sums = pair_sums(row, col, k, len(own), totals + ADDED * v)
                a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
                name = pa.array(sources, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), name.take(pa.array(a)), pa.array(["pair"] * len(a), pa.string()), name.take(pa.array(b)), pa.array(sums[a, b])], names=names)
                whole = np.zeros(len(own), np.int64)
                np.add.at(whole, row, k)
                p, q = share(k + ADDED, (totals + ADDED * v)[col]), share(whole + ADDED, np.int64(totals.sum() + ADDED * v))[row]
                value, above = divergence(p, q), np.flatnonzero(p > q)
                best = above[np.lexsort((place[own][row[above]], -value[above], col[above]))]
                rank = np.arange(len(best)) - np.searchsorted(col[best], col[best])
                best = best[rank < top]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(best), pa.string()), name.take(pa.array(col[best])), pa.array(["term"] * len(best), pa.string()), terms.take(pa.array(own[row[best]])), pa.array(value[best])], names=names)

    return run


def audit(docs: DataFrame, *, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every other source's divergence and the ``top`` terms that a source
    uses more than its language."""
    kept = settle(term_counts(docs, least))
    here = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sums = kept.select("lang", F.explode("cells").alias("cell")).groupBy("lang", F.col("cell.source").alias("source")).agg(F.sum("cell.n").alias("n"))
    groups = settle(here.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")))
    n_terms = {r.lang: r["count"] for r in kept.groupBy("lang").count().collect()}
    known: dict[str, tuple[list[str], np.ndarray, int]] = {}
    for lang, rows in groups.orderBy("lang", "source").toPandas().groupby("lang"):
        known[lang] = (rows["source"].tolist(), rows["n"].to_numpy(np.int64), n_terms.get(lang, 0))
    found = kept.mapInArrow(_audited(known, top), "lang string, source string, part string, item string, value long")
    own = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    other = groups.select("lang", F.col("source").alias("item"))
    zeros = groups.select("lang", "source").join(other, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").unionByName(zeros).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(own))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
    return ranked.unionByName(terms)
