"""Language ID, source divergence and prefix tries against plain versions, and labels of one class."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import corpus_pipeline
from threadloom.llm import divergence, langid, prefixtrie, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- language ID


def all_segmentations(pieces, log_p, unit):
    raw, index = unit.encode(), {p: k for k, p in enumerate(pieces.pieces)}

    def rest(i):
        if i == len(raw):
            return np.ones(log_p.shape[1])
        return sum((np.exp(log_p[index[raw[i:j]]]) * rest(j) for j in range(i + 1, len(raw) + 1) if raw[i:j] in index), np.zeros(log_p.shape[1]))

    return np.log(rest(0))


def test_forward_sums_all_segmentations():
    pieces = langid.vocabulary()
    log_p = langid.normalized(np.random.default_rng(0).random((len(pieces), 3)) * 5)
    found = [" the", " añb", "漢字", " fooling", "x", " 😀"]
    want = np.array([all_segmentations(pieces, log_p, u) for u in found])
    assert np.abs(langid.forward(pieces, log_p, found) - want).max() < 1e-9
    long_units = [" " + "𝔘" * 15, " " + "a" * 16]  # each letter four bytes
    assert np.isfinite(langid.forward(pieces, log_p, long_units)).all()


def test_expected_counts():
    """A piece's expected count is the derivative of the log probability by the piece's own."""
    pieces = langid.Pieces([b" ", b"a", b"b", b"ab", b" a", b"bab"])
    log_p = langid.normalized(np.random.default_rng(1).random((len(pieces), 2)))
    got = langid.expected(pieces, log_p, [" abab", " ba"], np.array([0, 1]), np.array([3, 2]))
    for lang, unit, n in ((0, " abab", 3), (1, " ba", 2)):
        for k in range(len(pieces)):
            moved = log_p.copy()
            moved[k, lang] += 1e-6
            slope = (langid.forward(pieces, moved, [unit]) - langid.forward(pieces, log_p, [unit]))[0, lang] / 1e-6
            assert abs(got[k, lang] - n * slope) < 1e-4


def test_units():
    assert langid.units("Don't, É1 x" + "y" * 20) == [" don", " t", " é", " x" + "y" * 15, "y" * 5]
    assert langid.units(None) == langid.units("12 + 3 ́ ½ Ⅷ") == []


def test_op11(spark, tmp_path):
    rng = random.Random(3)
    words = {"xx": ["".join(rng.choices("aeioklmn", k=rng.randint(2, 9))) for _ in range(80)], "yy": ["".join(rng.choices("uyäßrstw", k=rng.randint(2, 9))) for _ in range(80)]}
    rows = [(k, " ".join(rng.choices(words[("xx", "yy")[k % 2]], k=rng.randint(3, 60))), ("xx", "yy")[k % 2], None, 0) for k in range(240)]
    odd = [None, "", "12 34 ...", "漢字" * 3000, rows[0][1], rows[0][1] * 400]
    rows += [(1000 + k, t, None, "s", 0) for k, t in enumerate(odd)] + [(None, rows[1][1], "yy", None, 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text, lang, _, _ in rows[:240]:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert by[i].lang_pred == lang and 0.5 <= by[i].score <= 1, text
    assert [by[1000 + k].lang_pred for k in range(3)] == ["und"] * 3 and by[1003].lang_pred in ("xx", "yy")
    assert by[1004].lang_pred == by[1005].lang_pred == "xx" and by[None].lang_pred == "yy" and not by[None].held_out
    docs = spark.createDataFrame(rows[:9], DOCS).selectExpr("*", "'mine' lang_pred", "1 _langid_predicted")
    none = langid.identify(docs, langid.train(docs.where("lang is null")))
    assert {(r.lang_pred, r.score, r._langid_predicted) for r in none.collect()} == {("und", 0.0, 1)}
    one = langid.identify(docs, langid.train(docs.where("lang = 'xx'")))
    assert {(r.lang_pred, r.score) for r in one.collect()} == {("xx", 1.0)}
    assert langid.identify(docs.where("false"), langid.train(docs)).count() == 0


# ---- source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least=10, top=10):
    used, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = TERM.findall((text or "").translate(LOWERED))
        used[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def share(n, total):
            return 1 + 10**9 * (n + 2) // (total + 2 * len(kept))

        size = {s: sum(used[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(used[lang, s][t], size[s]) for t in kept} for s in sources}
        q = {t: share(sum(used[lang, s][t] for s in sources), sum(size.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            parts = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s], "term": [(t, f(p[s][t], q[t])) for t in kept if used[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top]
    return out


def test_op12(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["the", "And", "ÉTÉ", "été", "漢字", "a b", "😀x", *["".join(rng.choices("abcXYé", k=rng.randint(1, 5))) for _ in range(60)]]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "é", "", None]), rng.choice(" \n,-\x00[`{\x7f").join(rng.choices(vocabulary, k=rng.randint(0, 80)))) for _ in range(400)]
    rows += [("alone", "one", "x y"), ("few", "a", "x"), ("few", "b", None), ("few", None, ""), ("en", "quiet", None), ("long", "z", "Word, " * 30_000), ("long", "z", "w" * 50_000)] + [("long", "z", "word word")] * 12
    spark.createDataFrame([(k % 50, t, lang, s, 0) for k, (lang, s, t) in enumerate(rows)], DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_source_divergence(spark, str(tmp_path)).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(plain_audit(rows))
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_terms_of_blocks(monkeypatch):
    """Small blocks, empty texts and colliding hashes change nothing."""
    texts = ["", "ab, Ab;ba", "é", "", "abé-ab", "x"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = Counter((k, t.encode()) for k, text in enumerate(texts) for t in TERM.findall(text.translate(LOWERED)))
    for digest in (divergence.xxhash.xxh3_64_intdigest, lambda b: 7, len):
        starts, ends, text = divergence.slices(data, offsets)
        group, chosen = divergence.grouped(divergence.LOWER[data], starts, ends, digest)
        low = divergence.LOWER[data].tobytes()
        names = [low[starts[k] : ends[k]] for k in chosen]
        assert len(set(names)) == len(names) and Counter((int(t), names[g]) for t, g in zip(text, group, strict=True)) == want
    monkeypatch.setattr(divergence, "BLOCK", 7)
    long = "aa bb aa cccccccccccccccccccc é aa".encode()
    terms, n, docs = divergence.long_text(np.frombuffer(long, np.uint8))
    assert dict(zip(terms, n.tolist(), strict=True)) == Counter(long.split()) and set(docs.tolist()) == {1}


def test_shares_of_large_totals():
    n, total = np.array([0, 1, 8 * 10**15, 12345]), np.array([7, 8 * 10**15, 8 * 10**15, 10**15 + 3])
    assert divergence.share(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total, strict=True)]


def test_pairs_in_steps(monkeypatch):
    rng = np.random.default_rng(2)
    dense = rng.poisson(0.6, (40, 6))
    col, row = np.nonzero(dense.T)
    totals = dense.sum(0) + 80
    whole = divergence.pair_sums(row, col, dense[row, col], 40, totals)
    p = divergence.share(dense + 2, totals)
    assert (whole == [[divergence.divergence(p[:, a], p[:, b]).sum() for b in range(6)] for a in range(6)]).all()
    monkeypatch.setattr(divergence, "CELLS", 13)
    assert (divergence.pair_sums(row, col, dense[row, col], 40, totals) == whole).all()


# ---- prefix trie


def digest(turn):
    return hashlib.md5(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).digest()


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t[2] for t in sorted(turns, key=lambda t: (t[0], t[1], digest(t[2])))] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = (*own.get(c - int(math.fmod(c, 100)), [])[:h], *turns[h:])
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children, saved, leaves = Counter(path[:-1] for path in nodes if path), Counter(), Counter()
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1]) if path else 0
            leaves[path[:d]] += not children[path]
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "texts", "parts"), [(1, ["x", "yy", "zé漢", None], 7), (2, ["same"], 3), (3, ["a", "b"], 23)])
def test_op13(spark, tmp_path, seed, texts, parts):
    rng = random.Random(seed)
    rows = [(None, 1, "u", "x"), (777, None, None, None), (777, None, "a", "first"), (778, 5, "u", "tie"), (778, 5, "u", "other tie")]
    for c in range(-5, 330):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8] if c % 100 else [0, 3, 7])):
            rows.append((c, None if turn == 0 and rng.random() < 0.1 else turn, rng.choice(["u", "a", None]), rng.choice(texts)))
    rows += [(c, t, "u", "copy") for c in range(1000, 1300) for t in range(4)] + [(2000, t, "u", "deep") for t in range(900)]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, CONVERSATIONS).repartition(5).selectExpr("*", "1 AS keys", "2 AS part").write.parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(r) for r in queries.op13_prefix_trie(spark, str(tmp_path)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_trie(rows)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert prefixtrie.trie(prefixtrie.sequences(prefixtrie.rebuilt(prefixtrie.turn_lists(empty)))).count() == 0


# ---- labels of one class


@pytest.mark.parametrize("toxic", [0, 1, None])
def test_labels_of_one_class(spark, tmp_path, toxic):
    rows = [(k, f"word{k % 7} and line {k}\n" * (k % 4), "en", f"s{k % 3}", 0) for k in range(40)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, 1, toxic) for k in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.train(spark.createDataFrame(rows, DOCS), labels) is None
    assert {(r.score, r.predicted) for r in queries.op7_toxicity(spark, str(tmp_path)).collect()} == {(0.0, 0)}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


# ---- columns of the user's own that are named like helpers


def test_own_columns_stay(spark):
    """Whatever a user's columns are called, they are carried along and change nothing."""
    from pyspark.sql import functions as F

    from threadloom.llm import kneserney, langid, mixing, pii, rules

    names = ["_key", "_bit", "_tie", "_before", "_s", "_b", "_size", "_pass", "_own", "_id", "_hash", "_f", "_m", "_off", "_total", "lang_hint"]
    rows = [(k, f"some words of text {k} and more {k % 3}", "en", f"s{k % 3}", k + 1) for k in range(30)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")
    own = plain.withColumns({n: F.concat(F.lit(n), F.lit(":"), F.col("doc_id")) for n in names})
    made = {
        "mixing": lambda d: mixing.plan(d.drop("text")), "stream": lambda d: mixing.stream(d), "kneserney": lambda d: kneserney.scored(d, kneserney.Model(kneserney.count(plain))).drop("text"),
        "pii": lambda d: pii.find(d, pii.train(plain)).drop("text"), "rules": lambda d: rules.statistics(d).drop("text"), "langid": lambda d: langid.identify(d, langid.train(plain)).drop("text"),
    }
    for what, f in made.items():
        want = f(plain)
        got = f(own)
        assert set(got.columns) == {*want.columns, *names}, what
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), what
        assert got.where(" OR ".join(f"`{n}` <> concat('{n}:', doc_id)" for n in names)).count() == 0, what


def test_nothing_is_left_behind(spark, tmp_path):
    """Fingerprints leave the session's settings as they were, the n-gram model no folders."""
    import os

    rows = [(k, f"line one of {k}\nand words " * (k % 5), "en", "s", 0) for k in range(40)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    assert queries.op1_iblt_fingerprints(spark, str(tmp_path)).count() == 40 and spark.conf.get(name) == before
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    held = {f for f in os.listdir(folder) if f.startswith("stored-")}
    assert queries.op10_kneser_ney(spark, str(tmp_path)).count() == 40
    assert {f for f in os.listdir(folder) if f.startswith("stored-")} == held
