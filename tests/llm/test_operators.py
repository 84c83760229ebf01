"""Each operator against a plain version on a small table with nulls, ties, repeats and odd texts."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import bwtdedup, iblt, kneserney, linededup, mixing, packing, pii, rules, setjoin, toxicity
from threadloom.llm.common import n_words

BASE = "The quick brown fox jumps over the lazy dog near the river bank while seven owls watch in silence from a tree. "
LONG = " ".join(f"word{i} and some more of it." for i in range(900))
TEXTS = [
    (1, BASE * 3 + "\nA line that many of the documents here share, long enough to count.\nend one", "en", "b"),
    (2, BASE * 3 + "\nA line that many of the documents here share, long enough to count.\nend two", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (5, "a line that many of the documents here share, long enough to count.  \n\nhello", "de", "a"),
    (6, "two words", "de", "b"),
    (7, LONG + "\nA LINE THAT MANY OF THE DOCUMENTS HERE SHARE, LONG ENOUGH TO COUNT.", "en", "c"),
    (7, LONG + "\nA line that many of the documents here share, long enough to count.", "en", "c"),
    (8, LONG, "en", "c"),
    (8, LONG, "en", "c"),
    (9, "A line that many of the documents here share, long enough to count.", "fr", "d"),
    (10, " \t\n ", "fr", "a"),
    (None, "mail x.y@example.org or +1 (555) 010-9999, 10.0.0.1 or 300.1.1.1, card 4111 1111 1111 1111", "en", "a"),
    (11, "ab" * 400, "en", "b"),
    (12, 'token = "9f8e7d6c5b4a39281706f5e4d3c2b1a0ffee" idiot', "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, None if t[1] is None else len(t[1]), "x") for t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_iblt(docs, none):
    got = collections.Counter(map(tuple, iblt.fingerprints(docs).select("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next", "fingerprint").collect()))
    piece = re.compile(iblt.PIECE)
    units = lambda t: set(piece.findall(t))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    seen = {t[0] for t in TEXTS}
    by_id = collections.defaultdict(list)
    for t in TEXTS:
        by_id[t[0]].append(t[1] or "")
    for (doc_id, n, sha, edited, following, _), k in got.items():
        assert doc_id in seen and k >= 1
        lower = [i for i in seen if i is not None and doc_id is not None and i < doc_id]
        successors = by_id[max(lower)] if lower else by_id[None] if doc_id is not None else by_id[max(i for i in seen if i is not None)]
        candidates = set()
        for own in by_id[doc_id]:
            for nxt in [*successors, *by_id[doc_id]]:
                e = own[: len(own) - len(own) // 2] + nxt[: len(own) // 2]
                candidates.add((len(own), hashlib.sha256(e.encode()).hexdigest(), round(like(units(own), units(e)), 9), round(like(units(own), units(nxt)), 9)))
        assert (n, sha, round(edited, 9), round(following, 9)) in candidates
    assert sum(got.values()) == len(TEXTS)
    prints = collections.defaultdict(set)
    for r in iblt.fingerprints(docs.where("doc_id = 8")).collect():
        prints[r.doc_id].add(r.fingerprint)
        assert r.near_next == 1.0
    assert len(prints[8]) == 1
    assert iblt.fingerprints(none).count() == 0


def test_iblt_holds_few_groupings_at_once(docs, monkeypatch):
    plans, settle = [], iblt.settle

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("HashAggregate("))
        return settle(df)

    monkeypatch.setattr(iblt, "settle", seen)
    iblt.fingerprints(docs)
    assert len(plans) > 3 and max(plans) <= 2 * (1 + iblt.ROUNDS_A_STAGE)  # partial and final ones: each holds a page of memory


def test_iblt_retries_when_a_sketch_is_too_small(docs, monkeypatch):
    want = rows(iblt.fingerprints(docs), "doc_id", "n_chars", "near_edited", "near_next")
    monkeypatch.setattr(iblt, "SCALES", (0, 8, 64))
    assert rows(iblt.fingerprints(docs), "doc_id", "n_chars", "near_edited", "near_next") == want


def test_iblt_counts_what_no_scale_can_peel(docs, monkeypatch):
    want = rows(iblt.fingerprints(docs), "doc_id", "n_chars", "near_edited", "near_next")
    monkeypatch.setattr(iblt, "width_for", lambda n, scale: F.lit(4).cast("long") + n.cast("long") * 0)
    assert rows(iblt.fingerprints(docs), "doc_id", "n_chars", "near_edited", "near_next") == want


def test_pii_base_matches_plain_regexes(docs, none):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    samples = [t[1] or "" for t in TEXTS] + ["1.2.3.4.5.6.7.8.9", "a@b@c.d e@f.g.h.", "@x.y", "+1 2", "+1234567890123456", "0.0.0.0 255.255.255.255.1", "4111-1111-1111-1111 4111111111111112", "a@b.c@d.e", "1" * 5000, "a" * 3000 + "@" + "b." * 500 + "c"]
    for t in samples:
        found = []
        for kind, p in patterns.items():
            for m in re.finditer(p, t):
                d = re.sub(r"[^0-9]", "", m.group())
                ok = kind == "email" or (kind == "ip" and all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m.group().split("."))) or (kind == "card" and 12 <= len(d) <= 19 and pii.luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)
                if ok:
                    found.append((kind, m.start(), m.end()))
        assert pii.ordered(pii.base_spans(t)) == pii.ordered(found), t[:50]
    got = {r.doc_id: r for r in pii.find(docs, pii.Judge(), with_text=True).collect()}
    assert (got[None].n_email, got[None].n_ip, got[None].n_card, got[None].n_phone) == (1, 1, 1, 1)
    assert "[email]" in got[None].redacted_text and got[3].spans == ""
    assert pii.find(none, pii.train(none)).count() == 0


def test_pii_trees_learn_a_format():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(float)
    judge = pii.calibrated(x, y)
    assert judge.trees is not None
    assert ((judge.trees.predict(x) > 0.5) == (y == 1)).mean() > 0.97


def test_pii_finds_planted_loose_kinds(spark):
    rng = np.random.default_rng(3)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    hexa, digits, letters = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for i in range(400):
        phone = f"({pick('23456789', 3)}) {pick(digits, 3)}-{pick(digits, 4)}"
        rows.append((i, f"Some words on day 20{pick('012', 1)}{pick(digits, 1)}-0{pick('123456789', 1)}-1{pick(digits, 1)} about {pick(digits, 5)}.{pick(digits, 4)} units. They {pick(letters, 3 + i % 6)} at {pick(letters, 3 + i % 9)} {pick(letters, 4 + i % 7)} here. Ask +1 {phone} or {pick(letters, 2 + i % 5)}.{pick(letters, 2 + i % 4)}@{pick(letters, 3 + i % 8)}.com now. api_key = {pick(hexa, 32)} was set, see docs/a{pick(digits, 2)}/part/some_long_name_{pick(digits, 2)}/end and order {pick(digits, 9)}."))
    judge = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(judge.kinds) == set(pii.LOOSE)
    planted = [("number", "(212) 555-0147"), ("address", "jane.roe at example dot com"), ("secret", "9f8e7d6c5b4a39281706f5e4d3c2b1a0"), ("secret", "0a1b2c3d4e5f60718293a4b5c6d7e8f9")]
    texts = [f"Some words before {planted[0][1]} and after.", f"Some words before {planted[1][1]} and after.", f"Some words before {planted[2][1]} and after.", f"Authorization: Bearer {planted[3][1]} and after."]
    for (kind, s), text in zip(planted, texts, strict=True):
        assert judge.extra(text, pii.base_spans(text)) == [(kind, text.index(s), text.index(s) + len(s))], text
    for text in ("on day 2019-04-12 it rained", "about 12345.6789 units", "see docs/a12/part/some_long_name_34/end", "they look at polka dot dresses"):
        assert judge.extra(text, pii.base_spans(text)) == [], text


def test_pii_fits_on_all_candidates_however_they_are_laid(spark, monkeypatch):
    texts = [" ".join(f"u{i}.{k}@example.org" if (i + k) % 3 else f"call (212) 555-{i:04d} on 2019-04-{10 + k}" for i in range(100 + k)) for k in range(9)]
    rows = [(k // 2 or None, t) for k, t in enumerate(texts)] + [(7, None), (8, texts[0])]  # ids and texts twice, and null ones
    want = collections.Counter((kind, y) for _, t in rows if t for kind, _, _, y in pii.training_rows(t))
    assert min(want["number", 1], want["number", 0]) > pii.SAMPLE_ROWS * 4
    seen, judges = [], pii.judges

    def held(passes, cuts):
        seen.append(passes(pii.totals(len(cuts))).sum(1).tolist())  # kept apart or not
        return judges(passes, cuts, rounds=3)

    monkeypatch.setattr(pii, "judges", held)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = pii.train(df)
    assert seen == [[[want[k, 0] + want[k, 1], want[k, 1]] for k in pii.LOOSE]]
    monkeypatch.setattr(pii, "BLOCK", 3)
    assert "number" in whole.kinds and pii.train(df.repartition(7)) == whole


def test_pii_training_rows_come_from_the_whole_text():
    text = " ".join(f"u{i}@example.org" for i in range(500)) + " call (212) 555-0147 or password = 9f8e7d6c5b4a39281706f5e4"
    assert {r[0] for r in pii.sampled_rows(1, text)} == set(pii.LOOSE)


def test_rules_statistics(docs, none):
    for _, t, *_ in TEXTS:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        hit = set()
        for i in range(len(words) - 2):
            if windows[tuple(words[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        lines, dup, seen = (t or "").split("\n"), 0, set()
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert rules.measure(t)[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit))
    out = rules.statistics(none)
    assert rules.learn(out, none.selectExpr("doc_id", "1 as quality")) == [] and out.count() == 0


def test_rules_cover_a_conjunction(spark):
    rng = np.random.default_rng(1)
    x = {f: rng.random(3000) for f in rules.FEATURES}
    low = (x["symbol_share"] > 0.7) & (x["word_length"] < 0.5)
    found = rules.cover(x, low)
    hit = np.zeros(3000, bool)
    for r in found:
        hit |= r.hits(x)
    assert ((hit == low).mean()) > 0.97 and str(found[0])


def plain_components(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return sets, [top(i) for i in range(len(sets))]


def test_setjoin(spark, docs, none):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(words, 120)) for _ in range(6)]
    texts = [t[1] for t in TEXTS]
    for k in range(120):
        own = list(base[k % 6])
        for _ in range(int(rng.integers(0, 6))):
            own[int(rng.integers(0, 120))] = str(rng.choice(words))
        texts.append(" ".join(own))
    sets, top = plain_components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.components(df).collect()}
    assert got == {i: (len(s), t) for i, (s, t) in enumerate(zip(sets, top, strict=True))}
    assert setjoin.components(none).count() == 0
    assert setjoin.components(docs).count() == len(TEXTS)


@pytest.mark.parametrize(("block", "edits", "length"), [(7, 4, 100), (7, 9, 100), (11, 14, 120)])
def test_setjoin_in_blocks(spark, monkeypatch, block, edits, length):
    monkeypatch.setattr(setjoin, "BLOCK_SETS", block)
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(90):
        own = [f"w{i}" for i in range(length - int(rng.integers(0, 12)))]
        for _ in range(int(rng.integers(0, edits))):
            own[int(rng.integers(0, len(own)))] = f"x{rng.integers(0, 50)}"
        texts.append(" ".join(own))
    sets, top = plain_components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in setjoin.components(df).collect()} == dict(enumerate(top))


@pytest.mark.parametrize("t", [(90, 100), (80, 100), (60, 100)])
def test_sets_with_enough_overlap_share_a_tuple(t):
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.3], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 3))).astype(np.uint64)]))
        if len(b) and 100 * len(np.intersect1d(a, b)) >= t[0] * len(np.union1d(a, b)) and not np.array_equal(a, b):
            assert len(np.intersect1d(setjoin.tuples(a, *t), setjoin.tuples(b, *t)))


@pytest.mark.parametrize("probes", [False, True])
def test_link_sets_finds_all_links(probes):
    rng = np.random.default_rng(6)
    base = [np.arange(k, k + 80) for k in (0, 40, 1000)]
    sets = [np.unique(np.concatenate([base[k % 3][rng.random(80) > 0.06], rng.integers(5000, 9000, int(rng.integers(0, 6)))])) for k in range(300)]
    probe = rng.random(300) < 0.3 if probes else None
    root = list(range(300))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    def joined(pairs):
        root[:] = range(300)
        for a, b in pairs:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return [top(i) for i in range(300)]

    want = joined((a, b) for a in range(300) for b in range(a) if (probe is None or probe[a] or probe[b]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b])))
    assert joined(setjoin.link_sets(sets, 90, 100, probe=probe)) == want
    assert len(set(want)) < 250


def test_smallest_reachable_over_long_chains_and_stars(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "NODES", 40)
    rng = np.random.default_rng(7)
    chain, star = rng.permutation(600), 1000 + rng.permutation(300)
    pairs = [*zip(chain[:-1], chain[1:], strict=True), *((star[0], x) for x in star[1:]), (5000, 5001), (7, 7)]
    links = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a long, b long").repartition(4)
    got = {r.node: r.label for r in setjoin.smallest_reachable(links).collect()}
    assert got == {**dict.fromkeys(map(int, chain), 0), **dict.fromkeys(map(int, star), 1000), 5000: 5000, 5001: 5000}


def plain_removal(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if n[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [2000, 0])
def test_bwtdedup(spark, none, hot):
    rng = np.random.default_rng(4)
    letter = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared = letter(260)
    texts = [t[1] for t in TEXTS] + [letter(int(rng.integers(0, 300))) + shared[int(rng.integers(0, 30)) : 260 - int(rng.integers(0, 40))] + letter(int(rng.integers(0, 300))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in bwtdedup.dedup_bytes(df, hot_fragments=hot).collect()}
    assert got == dict(enumerate(plain_removal(texts)))
    if hot:
        assert bwtdedup.dedup_bytes(none).count() == 0


def test_linededup(docs, none):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = collections.defaultdict(set)
    at = lambda i: -(1 << 63) if i is None else i
    for i, t, *_ in TEXTS:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(at(i))
    want = []
    for i, t, *_ in TEXTS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 5 and at(i) != max(holders[key(x)]))]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = linededup.dedup_lines(docs)
    assert rows(got, "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(want, key=repr)
    assert any(w[2] for w in want) and "score" in got.columns
    assert linededup.dedup_lines(none).count() == 0


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(5)
    vocabulary = [f"term{i}" for i in range(300)]
    texts = [" ".join([*rng.choice(vocabulary, 40), *(["idiot"] if k % 4 == 0 else [])]) for k in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(800)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    out = toxicity.score(df, model).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) > 0.98 * len(held)
    odd = toxicity.score(docs, model)
    assert odd.count() == len(TEXTS) and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert toxicity.train(df, labels, max_terms=30) is None  # no row fits
    again = toxicity.train(df.unionByName(df.selectExpr("doc_id", "'other text' text")), labels)
    assert again["w"].shape == model["w"].shape
    same = toxicity.train(df.unionByName(df).repartition(7), labels)
    assert all((same[k] == model[k]).all() for k in model)


def test_factorization_finds_a_pair():
    """Two terms are harmless alone and toxic together: no additive weights say that."""
    rng = np.random.default_rng(6)
    texts, y = [], []
    for k in range(3000):
        a, b = rng.random(2) < 0.5
        texts.append(" ".join([*(f"t{i}" for i in rng.integers(0, 50, 5)), *(["insult"] if a else []), *(["group"] if b else [])]))
        y.append(int(a == b))
    terms = toxicity.Terms()
    model = toxicity.fit([terms(t) for t in texts], np.array(y))
    right = np.mean([(toxicity.score_one(model, terms(t)) >= 0.5) == v for t, v in zip(texts, y, strict=True)])
    assert right > 0.95


def test_packing(docs, none):
    out = packing.pack(packing.pieces(docs)).collect()
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    want = collections.Counter()
    for i, t, *_ in TEXTS:
        own = np.array(ids(t), "<u4")
        for k, (at, n) in enumerate(packing.cut(own, 1024)):
            want[(i, k, at, n, zlib.crc32(own[at : at + n].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert len(sequences) <= -(-total // 1024) + 1
    assert packing.pack(packing.pieces(none)).count() == 0
    assert packing.token_ids("a<|endoftext|>b").tolist() == [*tok.encode("a<|endoftext|>b", add_special_tokens=False).ids, 2]


def test_packing_in_rounds(spark):
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 1024, 3000).tolist()
    df = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing.PIECES).repartition(16)
    out = packing.pack(df, items=400)
    assert out.count() == 3000
    assert out.select("sequence_id").distinct().count() <= 1.03 * sum(sizes) / 1024
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_mixing(docs, none):
    sized = docs.withColumn("size", n_words())
    out = mixing.plan(sized).collect()
    sizes = collections.defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    wanted, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        level = (wanted - sum(2 * sizes[s] for s in full)) / max(1e-9, sum(weight[s] for s in order if s not in full))
        more = {s for s in order if weight[s] * level >= 2 * sizes[s]}
        if more == full:
            break
        full = more
    for s in order:
        target[s] = 2.0 * sizes[s] if s in full else weight[s] * level
    taken = collections.defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(target[s] + 1e-9) for s in order)
    assert rows(mixing.plan(sized), "doc_id", "taken") == rows(mixing.plan(sized.repartition(5)), "doc_id", "taken")
    assert mixing.plan(none.withColumn("size", n_words())).count() == 0
    at = [r.position for r in mixing.stream(sized).collect()]
    assert at == sorted(at)


def plain_kneser_ney(trusted, order):
    """Interpolated modified Kneser-Ney from its definition: {gram: probability} and a function for a text."""
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def grams(t):
        own = ["<"] * (order - 1) + word.findall(t)
        return [tuple(own[i : i + order]) for i in range(len(own) - order + 1)]

    level = {order: collections.Counter(g for t in trusted for g in grams(t or ""))}
    for k in range(order - 1, 0, -1):
        level[k] = collections.Counter(g[1:] for g in level[k + 1])
    off, total, gamma = {}, {}, {}
    for k, counts in level.items():
        n = [sum(c == j for c in counts.values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        off[k] = [min(j, max(0.0, j - (j + 1) * y * n[j] / n[j - 1])) if n[j - 1] and n[j] else 0.5 * y for j in (1, 2, 3)]
        total[k], gamma[k] = collections.Counter(), collections.Counter()
        for g, c in counts.items():
            total[k][g[:-1]] += c
            gamma[k][g[:-1]] += off[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(level[1]) + 1)
        if not total[k][g[:-1]]:
            return p(g[1:])
        c = level[k][g]
        return ((c - off[k][min(c, 3) - 1] if c else 0) + gamma[k][g[:-1]] * p(g[1:])) / total[k][g[:-1]]

    return lambda t: np.exp(-np.mean([np.log(p(g)) for g in grams(t)])) if t and grams(t) else None


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney_is_that_of_the_definition(spark, docs, order):
    rng = np.random.default_rng(4)
    words = ["the", "a", "of", "and", "owl", "fox", "river", "tree", "sees", "runs", "by"]
    trusted = [" ".join(rng.choice(words, int(rng.integers(1, 40)), p=np.arange(11, 0, -1) / 66)) for _ in range(60)] + [None, "", "two words"]
    texts = [*trusted, *(t[1] for t in TEXTS), "unknown words only", "the fox sees the river", "river the sees fox the"]
    df = spark.createDataFrame(list(enumerate(trusted)), "doc_id long, text string").repartition(3)
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want, model = plain_kneser_ney(trusted, order), kneserney.Model(kneserney.count(df, order), order)
    got = {r.doc_id: r.perplexity for r in kneserney.scored(own, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = want(t)
        assert (got[i] is None) == (w is None) and (w is None or abs(got[i] / w - 1) < 1e-9), t


def test_kneser_ney_edge_cases(spark, docs, none):
    model = kneserney.Model(kneserney.count(docs))
    scored = kneserney.scored(docs, model)
    out = kneserney.classify(scored, scored).collect()
    assert len(out) == len(TEXTS) and all(r.score == "x" for r in out)
    empty = {t[0] for t in TEXTS if not (t[1] or "").strip()}
    assert all((r.perplexity is None) == (r.doc_id in empty) and (r.kept or r.doc_id not in (1, 8)) for r in out)
    assert not any(r.kept for r in out if r.perplexity is None)
    assert len({r.perplexity for r in out if r.doc_id == 8}) == 1
    nothing = kneserney.Model(kneserney.count(none))
    assert kneserney.classify(kneserney.scored(none, nothing), scored.limit(0)).count() == 0
    assert all(r.kept == (r.perplexity is not None) for r in kneserney.classify(kneserney.scored(docs, nothing), scored.limit(0)).collect())


def test_kneser_ney_keeps_no_table_that_is_used_up(docs):
    model = kneserney.Model(kneserney.count(docs))
    tables = len(model.seen) + len(model.rest)
    assert len(model.folders) == tables  # not the counts
    assert kneserney.scored(docs, model).count() == docs.count()
    assert len(model.folders) == tables + 1  # what the last join reads
    model.discard()
    assert not model.folders


@pytest.mark.parametrize("hot", [0, 20, 1 << 17])
def test_kneser_ney_in_parts_is_that_of_the_definition(spark, monkeypatch, hot):
    monkeypatch.setattr(kneserney, "PARTS", 2)
    monkeypatch.setattr(kneserney, "PART_CHARS", 100)
    monkeypatch.setattr(kneserney, "HOT", hot)
    trusted = ["a b a c", "a b", "b a b", "c c c " * 30, "a fox\x0bsees an \u00e9" + "l" * 200, None, ""]
    texts = [*trusted, "a b fox unknown a", "unknown", "c a b c", "l" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want, model = plain_kneser_ney(trusted, 2), kneserney.Model(kneserney.count(df.where(F.col("doc_id") < len(trusted))))
    assert model.parts == 2  # one part's shuffle at a time
    got = {r.doc_id: r.perplexity for r in kneserney.scored(df, model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (want(t) and pytest.approx(want(t), rel=1e-9)), t


def test_kneser_ney_deals_blocks_and_reads_texts_once_a_part(spark, monkeypatch):
    """No row for each n-gram and document goes through a shuffle, no further reading of the texts beside the parts'."""
    monkeypatch.setattr(kneserney, "PARTS", 2)
    monkeypatch.setattr(kneserney, "PART_CHARS", 100)
    monkeypatch.setattr(kneserney, "HOT", 0)
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(i % 7, 60)) for i in range(1, 200)] + ["b b " * 3000, None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    model, read = kneserney.Model(kneserney.count(df)), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    want = plain_kneser_ney(texts, 2)
    got = {r.doc_id: r.perplexity for r in kneserney.scored(df, model).collect()}
    assert all(got[i] == (want(t) and pytest.approx(want(t), rel=1e-9)) for i, t in enumerate(texts))
    kneserney.perplexities(df.mapInArrow(seen, df.schema), model).count()
    assert read.value == model.parts * len(texts)


@pytest.mark.parametrize("bits", [6, 28])
def test_kneser_ney_marks_lose_no_ngram(spark, monkeypatch, bits):
    monkeypatch.setattr(kneserney, "MARKS", bits)
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(60)) for i in range(50)]
    model = kneserney.Model(kneserney.count(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    model.frequent()
    _, ends, contexts = kneserney.grams(pa.array(texts), 2)
    assert all(kneserney._marked(model.marks(0), x.view(np.uint64)).all() for x in (*ends, *contexts))
    other = np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64)
    assert bits == 6 or kneserney._marked(model.marks(0), other).mean() < 0.3


def test_kneser_ney_packed_columns_come_back():
    columns = [np.arange(5, dtype="u8") << np.uint64(50), np.arange(5, dtype="u2"), np.linspace(-1, 1, 5), np.array([1, 0, 1, 0, 1], "u1")]
    assert all((a == b).all() for a, b in zip(kneserney._unpacked(memoryview(kneserney._packed(*columns)), "u8", "u2", "f8", "u1"), columns, strict=True))
    gram = np.random.default_rng(2).integers(0, 1 << 64, 5000, np.uint64) & ~np.uint64(3)
    for ranges in (1, 7, 70_000):
        dealt = list(kneserney._dealt(gram, ranges, 2))
        assert sorted(np.concatenate([own for _, own, _ in dealt]).tolist()) == list(range(5000))
        assert all(((np.uint64(-(-(r << 32) // ranges) << 32) + (key << np.uint64(2))) == gram[own]).all() for r, own, key in dealt)


def test_kneser_ney_words_are_those_of_the_pattern():
    texts = [None, "", " a b\x0b\x0cc\x1cd \u00e9 \r\n", "x", "abcdefgh abcdefghi " + " ".join("z" * n for n in (63, 64, 65, 300)), "  ", "a", "abcdefgh"]
    for held in (pa.array(["cut", *texts, "off"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        rows, hashes = kneserney._words(held)
        want = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        assert rows.tolist() == [i for i, _ in want]
        assert len({(w, h) for (_, w), h in zip(want, hashes.tolist(), strict=True)}) == len({w for _, w in want}) == len(set(hashes.tolist()))


def test_kneser_ney_quantiles_reject_on_both_sides(spark):
    rows = spark.createDataFrame([(i, "en", float(np.exp(1 + i / 100))) for i in range(200)], "doc_id long, lang string, perplexity double")
    kept = {r.doc_id for r in kneserney.classify(rows, rows, low=0.1, high=0.9, margin=0.0).where("kept").collect()}
    assert min(kept) in (18, 19, 20) and max(kept) in (178, 179, 180, 181)
