"""The registered queries on small tables of their own, each against a plain version of what it promises."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import plain_components, plain_removal
from threadloom.llm import iblt, kneserney, packing, pii, queries, rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LINE = "This very line is found in a good many of the documents of this table."
ASCII_SPACE = " \t\n\x0b\x0c\r"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def made_texts():
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "su", "te") for b in ("ban", "dor", "fel", "gim", "hus", "jat", "kov", "lir")]
    prose = lambda n: " ".join(rng.choice(words, n))
    passage = prose(60)
    texts = [prose(int(rng.integers(1, 120))) for _ in range(36)]
    base = prose(150)
    texts += [base, base, base.upper(), base + " end", base.replace(" kaban", " changed", 1)]
    texts += [f"{prose(20)} {passage} {prose(20)}" for _ in range(4)]
    texts += [f"{prose(60)}\n  {LINE}\t\n{prose(30)}" for _ in range(4)] + [f"{LINE.upper()}\n{prose(55)}\n{LINE}"]
    texts += [None, "", " \t ", "é漢字 " * 70, "write to a.b@example.org, call +1 (555) 010-9999 or 10.0.0.1, card 4111 1111 1111 1111, not 999.1.1.1"]
    texts += ["same three words again " * 30, "#$% " * 60 + prose(60), "line\nline\nline\n" + prose(55), prose(9_000)]
    return texts


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, texts, labels); ids are shuffled multiples of 3, so that order of ids isn't order of rows."""
    folder = str(tmp_path_factory.mktemp("tables"))
    texts = made_texts()
    ids = [3 * int(k) + 1 for k in np.random.default_rng(5).permutation(len(texts))]
    sources = ["b", "a", None, "c"]
    docs = dict(zip(ids, texts, strict=True))
    rows = [(i, t, ("en", "de", None)[k % 3], sources[k % 7 % 4], None if t is None else len(t)) for k, (i, t) in enumerate(docs.items())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(k % 4 != 0), int(k % 5 == 0)) for k, i in enumerate(docs) if k % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, {r[0]: r for r in rows}


def by_id(df):
    rows = df.collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1(spark, tables):
    folder, docs, _ = tables
    got, order, piece = by_id(queries.op1_iblt_fingerprints(spark, folder)), sorted(docs, reverse=True), re.compile(iblt.PIECE)
    units = lambda t: set(piece.findall(t))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    prints = {}
    for k, i in enumerate(order):
        own, following = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), sha(edited))
        assert abs(r.near_edited - like(units(own), units(edited))) < 1e-12 and abs(r.near_next - like(units(own), units(following))) < 1e-12
        assert prints.setdefault(own, r.fingerprint) == r.fingerprint
        assert edited != own or r.edited_fingerprint == r.fingerprint
    assert set(got) == set(docs)


def test_op2(spark, tables):
    folder, docs, _ = tables
    for i, r in by_id(queries.op2_pii(spark, folder)).items():
        base = pii.ordered(pii.base_spans(docs[i] or ""))  # held against plain patterns in test_operators
        named = [":".join(map(str, s)) for s in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == sha(",".join(named)) and set(named) <= set(r.spans.split(",")) | {""}


def test_op3(spark, tables):
    folder, docs, _ = tables
    got = by_id(queries.op3_quality_rules(spark, folder))
    assert set(got) == set(docs)
    for i, t in docs.items():
        words, seen, dup = WORD.findall(t or ""), set(), 0
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times = collections.Counter(windows)
        again = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
        for line in (t or "").split("\n"):
            if line.strip(ASCII_SPACE):
                dup += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(again))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_op3_needs_conjunctions(spark):
    """Low: many symbols in long words, or many repeats in short texts; none of these alone."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(4000):
        symbols, long, repeats, short = (bool(x) for x in rng.integers(0, 2, 4))
        n = int(rng.integers(60, 100) if short else rng.integers(200, 400))
        low = (symbols and long) or (repeats and short)
        chars = n * int(rng.integers(8, 10) if long else rng.integers(3, 5))
        rows.append((i, n, chars, int(chars * (0.2 if symbols else 0.01)), 0, int(n * (0.4 if repeats else 0.02)), 0, 0, 10, n // 2, int(not low)))
    names = [*rules.COUNTS]
    measured = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", quality int")
    known, apart = measured.where("doc_id % 4 > 0"), measured.where("doc_id % 4 = 0")
    learned = rules.learn(known.drop("quality"), known.select("doc_id", "quality"))
    assert len(learned) >= 2 and any(len(r.conditions) >= 2 for r in learned)
    got = apart.select("quality", rules.verdict(learned).alias("kept")).collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.97


def test_op4(spark, tables):
    folder, docs, _ = tables
    ids = sorted(docs)
    sets, root = plain_components([docs[i] for i in ids])
    least = {}
    for i, r in zip(ids, root, strict=True):
        least.setdefault(r, i)
    got = by_id(queries.op4_jaccard_join(spark, folder))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), least[r]) for i, s, r in zip(ids, sets, root, strict=True)}
    assert len(set(root)) < len(ids)


def test_op5(spark, tables):
    folder, docs, _ = tables
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(queries.op5_bwt_dedup(spark, folder)).items()}
    want = {i: (n, gone, spans, sha(kept)) for i, (n, gone, spans, kept) in zip(docs, plain_removal(list(docs.values())), strict=True)}
    assert got == want and sum(w[1] > 0 for w in want.values()) >= 8


def test_op7(spark, tables, tmp_path):
    folder, docs, _ = tables
    got = by_id(queries.op7_toxicity(spark, folder))
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    apart = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("toxic", F.when(apart, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    assert {i: r.score for i, r in by_id(queries.op7_toxicity(spark, str(tmp_path))).items()} == {i: r.score for i, r in got.items()}


def packed_well(rows, texts):
    """The rows are the pieces of these texts, (id, text) pairs, in gapless sequences, few enough."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), collections.Counter()
    for i, t in texts:
        own = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first, k, at = len(own) % 1024 or 1024, 0, 0
        while at < len(own):
            n = 1024 if k else first
            want[(i, k, at, n, zlib.crc32(own[at : at + n].tobytes()))] += 1
            at, k = at + n, k + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places, total = collections.defaultdict(list), sum(k[3] * n for k, n in want.items())
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-total // 1024) + 1


def test_op8(spark, tables):
    folder, docs, _ = tables
    packed_well(queries.op8_packing(spark, folder).collect(), docs.items())


def test_op8_many_pieces_in_a_sequence(spark):
    df = spark.createDataFrame([(k, 0, 0, 1, 0) for k in range(2500)], packing.PIECES).repartition(3)
    out = packing.pack(df).collect()
    places = collections.Counter((r.sequence_id, r.offset) for r in out)
    assert len(out) == 2500 and max(places.values()) == 1 and len({r.sequence_id for r in out}) == 3
    assert all(0 <= r.offset < 1024 for r in out)


def goals(sizes):
    """Target of each source by filling up, from sizes by source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, full = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        level = rest / max(1e-9, sum(weight[s] for s in order if s not in full))
        more = full | {s for s in order if weight[s] * level >= 2 * sizes[s]}
        if more == full:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full = more


def test_op9(spark, tables):
    folder, docs, rows = tables
    sizes, taken = collections.Counter(), collections.Counter()
    for i, t in docs.items():
        sizes[rows[i][3]] += len(WORD.findall(t or ""))
    target, got = goals(sizes), by_id(queries.op9_mixing(spark, folder))
    assert set(got) == set(docs)
    for i, r in got.items():
        source = rows[i][3]
        assert (r.size, r.source_size) == (len(WORD.findall(docs[i] or "")), sizes[source]) and abs(r.target - target[source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert {i: r.taken for i, r in by_id(queries.op9_mixing(spark, folder)).items()} == {i: r.taken for i, r in got.items()}


def test_op10(spark, tables):
    folder, docs, _ = tables
    got = by_id(queries.op10_kneser_ney(spark, folder))
    assert set(got) == set(docs)
    for i, r in got.items():
        words = WORD.findall(docs[i] or "")
        assert (r.perplexity is None) == (not words)
        assert r.kept == bool(words and r.perplexity <= r.most)
    assert kneserney.ORDER == 2


def plain_lines(docs):
    """Texts by id after common lines have gone."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(ASCII_SPACE).translate(low)
    holders = collections.defaultdict(set)
    for i, t in docs.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    common = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if common.get(key(x), i) == i]
        out[i] = t if len(stay) == len(lines) else "\n".join(stay)
    return out


def plain_representatives(docs, n=5):
    """Ids that stay: the least of each component of near copies, and what has no words."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs.items():
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i for i in sets if top(i) == i}


def test_pipeline_run(spark, tables, monkeypatch):
    """run() against plain stages, one by one: what each stage hands on is what the next one must work on."""
    folder, docs, rows = tables
    handed = []

    def watched(stage):
        def run(spark, docs, sf_dir):
            handed.append(docs.collect())
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(stage)) for name, stage in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, folder).collect()
    at = [{r.doc_id: r.text for r in x} for x in handed]
    assert at[0] == docs
    scored = by_id(toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))))
    assert at[1] == {i: t for i, t in docs.items() if scored[i].predicted == 0} and 0 < len(at[1])
    assert at[2] == plain_lines(at[1])
    stay = plain_representatives(at[2])
    assert at[3] == {i: t for i, t in at[2].items() if i in stay} and len(at[3]) < len(at[2])
    sizes, taken, copies = collections.Counter(), collections.Counter(), collections.Counter(r.doc_id for r in handed[4])
    longest = collections.Counter()
    for i, t in at[3].items():
        n = len(WORD.findall(t or ""))
        sizes[rows[i][3]] += n
        taken[rows[i][3]] += n * copies[i]
        longest[rows[i][3]] = max(longest[rows[i][3]], n)
    target = goals(sizes)
    assert max(copies.values()) <= 2 and all(at[3][i] == t for i, t in at[4].items())
    assert all(abs(taken[s] - target[s]) <= longest[s] + 1 for s in sizes)
    packed_well(packed, [(r.doc_id, r.text) for r in handed[4]])


def test_pipeline_of_nothing(spark, tables, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
