"""Stages on their own inputs: what goes and what stays."""

from __future__ import annotations

import corpus_pipeline as p


def test_stages_keep_columns_and_decide(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == list(p.COLUMNS), name
        assert 0 < docs.count() <= 2 * before
    packed = p.STAGES[-1][1](spark, docs, sf)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), (2, text), (3, text + " more"), (4, "other words altogether here"), (4, "other words altogether here"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.drop_near_copies(spark, docs, "").collect()) == [1, 4, 5, 6]


def test_near_copies_by_five_words_and_four_fifths(spark):
    def jaccard(a, b, n):
        x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a.split(), b.split()))
        return len(x & y) / len(x | y)

    def edited(text, every):
        return " ".join(f"edit{i}" if i % every == every // 2 else w for i, w in enumerate(text.split()))

    one, two, three = (" ".join(f"{c}{i}" for i in range(400)) for c in "abc")
    texts = [one, edited(one, 50), two, two + " " + " ".join(f"more{i}" for i in range(60)), three, edited(three, 40)]
    for k in (0, 2):
        assert 0.8 <= jaccard(texts[k], texts[k + 1], 5) < 0.9 and jaccard(texts[k], texts[k + 1], 3) < 0.9
    assert jaccard(texts[4], texts[5], 5) < 0.8
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.drop_near_copies(spark, docs, "").collect()) == [0, 2, 4, 5]
