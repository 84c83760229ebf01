"""Odd tables through every registered query and every stage of the pipeline: nothing crashes, every document is answered."""

from __future__ import annotations

import corpus_pipeline
import pytest
from threadloom.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keys string, part int, _row int, _r int, score string"
BY_DOCUMENT = [n for n in queries.QUERIES if not n.startswith(("op8", "op12", "op13"))]


def written(spark, folder, texts, ids=None, labels=(), turns=()):
    ids = list(range(1, len(texts) + 1)) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else "s", None, "k", 1, 2, 3, "own") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(turns), "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


TABLES = {
    "no row": {"texts": []},
    "one row, no label": {"texts": ["a few words"], "turns": [(None, None, None, None)]},
    "null and repeated ids": {"texts": ["one two three"] * 3 + ["one two three four", None, "", "a@b.org x " * 9], "ids": [5, 5, None, None, None, 7, 5], "labels": [(5, 1, 0), (5, 0, 1), (None, 1, 1), (9, None, None)], "turns": [(3, 1, "u", "x")] * 4 + [(None, 1, "u", "x")]},
}


@pytest.mark.parametrize("name", TABLES)
def test_odd_tables(spark, tmp_path, name):
    folder = written(spark, tmp_path, **TABLES[name])
    n = len(TABLES[name]["texts"])
    for query, f in queries.QUERIES.items():
        rows = f(spark, folder).collect()
        if query in BY_DOCUMENT:
            assert len(rows) == n, query
    assert corpus_pipeline.run(spark, folder).count() >= 0


def test_very_long_texts(spark, tmp_path):
    """A line of 3 MB, and 200,000 paragraphs, beside short texts."""
    texts = ["wort " * 600_000, "\n".join(f"paragraph {k} of very many" for k in range(200_000)), "short text", None]
    folder = written(spark, tmp_path, texts, labels=[(1, 1, 0), (2, 0, 1), (3, 1, 0)])
    for query, f in queries.QUERIES.items():
        rows = f(spark, folder).collect()
        if query in BY_DOCUMENT:
            assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4], query
        if query.startswith("op6"):
            assert {r.doc_id: r.n_lines for r in rows} == {1: 1, 2: 200_000, 3: 1, 4: 1}
        if query.startswith("op8"):
            assert sum(r.length for r in rows if r.doc_id == 3) == 3
