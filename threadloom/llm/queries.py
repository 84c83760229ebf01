"""Queries over whole tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bwtdedup, divergence, iblt, kneserney, langid, linededup, mixing, packing, pii, prefixtrie, rules, setjoin, toxicity
from threadloom.llm.common import discard, n_words, settle, stored, table


def op1_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(docs)).drop("text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    measured = settle(rules.statistics(docs.select("doc_id", "text")).drop("text"))
    learned = rules.learn(measured, labels)
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rules.base_failed().alias("base_failed"), rules.verdict(learned).alias("kept"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bwtdedup.dedup_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), frequent AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, f.k IS NOT NULL AND l.doc_id <> f.last AS gone FROM lines l LEFT JOIN frequent f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = settle(docs.select("doc_id", "source", n_words().alias("size")))
    planned = mixing.plan(sized).withColumn("position", F.when(F.col("taken") > 0, mixing.position()))
    return planned.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), F.xxhash64("doc_id"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted: documents labelled of good quality. Those with crc32(id) mod 5 = 0 give the quantiles, all
    others the model: a model knows its own texts too well to set thresholds by them."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("apart"))
    trusted = docs.join(good.where("not apart"), "doc_id", "left_semi")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go with the step that wrote them
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        texts, folder = stored(trusted.select("text"))  # read once for each part
        model = kneserney.Model(kneserney.count(texts))
        discard(folder)
        scored = settle(kneserney.scored(docs, model))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    model.discard()
    return kneserney.classify(scored, scored.join(good.where("apart"), "doc_id", "left_semi")).select("doc_id", "lang", "perplexity", "most", "kept")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs.where(fold != 1)))
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), found AS (
  SELECT lang, source, d, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT d) >= 10
), used AS (
  SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT g.lang, g.source, coalesce(sum(u.n), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source GROUP BY g.lang, g.source
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(u.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 2)) // (s.n + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v) AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN used u ON u.lang = s.lang AND u.source = s.source AND u.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
), terms AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefixtrie.turn_lists(table(spark, sf_dir, "conversations"))
    return prefixtrie.trie(prefixtrie.sequences(prefixtrie.rebuilt(lists)))


#: The checksum of the decimal id is taken bit by bit; a node is named by the list of its turns.
OP13_SQL = r"""
WITH RECURSIVE own AS (
  SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY has, turn, key) AS pos
  FROM (SELECT conv_id, turn IS NOT NULL AS has, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
        FROM conversations WHERE conv_id IS NOT NULL)
), bits AS (
  SELECT c, 0 AS step, 4294967295::BIGINT AS crc FROM (SELECT DISTINCT c FROM own)
  UNION ALL
  SELECT c, step + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT c, step, CASE WHEN step % 8 = 0 THEN xor(crc, ascii(substr(c::VARCHAR, step // 8 + 1, 1))) ELSE crc END AS x
        FROM bits WHERE step < 8 * length(c::VARCHAR))
), heads AS (
  SELECT c, c - c % 100 AS base, xor(crc, 4294967295) % 6 AS h FROM bits WHERE step = 8 * length(c::VARCHAR)
), turns AS (
  SELECT h.c, 0 AS part, o.pos, o.role, o.text FROM heads h JOIN own o ON o.c = h.base AND o.pos <= h.h
  UNION ALL
  SELECT h.c, 1, o.pos, o.role, o.text FROM heads h JOIN own o ON o.c = h.c AND o.pos > h.h
), built AS (
  SELECT h.c, coalesce(list({'role': t.role, 'text': t.text} ORDER BY t.part, t.pos) FILTER (WHERE t.c IS NOT NULL), []) AS seq
  FROM heads h LEFT JOIN turns t ON t.c = h.c GROUP BY h.c
), members AS (
  SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM built
), nodes AS (
  SELECT seq[1:d] AS path, d, min(c) AS c, count(*) AS n,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(seq) = d), '')) AS ends
  FROM members GROUP BY seq[1:d], d
), family AS (
  SELECT x.path, x.d, x.c, x.n, x.ends, p.c AS parent, (SELECT count(*) FROM nodes k WHERE k.d = x.d + 1 AND k.path[1:x.d] = x.path) AS kids,
         CASE WHEN x.d = 0 THEN 0 ELSE (x.n - 1) * length(x.path[x.d].text) END AS saved
  FROM nodes x LEFT JOIN nodes p ON p.d = x.d - 1 AND p.path = x.path[1:x.d - 1]
), up AS (
  SELECT path[1:k] AS path, sum(saved) AS saved, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT path, d, saved, kids, unnest(range(0, d + 1)) AS k FROM family) GROUP BY path[1:k]
)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, f.parent AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children,
       u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM family f JOIN up u ON u.path = f.path
"""


QUERIES = {
    "op1_iblt_fingerprints": op1_iblt_fingerprints,
    "op2_pii": op2_pii,
    "op3_quality_rules": op3_quality_rules,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_bwt_dedup": op5_bwt_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_language_id": op11_language_id,
    "op12_source_divergence": op12_source_divergence,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL = {"op6_line_dedup": OP6_SQL, "op12_source_divergence": OP12_SQL, "op13_prefix_trie": OP13_SQL}
