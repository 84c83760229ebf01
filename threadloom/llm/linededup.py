"""Line dedup: lines that many documents share stay only in the last of them.

Lines are exploded to hashes of their normalised form, each hash's distinct documents are counted,
and the documents drop their lines of frequent hashes, keeping all others by position. Texts never
leave their row: only (hash, id) pairs are counted, and each document gets back the list of its own
hashes that go. DataFrame functions only.

Defined cases: null or empty text is one empty line; a null id counts as one document, before all
others; rows with equal ids are one document in the counts; other columns are carried along, except
those named like the added ones, which are replaced (names that begin with ``_line_dedup_`` are the
operator's own); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import stored

#: ASCII white space and upper case, fixed by the contract.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER)


def key_hash(line: Column, min_chars: int) -> Column:
    """128 bits of the key of a long enough line, else null."""
    key = F.trim(line, F.lit(SPACE))
    low = F.translate(key, UPPER, LOWER)
    return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(low).alias("a"), F.xxhash64(F.lit("line"), low).alias("b")))


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added."""
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    at = F.coalesce(F.col(id_column), F.lit(-(1 << 63))).cast("long")
    keys = docs.select(at.alias("_line_dedup_id"), F.explode(F.array_distinct(F.filter(F.transform(lines, lambda x: key_hash(x, min_chars)), lambda k: k.isNotNull()))).alias("k")).select("_line_dedup_id", "k.a", "k.b")
    frequent = keys.groupBy("a", "b").agg(F.count_distinct("_line_dedup_id").alias("n"), F.max("_line_dedup_id").alias("last")).where(F.col("n") >= min_docs).drop("n")
    frequent = stored(frequent)[0]  # of known size: sent to all tasks if small, else a join whose hot lines can be split
    gone = keys.join(frequent, ["a", "b"]).where(F.col("_line_dedup_id") != F.col("last")).groupBy("_line_dedup_id").agg(F.collect_set(F.struct("a", "b")).alias("_line_dedup_gone"))
    out = docs.withColumn("_line_dedup_id", at).join(gone, "_line_dedup_id", "left").drop("_line_dedup_id")
    stays = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_line_dedup_gone"), key_hash(x, min_chars)), F.lit(False)))
    whole = F.col("_line_dedup_gone").isNull()
    out = out.withColumn("_line_dedup_stay", F.when(~whole, stays))
    return out.withColumns({
        "kept_text": F.when(whole, F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join("_line_dedup_stay", "\n")),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.when(whole, F.lit(0)).otherwise(F.size(lines) - F.size("_line_dedup_stay")).cast("long"),
    }).drop("_line_dedup_stay", "_line_dedup_gone")
