"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests (DataFrame functions only).

A text is the set of 64-bit digests of its paragraphs - here lines, long ones cut at the ends of clauses,
so that texts of few lines share something too. A sketch has three rows of cells; each digest is added to
one cell of every row, which keeps a count, the xor of its digests and the xor of their checks. Subtracting
the sketches of two versions cell by cell leaves their differing digests; a cell with count 1 or -1 and
a fitting check gives one of them away, taking it out frees others (peeling), until nothing is left.

Cells are rows of a DataFrame, and only those that hold something. They stay where their document's text
was laid for its comparison, so building, subtracting and peeling need no further shuffle: each is an
explode and a hash aggregate. A round of peeling takes the pure cells of one row of cells, where no digest
stands twice; rows take turns. What is left is written after every ``ROUNDS_A_STAGE`` rounds: each grouping
of a stage holds memory of its own, and little is left by then. Documents that can't be peeled to nothing
are tried again with a larger sketch. Rows of cells are powers of two wide, so that a sketch folds to a narrower one: ``fingerprint`` is
the one folded to ``CELLS`` cells a row. Likeness is the Jaccard index of the digest sets, known exactly
from their sizes and the recovered difference.

Defined cases: null text counts as empty; empty texts have no digest, are alike to each other (1) and
to nothing else (0); repeated paragraphs count once; rows with equal ids follow each other by a hash of
the text; null ids come last; a single row is its own next one; empty tables give empty results; columns
beside id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import settle

#: A paragraph digest covers a line, or so much of a long one: up to the first clause end after 100 characters.
PIECE = r"[^\n]{100}[^\n.!?,;:]*[.!?,;:]*|[^\n]+"
#: Cells a row of the fingerprint.
CELLS = 4
#: Cells a row for each digest of both texts: at first, and when a difference could not be peeled.
SCALES = (8, 64, 512)
ROUNDS, ROUNDS_A_STAGE = 9, 3
#: Rows that one range of ids should hold when documents are put in order.
ROWS_A_RANGE = 500
MOST_RANGES = 1 << 16
#: Ranges that one task lays out on average.
RANGES_A_TASK = 2
#: What a cell belongs to: two differences (to the edited text, to the next one) and two fingerprints.
EDITED, NEXT, OWN, OTHER = range(4)


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def cell_of(key: Column, row: int, width: Column) -> Column:
    """A digest's cell in one row of cells, counted through all rows."""
    return F.shiftrightunsigned(key, 20 * row).bitwiseAND(width - 1) + width * row


def width_for(n: Column, scale: int) -> Column:
    """A power of two of at least ``scale`` cells a digest, at most 2**20."""
    return F.pow(F.lit(2.0), F.least(F.lit(20.0), F.ceil(F.log2(F.greatest(F.lit(CELLS), n * scale))))).cast("long")


def gathered(rows: DataFrame) -> DataFrame:
    """Cells from what was put into them."""
    cells = rows.groupBy("_r", "_row", "kind", "width", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
    return cells.where((F.col("kind") >= OWN) | (F.col("n") != 0) | (F.col("key") != 0))


def laid(rows: DataFrame, parts: int) -> DataFrame:
    """By range, where groupings and joins by document find their rows."""
    return rows.repartition(parts, "_r")


def sketches(pairs: DataFrame, scale: int) -> DataFrame:
    """Both subtracted sketches of rows with digests a (own), b (edited), c (next)."""
    sizes = pairs.withColumns({"_we": width_for(F.size("a") + F.size("b"), scale), "_wx": width_for(F.size("a") + F.size("c"), scale)})
    texts = sizes.select("_r", "_row", "_we", "_wx", F.explode(F.array(*(F.struct(F.lit(tag).alias("tag"), F.col(c).alias("keys")) for tag, c in enumerate("abc")))).alias("t"))
    keys = texts.select("_r", "_row", "_we", "_wx", F.col("t.tag").alias("tag"), F.explode("t.keys").alias("key"))

    def put(kind: int, n: int, width: Column) -> list[Column]:
        return [F.struct(F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("n"), width.alias("width"), cell_of(F.col("key"), row, width).alias("cell")) for row in range(3)]

    e, x = F.col("_we"), F.col("_wx")
    puts = F.when(F.col("tag") == 0, F.array(*put(EDITED, 1, e), *put(NEXT, 1, x))).when(F.col("tag") == 1, F.array(*put(EDITED, -1, e))).otherwise(F.array(*put(NEXT, -1, x)))
    return gathered(keys.select("_r", "_row", "key", F.hash("key").cast("long").alias("check"), F.explode(puts).alias("p")).select("_r", "_row", "p.*", "key", "check"))


def peeled(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Cells after some rounds; cell -1 counts the digests recovered."""
    for k in range(rounds):
        row = k % 3
        pure = (F.col("kind") < OWN) & (F.floor(F.col("cell") / F.col("width")) == row) & (F.abs("n") == 1) & (F.hash("key") == F.col("check"))

        def moved(cell: Column, n: Column, key: Column, check: Column) -> Column:
            return F.struct(cell.alias("cell"), n.alias("n"), key.alias("key"), check.alias("check"))

        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        out = [moved(cell_of(F.col("key"), other, F.col("width")), -F.col("n"), F.col("key"), F.col("check")) for other in range(3) if other != row]
        rows = F.when(pure, F.array(*out, moved(-one, one, zero, zero))).otherwise(F.array(moved(*map(F.col, ("cell", "n", "key", "check")))))
        cells = gathered(cells.select("_r", "_row", "kind", "width", F.explode(rows).alias("p")).select("_r", "_row", "kind", "width", "p.*"))
    return cells


def size_of(kind: int) -> Column:
    """Of a peeled difference; null if something is left."""
    own = F.col("kind") == kind
    left = F.count_if(own & (F.col("cell") >= 0))
    return F.when(left == 0, F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)))


def text_of(kind: int) -> Column:
    """A fingerprint's cells in order: place, count, digests, checks."""
    cell = F.struct("cell", F.concat_ws(".", F.col("n").cast("string"), F.lower(F.hex("key")), F.lower(F.hex(F.col("check").cast("int")))).alias("t"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, cell))), lambda c: F.concat_ws(":", c["cell"].cast("string"), c["t"])), ",")


def differences(pairs: DataFrame, scale: int, parts: int) -> DataFrame:
    """(_r, _row, de, dx): sizes of both differences, null if not peeled to nothing; no row without digests that
    differ."""
    cells = sketches(laid(pairs, parts), scale)
    for done in range(0, ROUNDS, ROUNDS_A_STAGE):
        cells = laid(settle(peeled(cells, min(ROUNDS_A_STAGE, ROUNDS - done))), parts)
    return settle(cells.groupBy("_r", "_row").agg(size_of(EDITED).alias("de"), size_of(NEXT).alias("dx")))


def counted(pairs: DataFrame) -> DataFrame:
    """As ``differences``, digest by digest: exact at any size, for what no sketch could be peeled of."""
    texts = pairs.select("_r", "_row", F.explode(F.array(*(F.struct(F.lit(tag).alias("tag"), F.col(c).alias("keys")) for tag, c in enumerate("abc")))).alias("t"))
    keys = texts.select("_r", "_row", F.col("t.tag").alias("tag"), F.explode("t.keys").alias("key"))
    held = keys.groupBy("_r", "_row", "key").agg(*(F.bool_or(F.col("tag") == tag).alias(c) for tag, c in enumerate("abc")))
    return held.groupBy("_r", "_row").agg(F.count_if(F.col("a") != F.col("b")).alias("de"), F.count_if(F.col("a") != F.col("c")).alias("dx"))


def written_cells(pairs: DataFrame) -> DataFrame:
    """(_r, _row, fa, fb): both fingerprints."""
    width, texts = F.lit(CELLS).cast("long"), pairs.select("_r", "_row", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("keys")) for kind, c in ((OWN, "a"), (OTHER, "b"))))).alias("t"))
    keys = texts.select("_r", "_row", F.col("t.kind").alias("kind"), F.explode("t.keys").alias("key"))
    puts = F.explode(F.array(*(cell_of(F.col("key"), row, width) for row in range(3)))).alias("cell")
    cells = gathered(keys.select("_r", "_row", "kind", F.lit(1).cast("long").alias("n"), width.alias("width"), puts, "key", F.hash("key").cast("long").alias("check")))
    return cells.groupBy("_r", "_row").agg(text_of(OWN).alias("fa"), text_of(OTHER).alias("fb"))


def with_next(docs: DataFrame, *, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Add the text of the next document in descending order of ids; the last is followed by the first.

    Ids are cut into ranges by approximate quantiles; each range is sorted in a task of its own, with the
    first row of the range below it (of the topmost for the lowest) copied to its end. ``_r`` is the range,
    ``_row`` the place in it.
    """
    n = docs.count()
    many = int(max(1, min(MOST_RANGES, n // rows_a_range)))
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / many for i in range(1, many)], 1 / (4 * many)))) if many > 1 else []
    wide = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    at = F.lit(0)
    if groups:  # find the group by its first bound, then the place in it
        upto = F.size(F.filter(F.array(*(F.lit(int(g[0])) for g in groups)), lambda b: b <= F.col("doc_id")))
        inside = F.element_at(F.array(*(F.array(*(F.lit(int(b)) for b in g)) for g in groups)), F.greatest(upto, F.lit(1)))
        at = F.when(upto == 0, 0).otherwise((upto - 1) * wide + F.size(F.filter(inside, lambda b: b <= F.col("doc_id"))))
    rows = docs.withColumn("_range", F.coalesce(at, F.lit(0)).cast("int")).withColumn("_hash", F.xxhash64("text"))
    heads = rows.groupBy("_range").agg(F.max("doc_id").alias("_head"))
    above = F.lead("_range").over(Window.orderBy("_range"))
    top = F.min("_range").over(Window.partitionBy(F.lit(1)))
    heads = heads.select(F.col("_head"), F.coalesce(above, top).alias("_to"))  # one row for each range
    rows = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    places = F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy")), F.struct(F.col("_to").alias("r"), F.lit(1).alias("copy"))))
    rows = rows.withColumn("_place", F.explode(places)).select("*", F.col("_place.r").alias("_r"), F.col("_place.copy").alias("_copy"))
    rows = rows.repartition(max(1, many // RANGES_A_TASK), "_r")
    order = Window.partitionBy("_r").orderBy("_copy", F.col("doc_id").desc_nulls_last(), "_hash")
    return rows.withColumns({"next_text": F.lead("text").over(order), "_row": F.row_number().over(order)}).where("_copy = 0").drop("_place", "_copy", "_range", "_hash", "_head", "_to")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Written before it is returned: groupings and joins by document use a layout by range, for which a setting
    of the session is changed until then.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return settle(_fingerprints(docs))
    finally:
        conf.set(name, before)


def _fingerprints(docs: DataFrame) -> DataFrame:
    texts = with_next(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    half = F.floor(F.char_length("text") / 2).cast("int")
    texts = texts.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half)))
    digest = {name: digests(F.col(t)).alias(name) for t, name in (("text", "a"), ("edited", "b"), ("next_text", "c"))}
    # what follows needs no text: digests are laid out by range, groupings and joins by document find them so
    pairs = settle(texts.select("_r", "_row", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"), *digest.values()))
    parts = max(1, pairs.rdd.getNumPartitions())
    failing = "de is null or dx is null"
    tried = differences(pairs, SCALES[0], parts)
    found, failed = tried.where(f"not ({failing})"), tried.where(failing)
    for scale in SCALES[1:]:
        if not failed.take(1):
            break
        tried = differences(pairs.join(failed, ["_r", "_row"], "left_semi"), scale, parts)
        found, failed = found.unionByName(tried.where(f"not ({failing})")), tried.where(failing)
    if failed.take(1):
        found = found.unionByName(counted(pairs.join(failed, ["_r", "_row"], "left_semi")))
    pairs = laid(pairs, parts)
    sizes = pairs.select("_r", "_row", "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), *(F.size(c).cast("double").alias(f"n{c}") for c in "abc"))
    out = sizes.join(written_cells(pairs), ["_r", "_row"], "left").join(laid(found, parts), ["_r", "_row"], "left")

    def likeness(other: str, differ: str) -> Column:
        n, d = F.col("na") + F.col(other), F.coalesce(F.col(differ), F.lit(0))
        return F.when(n == 0, 1.0).otherwise((n - d) / (n + d))

    def written(size: str, cells: str) -> Column:
        return F.concat(F.col(size).cast("long").cast("string"), F.lit("|"), F.coalesce(F.col(cells), F.lit("")))

    return out.select("doc_id", "n_chars", "edited_sha256", written("na", "fa").alias("fingerprint"), written("nb", "fb").alias("edited_fingerprint"), likeness("nb", "de").alias("near_edited"), likeness("nc", "dx").alias("near_next"))
