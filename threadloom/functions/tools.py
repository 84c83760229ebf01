"""Tool calls: fingerprints, argument summaries, command kinds, edit statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import line_count, normalize_inline, truncate


def fingerprint(name: Column, arguments: Column) -> Column:
    """name::arguments with keys sorted at every level (a variant keeps them sorted); text that isn't
    JSON stands for itself."""
    canonical = F.to_json(F.try_parse_json(arguments))
    return F.concat(name, F.lit("::"), F.coalesce(canonical, arguments, F.lit("{}")))


def argument(arguments: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(arguments), f"$.{key}", "string")


def text_argument(arguments: Column, key: str) -> Column:
    """An argument that is a string; null for other kinds."""
    v = F.try_variant_get(F.try_parse_json(arguments), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", argument(arguments, key))


def number_argument(arguments: Column, key: str) -> Column:
    """An argument that is a number, as a whole number where it is one."""
    v = F.try_variant_get(F.try_parse_json(arguments), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), argument(arguments, key).cast("double").cast("long"))


def shown_command(command: Column) -> Column:
    return truncate(normalize_inline(command), EXCERPT_CHARS)


#: How a commit begins, the test runners, and characters of an excerpt.
COMMIT = r"^git\s+commit\b"
TEST_RUNNERS = (r"bun\s+run", r"npm\s+test", r"pnpm\s+test", r"yarn\s+test", "vitest", "jest", "pytest", r"cargo\s+test", r"go\s+test")
EXCERPT_CHARS = 420


def command_kind(command: Column) -> Column:
    """commit if the text begins with one, test if a test runner is a word of it, else command."""
    return F.when(command.rlike(COMMIT), "commit").when(command.rlike(rf"(^|\s)({'|'.join(TEST_RUNNERS)})\b"), "test").otherwise("command")


def line_span(offset: Column, limit: Column) -> Column:
    """Lines of a read: Lx-Ly, Lx if at most one line is asked for; null without an offset."""
    begin = F.concat(F.lit("L"), offset.cast("string"))
    return F.when(limit > 1, F.concat(begin, F.lit("-L"), (offset + limit - 1).cast("string"))).otherwise(begin)


def argument_summary(arguments: Column) -> Column:
    """The most telling argument that isn't empty: path with pattern, path, command on one line, pattern;
    empty without any."""
    path, pattern, command = (F.nullif(text_argument(arguments, k), F.lit("")) for k in ("path", "pattern", "command"))
    return F.coalesce(F.concat(path, F.lit(" "), pattern), path, shown_command(command), pattern, F.lit(""))


def edit_stats(edits: Column) -> Column:
    """Edits and net lines added and removed of array<struct<old, new>>."""
    delta = lambda e: line_count(e["new"]) - line_count(e["old"])
    total = lambda f: F.aggregate(F.transform(edits, f), F.lit(0), lambda a, x: a + x)
    return F.struct(F.size(edits).alias("edit_count"), total(lambda e: F.greatest(delta(e), F.lit(0))).alias("added_lines"), total(lambda e: F.greatest(-delta(e), F.lit(0))).alias("removed_lines"))
