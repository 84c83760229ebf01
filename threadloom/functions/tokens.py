"""Token estimates and limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import utf16_length

#: Characters a token, tokens an image.
CHARS_A_TOKEN, IMAGE_TOKENS = 4, 500


def estimate(s: Column) -> Column:
    """round(length / 4), halves up; 0 of nothing."""
    return F.floor(F.coalesce(utf16_length(s), F.lit(0)) / CHARS_A_TOKEN + 0.5).cast("long")


def part_estimate(part: Column) -> Column:
    """A part counts its text, else its thinking, else its input, else, if it is an image, a flat number."""
    own = F.coalesce(part["text"], part["thinking"], part["input"])
    return F.when(own.isNull() & (part["type"] == "image"), F.lit(IMAGE_TOKENS).cast("long")).otherwise(estimate(own))


def message_estimate(content: Column, parts: Column) -> Column:
    own = F.aggregate(parts, F.lit(0).cast("long"), lambda total, p: total + part_estimate(p))
    return F.when(content.isNotNull(), estimate(content)).otherwise(F.coalesce(own, F.lit(0).cast("long")))


def effective_context(host: Column, own: Column, window: Column) -> tuple[Column, Column]:
    """The larger of both estimates, and its share of the window (null without one)."""
    finite = lambda c: F.when(c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.greatest(c.cast("double"), F.lit(0.0))).otherwise(0.0)
    tokens = F.greatest(finite(host), finite(own))
    return tokens, F.when(window > 0, tokens / window)


def exceeds_max(percent: Column, tokens: Column, config: dict) -> Column:
    hit = percent > config["maxContextPercent"]
    if config.get("maxContextTokens") is not None:
        hit = hit | F.coalesce(tokens > config["maxContextTokens"], F.lit(False))
    return hit


def reaches_min(percent: Column, tokens: Column, config: dict) -> Column:
    hit = percent >= config["minContextPercent"]
    if config.get("minContextTokens") is not None:
        hit = hit | F.coalesce(tokens >= config["minContextTokens"], F.lit(False))
    return hit


def clamp_ratio(r: Column) -> Column:
    return F.when(r.isNull() | F.isnan(r) | (F.abs(r) == float("inf")), 0.0).otherwise(F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0)))


def _tenths(n: Column, unit: int) -> Column:
    """n / unit to one place, in tenths, as the nearest to that number in binary: 9.95 lies below its half.

    Whether the number d reaches the half (2k + 1) / 20 is decided without rounding: 16 d and 4 d are exact,
    and so are both differences, as their terms lie within a factor of two.
    """
    d, k = n.cast("double") / unit, F.floor(n * 10 / unit).cast("long")
    beyond = (d * 16 - (2 * k + 1)) + d * 4
    return k + F.when((k > 0) & (beyond >= 0), 1).otherwise(0)


def _one_place(tenths: Column) -> Column:
    return F.regexp_replace(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")), r"\.0$", "")


def short_number(n: Column) -> Column:
    """950, 1.5k, 15k, 1.5M: one place below ten, none from ten on, without a zero at the end."""

    def scaled(unit: int, letter: str) -> Column:
        return F.concat(F.when(n >= 10 * unit, F.floor((n + unit / 2) / unit).cast("string")).otherwise(_one_place(_tenths(n, unit))), F.lit(letter))

    return F.when(n >= 1_000_000, scaled(1_000_000, "M")).when(n >= 1_000, scaled(1_000, "k")).otherwise(n.cast("string"))


def truncate_by_tokens(s: Column, most: int) -> Column:
    """Of a text with more than ``most`` tokens, as large a share of its head, and a note on the rest."""
    from threadloom.functions.text import SPACE

    total = estimate(s)
    head = F.regexp_replace(s.substr(F.lit(1), F.floor(F.char_length(s) * (most / total)).cast("int")), SPACE + "+$", "")
    note = F.concat(head, F.lit("\n[truncated ~"), (total - estimate(head)).cast("string"), F.lit(" tokens of previous summary]"))
    return F.when((total > most) & F.lit(most > 0), note).otherwise(s)


def compact_number(n: Column) -> Column:
    """999, 1.8k, 269k, 1.012M, 1M: one place below a hundred thousand, three from a million on, without
    zeros at the end; places are those nearest in binary, as in ``short_number``."""
    n = F.greatest(F.round(n).cast("long"), F.lit(0).cast("long"))
    d, k = n.cast("double") / 1_000_000, F.floor(n / 1000).cast("long")
    beyond = ((d * 2048 - (2 * k + 1)) - d * 32) - d * 16  # d against (2k + 1) / 2000, exactly
    thousandths = k + F.when(beyond >= 0, 1).otherwise(0)
    three = F.regexp_replace(F.concat(F.floor(thousandths / 1000).cast("string"), F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, "0")), r"\.?0+$", "")
    whole = F.floor((n + 500) / 1000).cast("string")
    return F.when(n < 1_000, n.cast("string")).when(n < 100_000, F.concat(_one_place(_tenths(n, 1000)), F.lit("k"))).when(n < 999_500, F.concat(whole, F.lit("k"))).when(n < 1_000_000, F.lit("1M")).otherwise(F.concat(three, F.lit("M")))
