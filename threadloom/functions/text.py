"""Text expressions: white space, truncation, tags, line counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as white space in inline text.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def trimmed(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, rf"\A{SPACE}+|{SPACE}+\z", "")


def normalize_inline(s: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(s, SPACE + "+", " "))


def truncate(s: Column, most: int) -> Column:
    """At most ``most`` characters, the last one an ellipsis if something is cut off."""
    return F.when(F.char_length(s) > most, F.concat(F.regexp_replace(F.substring(s, 1, most - 1), SPACE + "+$", ""), F.lit("…"))).otherwise(s)


def line_count(s: Column) -> Column:
    return F.when(F.coalesce(s, F.lit("")) == "", 0).otherwise(F.size(F.split(s, "\r?\n", -1)))


def first_sentence(s: Column, most: int = 200) -> Column:
    """On one line, up to the first sentence end after at most ``most`` characters, else that many."""
    line = normalize_inline(s)
    found = F.regexp_extract(line, r"^(.{0,%d}?[.!?])(\s|$)" % most, 1)
    return F.when(found != "", found).otherwise(F.substring(line, 1, most))


def plain_text(parts: Column) -> Column:
    """The texts of parts, a line each."""
    return F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")


def spoken_text(parts: Column) -> Column:
    """Of each part its text, else its input, those that aren't empty, on one line."""
    own = F.transform(parts, lambda p: F.coalesce(p["text"], p["input"]))
    return F.array_join(F.filter(own, lambda t: t.isNotNull() & (t != "")), " ")


def labelled_text(parts: Column) -> Column:
    """Parts with what they are: thoughts, calls with their arguments, images and others by type alone."""

    def one(p: Column) -> Column:
        call = F.concat(F.lit("[toolCall "), F.coalesce(p["name"], F.lit("unknown")), F.when(F.coalesce(p["id"], F.lit("")) != "", F.concat(F.lit(" "), p["id"])).otherwise(""), F.lit(" "), truncate(normalize_inline(F.coalesce(p["arguments"], F.lit("{}"))), 240), F.lit("]"))
        thought = F.concat(F.lit("[thinking] "), p["text"])
        return F.when((p["type"] == "text") & p["text"].isNotNull(), p["text"]).when((p["type"] == "thinking") & p["text"].isNotNull(), thought).when(p["type"] == "toolCall", call).when(p["type"].isNotNull(), F.concat(F.lit("["), p["type"], F.lit("]")))

    return F.array_join(F.filter(F.transform(parts, one), lambda t: t.isNotNull()), " ")


def listed(ids: Column, most: int) -> Column:
    """The first ``most`` ids, and how many more there are."""
    more = F.size(ids) - most
    return F.concat(F.array_join(F.slice(ids, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def escape_attribute(s: Column) -> Column:
    return F.replace(s, F.lit('"'), F.lit("&quot;"))


#: The protocol's tags, as they are shown, as they are made up, and as a row of nothing else holds them.
SHOWN_TAGS = (r"<dcp-id>[^<]*</dcp-id>", r"<dcp-owner>[^<]*</dcp-owner>", r"<dcp-block-id>[^<]*</dcp-block-id>", r"</?agent-summary>", r"<dcp-log\b[^>]*>", r"</dcp-log>", r"</?dcp-system-reminder>")
MADE_UP_TAGS = (r"(?i)<dcp[^>]*>[\s\S]*?</dcp[^>]*>", r"(?i)</?dcp[^>]*>", r"""(?i)<parameter\s+name=["']owner["'][^>]*>[\s\S]*?</parameter>""")
OWNER_TAGS = r"(?i)<dcp-id>m\d{3,4}</dcp-id>|<dcp-owner>[^<]+</dcp-owner>|<dcp-block-id>b\d+</dcp-block-id>"


def strip_metadata(s: Column) -> Column:
    """Visible metadata tags, each replaced by a blank; the text around them stays."""
    for tag in SHOWN_TAGS:
        s = F.regexp_replace(s, tag, " ")
    return s


def strip_hallucinated(s: Column) -> Column:
    """Protocol tags that a model made up: pairs with what they hold, single tags, owner parameters."""
    for tag in MADE_UP_TAGS:
        s = F.regexp_replace(s, tag, "")
    return s


def is_metadata_only(s: Column) -> Column:
    """Nothing but well-formed reference, owner and block tags and white space, and at least one tag."""
    line = normalize_inline(s)
    return F.coalesce((line != "") & (F.trim(F.regexp_replace(line, OWNER_TAGS, "")) == ""), F.lit(False))


def strip_envelope(s: Column) -> Column:
    return trimmed(F.regexp_replace(s, r'<dcp-summary version="1">[\s\S]*?</dcp-summary>', ""))


def excerpt(s: Column, most: int = 420) -> Column:
    return truncate(normalize_inline(s), most)
