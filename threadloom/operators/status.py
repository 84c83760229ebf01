"""What is shown of a session's state, and where a captured request went."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.tokens import compact_number

#: Name of the status line; request paths and headers of providers.
STATUS = "DCP"
PATHS = {"anthropic": ("/messages",), "openai": ("/chat/completions", "/responses")}
HEADERS = {"anthropic": ("anthropic-version", "anthropic-beta", "x-api-key"), "openai": ("chatgpt-account-id", "openai-organization", "openai-project", "authorization")}


def status_line(tokens_saved: Column, realized: Column, prunes: Column, last_block: Column) -> Column:
    """Name, tokens saved (never below 0), prunes and the last active block, whichever there are."""
    saved = F.greatest(tokens_saved + F.coalesce(realized, F.lit(0)), F.lit(0))
    return F.concat_ws(" ", F.lit(STATUS), F.when(saved > 0, F.concat(compact_number(saved), F.lit(" saved"))), F.when(prunes > 0, F.concat(compact_number(prunes), F.lit(" prunes"))), F.concat(F.lit("b"), last_block.cast("string")))


def request_path(url: Column) -> Column:
    """A request's path without host, query and version prefix."""
    path = F.regexp_extract(F.regexp_replace(url, r"^[a-z]+://[^/?#]*", ""), r"^([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    return F.when(path == "/v1", "/").when(path.startswith("/v1/"), F.substring(path, 4, 2_000_000_000)).otherwise(path)


def provider(url: Column, headers: Column) -> Column:
    """The provider whose paths alone fit, else whose headers alone are there (names in lower case in
    ``headers``, array<string>), else null."""
    path = request_path(url)

    def alone(hits: dict[str, Column]) -> Column:
        first, second = hits.values()
        one, other = hits
        return F.when(first & ~second, one).when(second & ~first, other)

    by_path = {p: F.exists(F.array(*map(F.lit, paths)), lambda x: (path == x) | path.startswith(F.concat(x, F.lit("/")))) for p, paths in PATHS.items()}
    by_header = {p: F.arrays_overlap(headers, F.array(*map(F.lit, names))) for p, names in HEADERS.items()}
    return F.coalesce(alone(by_path), alone(by_header))
