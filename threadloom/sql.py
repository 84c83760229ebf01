"""The operators from SQL: table functions over partitioned tables, and scalar functions.

``register(spark)`` makes, for the session:

- ``session_spans(TABLE(rows))`` and ``candidate_ranges(TABLE(spans), top)``: table functions whose ``analyze``
  checks the table's columns, takes over the type of its session_id, and has Spark partition it by
  session and sort it, so a query need not say so. Rows are as those of ``operators.transcript.spans`` and
  ``operators.coverage.candidate_ranges``.
- ``estimate_tokens``, ``normalize_inline``, ``truncate_text``, ``format_ref``, ``call_fingerprint``, ``turn_bucket``:
  SQL functions, inlined into the plan like any expression.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from threadloom.functions.text import SPACE
from threadloom.operators import transcript


def _by_session(table: AnalyzeArgument, needed: tuple[str, ...], columns: list[tuple[str, object]]) -> AnalyzeResult:
    """The result of a function over a table by session, in order of ordinal."""
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(...)")
    given = {f.name: f.dataType for f in table.dataType.fields}
    missing = [c for c in ("session_id", "ordinal", *needed) if c not in given]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    schema = StructType([StructField("session_id", given["session_id"]), *(StructField(name, kind) for name, kind in columns)])
    return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("session_id")], orderBy=[OrderingColumn("ordinal")])


class SessionSpans:
    """Rows of a session to spans; only the open exchange is held."""

    def __init__(self):
        self.session, self.head, self.asked, self.hits, self.taken = None, None, set(), 0, []

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        number, text = LongType(), StringType()
        return _by_session(table, ("role", "calls", "tool_call_id"), [("span_head", number), ("lo", number), ("hi", number), ("n_rows", number), ("kind", text), ("is_turn", BooleanType())])

    def eval(self, row) -> Iterator[tuple]:
        self.session, ordinal, role = row["session_id"], row["ordinal"], row["role"]
        if self.head is not None:
            hit = role in transcript.RESULT_ROLES and row["tool_call_id"] in self.asked
            if hit or role in transcript.PASSTHROUGH:
                self.taken.append((ordinal, role))
                self.hits += hit
                return
            yield from self._closed()
        if role == "assistant" and row["calls"]:
            self.head, self.asked, self.hits, self.taken = ordinal, set(row["calls"]), 0, [(ordinal, role)]
        else:
            yield self._single(ordinal, role)

    def terminate(self) -> Iterator[tuple]:
        if self.head is not None:
            yield from self._closed()

    def _single(self, ordinal: int, role: str) -> tuple:
        return (self.session, ordinal, ordinal, ordinal, 1, "message", role in transcript.TURN_ROLES)

    def _closed(self) -> Iterator[tuple]:
        if self.hits:
            yield (self.session, self.head, self.head, self.taken[-1][0], len(self.taken), "tool-exchange", True)
        else:
            yield from (self._single(*t) for t in self.taken)
        self.head, self.taken = None, []


class CandidateRanges:
    """Spans of a session to the ``top`` largest stretches; a stretch is a few numbers."""

    def __init__(self):
        self.session, self.top, self.found, self.open, self.pending = None, 10, [], None, [0, 0]

    @staticmethod
    def analyze(table: AnalyzeArgument, top: AnalyzeArgument) -> AnalyzeResult:
        if top.value is None or top.value < 1:
            raise ValueError("top is a number from 1 on")
        number, text = LongType(), StringType()
        return _by_session(table, ("kind", "ref", "tokens"), [("start_ref", text), ("end_ref", text), ("tokens", number), ("n_spans", number), ("all_tokens", number), ("all_ranges", number), ("rank", number)])

    def eval(self, row, top: int) -> None:
        self.session, self.top = row["session_id"], top
        kind, tokens = row["kind"], row["tokens"] or 0
        if kind == "F":
            self._close()
        elif kind == "R" and tokens > 0:
            if self.open is None:
                self.open = [row["ref"], row["ref"], tokens, 1]
            else:
                self.open = [self.open[0], row["ref"], self.open[2] + self.pending[0] + tokens, self.open[3] + self.pending[1] + 1]
            self.pending = [0, 0]
        elif self.open is not None:  # counts if a reference follows
            self.pending = [self.pending[0] + tokens, self.pending[1] + 1]

    def terminate(self) -> Iterator[tuple]:
        self._close()
        self.found.sort(key=lambda r: (-r[2], r[0].encode()))
        for rank, (start, end, tokens, n) in enumerate(self.found[: self.top], 1):
            yield (self.session, start, end, tokens, n, sum(r[2] for r in self.found), len(self.found), rank)

    def _close(self) -> None:
        if self.open is not None and self.open[2] > 0:
            self.found.append(tuple(self.open))
        self.open, self.pending = None, [0, 0]


_SPACE = SPACE.replace("\\", "\\\\")
#: name -> (parameters, result, body)
FUNCTIONS = {
    "estimate_tokens": ("s STRING", "BIGINT", "CAST(floor(coalesce(length(encode(s, 'UTF-16BE')) / 2, 0) / 4 + 0.5) AS BIGINT)"),
    "normalize_inline": ("s STRING", "STRING", f"trim(regexp_replace(s, '{_SPACE}+', ' '))"),
    "truncate_text": ("s STRING, most INT", "STRING", f"CASE WHEN char_length(s) > most THEN concat(regexp_replace(substring(s, 1, most - 1), '{_SPACE}+$', ''), '…') ELSE s END"),
    "format_ref": ("n BIGINT", "STRING", "concat('m', CASE WHEN n < 10000 THEN lpad(CAST(n AS STRING), 4, '0') ELSE CAST(n AS STRING) END)"),
    "call_fingerprint": ("name STRING, arguments STRING", "STRING", "concat(name, '::', coalesce(to_json(try_parse_json(arguments)), arguments, '{}'))"),
    "turn_bucket": ("turn BIGINT, cadence INT", "BIGINT", "CASE WHEN cadence <= 1 THEN turn ELSE CAST(floor(turn / cadence) * cadence AS BIGINT) END"),
}


def register(spark: SparkSession) -> None:
    spark.udtf.register("session_spans", udtf(SessionSpans))
    spark.udtf.register("candidate_ranges", udtf(CandidateRanges))
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
