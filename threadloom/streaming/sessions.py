"""Sessions as streams: replay, exchanges and the reminder debounce with state kept by Spark.

Replay and exchanges keep keyed state variables, of which a batch reads and writes what it touches; they need the
RocksDB state store (``use_keyed_state``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, MutableMapping
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.operators import transcript
from threadloom.operators.replay import STATE, Numbers, Rules, Session, events_of, fold, observed


def use_keyed_state(spark: SparkSession) -> None:
    """Choose the state store that state variables need, if the session hasn't chosen any."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name) or ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Kept(MutableMapping):
    """A map state as a mapping of lists. What a batch has read is remembered, what it has changed is written
    by ``flush``; the rest is not touched."""

    def __init__(self, state, key: type):
        self.state, self.key = state, key
        self.read: dict = {}
        self.changed: set = set()
        self.whole = False

    def __getitem__(self, k):
        if k not in self.read and not self.whole:
            found = self.state.getValue((k,)) if self.state.containsKey((k,)) else None
            self.read[k] = None if found is None else json.loads(found[0])
        if self.read.get(k) is None:
            raise KeyError(k)
        return self.read[k]

    def __setitem__(self, k, value) -> None:
        self.read[k] = value
        self.changed.add(k)

    def __delitem__(self, k) -> None:
        self[k]
        self.read[k] = None
        self.changed.add(k)

    def _all(self) -> None:
        if not self.whole:
            for k, v in self.state.iterator():
                k = self.key(k[0])
                if k not in self.read:
                    self.read[k] = json.loads(v[0])
            self.whole = True

    def __iter__(self) -> Iterator:
        self._all()
        return iter(sorted(k for k, v in self.read.items() if v is not None))

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def flush(self) -> None:
        for k in self.changed:
            if self.read[k] is None:
                self.state.removeKey((k,))
            else:
                self.state.updateValue((k,), (json.dumps(self.read[k]),))
        self.changed.clear()


class Replaying(StatefulProcessor):
    """The fold of ``operators.replay`` over state variables: a value with the numbers, and a map each for rows,
    references, calls, results, blocks and pruned results."""

    BY_NUMBER, BY_TEXT = ("rows", "refs", "blocks"), ("calls", "results", "pruned")

    def __init__(self, rules: Rules):
        self.given = asdict(rules)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getValueState("numbers", "numbers string")
        self.maps = {name: (handle.getMapState(name, "k long", "v string"), int) for name in self.BY_NUMBER} | {name: (handle.getMapState(name, "k string", "v string"), str) for name in self.BY_TEXT}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = {name: Kept(state, kind) for name, (state, kind) in self.maps.items()}
        numbers = Numbers(**json.loads(self.numbers.get()[0])) if self.numbers.exists() else Numbers()
        session, rules = Session(numbers, **kept), Rules(**self.given)
        before = self._material(session)
        for event in events_of(pd.concat(list(rows)).sort_values("pos")):
            fold(session, event, rules)
        self.numbers.update((json.dumps(asdict(numbers)),))
        for m in kept.values():
            m.flush()
        yield pd.DataFrame([observed(key[0], session, rules) | {"pending_save": self._material(session) != before}])

    @staticmethod
    def _material(s: Session) -> tuple:
        """What is worth a new snapshot when it changes: blocks, pruned results, compactions."""
        return s.numbers.next_block_id, s.numbers.lifetime_saved, sorted(i for i, b in s.blocks.items() if b["active"]), sorted(s.pruned)

    def close(self) -> None:
        pass


def replay_stream(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """As ``operators.replay.replay``: after each batch the state of the sessions it touched, and pending_save:
    whether it has changed in what a snapshot is for."""
    use_keyed_state(events.sparkSession)
    return events.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Replaying(rules), outputStructType=f"{STATE}, pending_save boolean", outputMode="Update", timeMode="None")


SPANS = "session_id string, span_head long, lo long, hi long, n_rows long, kind string, is_turn boolean"


class Spanning(StatefulProcessor):
    """Rows of a session, in order, to spans: an exchange stays open while its results and passthrough rows come. It is
    closed by any other row, or by a timer ``patience`` milliseconds of event time after its last row."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "head long, calls array<string>, hits long, timer long")
        self.taken = handle.getListState("taken", "ordinal long, role string, hit boolean")

    def _closed(self, session: str) -> list[tuple]:
        """Spans of what was taken in. Without a result each row stands alone, and so do passthrough rows
        after an unanswered call."""
        head, _, hits, timer = self.open.get()
        rows = list(self.taken.get())
        self.handle.deleteTimer(timer)
        self.open.clear()
        self.taken.clear()
        if hits:
            return [(session, head, head, rows[-1][0], len(rows), "tool-exchange", True)]
        return [self._single(session, ordinal, role) for ordinal, role, _ in rows]

    @staticmethod
    def _single(session: str, ordinal: int, role: str) -> tuple:
        return (session, ordinal, ordinal, ordinal, 1, "message", role in transcript.TURN_ROLES)

    def _later(self, timer: int | None, at: int) -> int:
        due = max(at, 0) + self.patience
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if timer != due:
            self.handle.registerTimer(due)
        return due

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("ordinal").itertuples(index=False):
            calls, at = [] if r.calls is None else list(r.calls), int(r.at_ms)
            if self.open.exists():
                head, asked, hits, timer = self.open.get()
                hit = r.role in transcript.RESULT_ROLES and r.tool_call_id in set(asked)
                if hit or r.role in transcript.PASSTHROUGH:
                    self.taken.appendValue((int(r.ordinal), r.role, bool(hit)))
                    self.open.update((head, list(asked), hits + hit, self._later(timer, at)))
                    continue
                out += self._closed(key[0])
            if r.role == "assistant" and calls:
                self.taken.put([(int(r.ordinal), r.role, False)])
                self.open.update((int(r.ordinal), calls, 0, self._later(None, at)))
            else:
                out.append(self._single(key[0], int(r.ordinal), r.role))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._closed(key[0]) if self.open.exists() else [])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in SPANS.split(", ")]
        return pd.DataFrame(rows, columns=names) if rows else pd.DataFrame({c: pd.Series([], dtype="object" if c in ("session_id", "kind") else "bool" if c == "is_turn" else "int64") for c in names})

    def close(self) -> None:
        pass


def spans_stream(rows: DataFrame, patience: str = "10 minutes", lateness: str = "0 seconds") -> DataFrame:
    """As ``operators.transcript.spans`` (without keys and times), each span once it is closed.

    ``rows``: session_id string, ordinal long, role, calls array<string>, tool_call_id, and event_time, by which an
    exchange that gets no further row is closed; state goes with it. Rows of a session come in order over
    batches; within one they are sorted.
    """
    use_keyed_state(rows.sparkSession)
    from pyspark.sql import functions as F

    patience_ms = int(rows.sparkSession.sql(f"SELECT CAST(unix_millis(timestamp'1970-01-01 00:00:00' + INTERVAL {patience}) - unix_millis(timestamp'1970-01-01 00:00:00') AS BIGINT)").first()[0])
    timed = rows.withWatermark("event_time", lateness).withColumn("at_ms", F.unix_millis("event_time"))
    return timed.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Spanning(patience_ms), outputStructType=SPANS, outputMode="Append", timeMode="EventTime")


def debounce_stream(passes: DataFrame, debounce: int) -> DataFrame:
    """(session_id, turn) of reminders sent, from a stream of wanted turns (session_id string, turn)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        sent = []
        for turn in sorted(set(pd.concat(list(batches))["turn"].tolist())):
            if last is None or turn - last >= max(1, debounce):
                sent.append(turn)
                last = turn
        if last is not None:
            held.update((last,))
        yield pd.DataFrame({"session_id": [key[0]] * len(sent), "turn": sent})

    return passes.groupBy("session_id").applyInPandasWithState(step, "session_id string, turn long", "last long", "append", GroupStateTimeout.NoTimeout)
