"""Replaying a session's entries into its state: order decides, so each session is folded on its own.

Spark makes one event of each entry (``entry_events``: estimates, fingerprints, calls); the fold is one small
function of a session's state and an event. The state is a few numbers and some maps, so that the batch
operator can keep it in dictionaries and the streaming one in keyed state of which an event touches a few
entries. A row leaves some numbers, so a session fits a task.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, MutableMapping
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.tokens import CHARS_A_TOKEN, message_estimate
from threadloom.functions.tools import fingerprint
from threadloom.operators import transcript
from threadloom.operators.branches import NATIVE_SOURCE
from threadloom.operators.pruning import PROTECTED
from threadloom.sources.jsonl import as_messages

STATE = (
    "session_id string, turns long, n_messages long, active_blocks array<long>, next_block_id long, tokens_saved double, lifetime_saved double, n_tool_calls long, "
    "last_compress_turn long, last_nudge_turn long, pruned_tool_ids array<string>, blocks array<struct<block_id:long,topic:string,summary:string,active:boolean,start_ts:double,end_ts:double,anchor_ts:double,summary_tokens:double,saved_tokens:double,created_at:double,compress_call_id:string,superseded_block_ids:array<long>>>"
)
#: Fixed value: the tool whose successful results make blocks.
COMPRESS = "compress"


@dataclass
class Numbers:
    """What a session knows besides its maps. ``pass_turn``: turns at the last pass, which is what a call is dated by;
    ``named``: rows that have been looked at for references; ``head``, ``asked``, ``met``, ``waiting``: the
    open exchange, its calls, whether one is answered, and passthrough rows that came before that."""

    turns: int = 0
    n_messages: int = 0
    next_block_id: int = 1
    lifetime_saved: float = 0.0
    n_tool_calls: int = 0
    last_compress_turn: int = -1
    last_nudge_turn: int = -1
    pass_turn: int = 0
    next_ref: int = 1
    named: int = 0
    head: int = -1
    asked: list[str] = field(default_factory=list)
    met: bool = False
    waiting: list[int] = field(default_factory=list)


@dataclass
class Session:
    """rows: place -> [tokens up to here, head of its exchange, whether it takes a reference, time]; refs: number ->
    place, or a negative block id; calls: id -> [name, fingerprint, turn, ranges]; results: id -> [place, failed];
    blocks: id -> lo, hi, active, saved, anchor (a place or -1), named (whether it has a reference), and what it
    is made of; pruned: ids of results that a tombstone stands for, -> [turn]."""

    numbers: Numbers = field(default_factory=Numbers)
    rows: MutableMapping = field(default_factory=dict)
    refs: MutableMapping = field(default_factory=dict)
    calls: MutableMapping = field(default_factory=dict)
    results: MutableMapping = field(default_factory=dict)
    blocks: MutableMapping = field(default_factory=dict)
    pruned: MutableMapping = field(default_factory=dict)


@dataclass(frozen=True)
class Rules:
    cadence: int = 1
    error_turns: int = 4
    dedup: bool = True
    purge: bool = True


def asked_ranges(arguments: str | None) -> list[dict[str, Any]]:
    """Ranges of a compress call: start, end, topic, tokens of the summary; what isn't whole is left out."""
    try:
        given = json.loads(arguments or "")
    except ValueError:
        return []
    ranges = given.get("ranges") if isinstance(given, dict) else None
    whole = [r for r in ranges or () if isinstance(r, dict) and all(isinstance(r.get(k), str) for k in ("startId", "endId", "summary"))] if isinstance(ranges, list) else []
    out = []
    for r in whole:
        topic = r["topic"] if isinstance(r.get("topic"), str) else given.get("topic")
        size = len(r["summary"].encode("utf-16-le")) // 2
        out.append({"start": r["startId"], "end": r["endId"], "topic": topic.strip() if isinstance(topic, str) else "", "summary": r["summary"], "tokens": math.floor(size / CHARS_A_TOKEN + 0.5)})
    return out


def _covers(blocks: MutableMapping) -> list[tuple[int, int]]:
    return [(b["lo"], b["hi"]) for b in blocks.values() if b["active"]]


def name_rows(s: Session) -> None:
    """Rows shown for the first time take the next references, in the order in which they are shown: blocks
    stand before their anchor, those without one at the end."""
    n = s.numbers
    fresh = sorted((b["anchor"], i) for i, b in s.blocks.items() if b["active"] and not b["named"])
    shown = [(anchor, 0, -i) for anchor, i in fresh if anchor >= 0] + [(at, 1, at) for at in range(n.named, n.n_messages) if s.rows[at][2]] + [(n.n_messages, 0, -i) for anchor, i in fresh if anchor < 0]
    for _, _, what in sorted(shown, key=lambda x: x[:2]):
        s.refs[n.next_ref] = what
        n.next_ref += 1
        if what < 0:
            s.blocks[-what] = s.blocks[-what] | {"named": True}
    n.named = n.n_messages


def newly_pruned(s: Session, rules: Rules) -> list[str]:
    """Results that a pass now replaces: of a repeated call all but the last shown one, and failed ones that are
    old enough, as far as they lie before the open bucket of turns."""
    n, covered = s.numbers, _covers(s.blocks)
    opened = n.turns if rules.cadence <= 1 else n.turns // rules.cadence * rules.cadence
    shown = sorted((at, i, failed) for i, (at, failed) in s.results.items() if not any(lo <= at <= hi for lo, hi in covered))
    last: dict[str, str] = {}
    for _, i, _ in shown:
        last[s.calls[i][1]] = i
    out = []
    for _, i, failed in shown:
        name, print_, turn, _ = s.calls[i]
        repeated = rules.dedup and last[print_] != i and name not in PROTECTED and turn < opened
        if (repeated or (rules.purge and failed and opened - turn >= rules.error_turns)) and i not in s.pruned:
            out.append(i)
    return out


def context_pass(s: Session, rules: Rules) -> None:
    name_rows(s)
    for i in newly_pruned(s, rules):
        s.pruned[i] = [s.numbers.turns]
    s.numbers.pass_turn = s.numbers.turns


def boundary(s: Session, ref: str, edge: str) -> int | None:
    """The row that a reference stands for: a visible message, or the edge (lo or hi) of an active block, also by
    the reference of the block's own row."""
    found = re.fullmatch(r"([mb])(\d+)", ref.strip().lower())
    if not found:
        return None
    number = int(found[2])
    what = -number if found[1] == "b" else s.refs.get(number)
    if what is None or (found[1] == "b" and number == 0):
        return None
    if what < 0:
        block = s.blocks.get(-what)
        return block[edge] if block and block["active"] else None
    return None if any(lo <= what <= hi for lo, hi in _covers(s.blocks)) else what


def compressed(s: Session, ranges: list[dict[str, Any]], call: str | None = None) -> None:
    """Blocks of one call. A range without topic or known boundaries, from and to one same block, reversed,
    or over part of an active block makes none; exchanges are taken whole; whole blocks are superseded.
    Savings are the rows' tokens less those of the summary."""
    n, made, gone = s.numbers, [], set()
    for r in ranges:
        lo, hi = boundary(s, r["start"], "lo"), boundary(s, r["end"], "hi")
        same = r["start"].strip().lower() == r["end"].strip().lower() and r["start"].strip().lower().startswith("b")
        if not r["topic"] or lo is None or hi is None or lo > hi or same:
            continue
        lo, last = s.rows[lo][1], s.rows[hi][1]
        while hi + 1 < n.n_messages and s.rows[hi + 1][1] == last:
            hi += 1
        live = [(i, b) for i, b in s.blocks.items() if b["active"] and i not in gone] + [(None, b) for b in made]
        met = [(i, b) for i, b in live if b["lo"] <= hi and lo <= b["hi"]]
        if any(b["lo"] < lo or b["hi"] > hi for _, b in met):
            continue
        over = sorted(i for i, _ in met if i is not None)
        gone |= set(over)
        removed, covered = s.rows[hi][0] - (s.rows[lo - 1][0] if lo else 0), _covers(s.blocks)
        anchor = min((at for at in s.refs.values() if at > hi and not any(a <= at <= b for a, b in covered)), default=-1)
        start, end = s.rows[lo][3], s.rows[hi][3]
        made.append({
            "lo": lo, "hi": hi, "active": True, "saved": float(max(0, removed - r["tokens"])), "anchor": anchor, "named": False, "topic": r["topic"], "summary": r["summary"], "tokens": r["tokens"],
            "start": start, "end": end, "at": s.rows[anchor][3] if anchor >= 0 else end + 1, "created": s.rows[n.n_messages - 1][3], "call": call, "over": over,
        })
    for i in gone:
        s.blocks[i] = s.blocks[i] | {"active": False}
    for block in made:
        s.blocks[n.next_block_id] = block
        n.next_block_id += 1
    if made:
        n.last_compress_turn = n.last_nudge_turn = n.turns


def taken_over(s: Session, ids: list[int]) -> None:
    """A compaction takes over blocks: what they saved is realized, the turns of the last block and reminder forgotten."""
    for i in ids:
        b = s.blocks.get(i)
        if b and b["active"]:
            s.blocks[i] = b | {"active": False}
            s.numbers.lifetime_saved += b["saved"]
    if ids:
        s.numbers.last_compress_turn = s.numbers.last_nudge_turn = -1


def placed(s: Session, event: dict[str, Any], at: int) -> tuple[int, bool]:
    """The head of the exchange that a row belongs to, and whether it is a turn; the exchange that is open after it."""
    n, role, calls = s.numbers, event.get("role"), [c["id"] for c in event.get("calls") or ()]
    if role in transcript.RESULT_ROLES and n.head >= 0 and event.get("call") in n.asked:
        if not n.met:
            for row in n.waiting:
                s.rows[row] = [s.rows[row][0], n.head, *s.rows[row][2:]]
            n.met, n.waiting = True, []
        return n.head, False
    if role in transcript.PASSTHROUGH and n.head >= 0:
        if not n.met:
            n.waiting = [*n.waiting, at]
        return (n.head if n.met else at), False
    n.head, n.asked, n.met, n.waiting = (at if role == "assistant" and calls else -1), calls, False, []
    return at, role in transcript.TURN_ROLES


def fold(s: Session, event: dict[str, Any], rules: Rules = Rules()) -> None:
    """One message: role, tokens, the calls it makes, the call that it answers, blocks that it takes over. The
    result of a successful compress call acts on the rows before it, after a pass over them."""
    n, role, call = s.numbers, event.get("role"), event.get("call")
    if role == "assistant":
        for c in event.get("calls") or ():
            if c.get("id") and c["id"] not in s.calls:
                s.calls[c["id"]] = [c.get("name") or "", c.get("print") or "", n.pass_turn, (c.get("arguments") or "") if c.get("name") == COMPRESS else None]
    if role == "toolResult" and call:
        if call not in s.calls:
            s.calls[call] = [event.get("tool") or "", event.get("print") or "", n.pass_turn, None]
        known = s.calls[call]
        if not event.get("is_error") and known[3] is not None:
            context_pass(s, rules)
            compressed(s, asked_ranges(known[3]), call)
    at = n.n_messages
    head, turn = placed(s, event, at)
    s.rows[at] = [(s.rows[at - 1][0] if at else 0) + (event.get("tokens") or 0), head, role in transcript.REF_ROLES, float(event.get("ts") or 0)]
    if role == "toolResult" and call:
        s.results[call] = [at, bool(event.get("is_error"))]
    n.n_messages += 1
    n.turns += turn
    n.n_tool_calls += role == "toolResult"
    taken_over(s, event.get("represented") or [])


def observed(session_id: str, s: Session, rules: Rules = Rules()) -> dict[str, Any]:
    """What a last pass would leave; the state itself stays as it is."""
    n, active = s.numbers, {i: b for i, b in s.blocks.items() if b["active"]}
    block = lambda i, b: {
        "block_id": i, "topic": b["topic"], "summary": b["summary"], "active": b["active"], "start_ts": b["start"], "end_ts": b["end"], "anchor_ts": b["at"], "summary_tokens": float(b["tokens"]), "saved_tokens": b["saved"], "created_at": b["created"],
        "compress_call_id": b["call"], "superseded_block_ids": b["over"],
    }
    return {
        "session_id": session_id, "turns": n.turns, "n_messages": n.n_messages, "active_blocks": sorted(active), "next_block_id": n.next_block_id, "tokens_saved": float(sum(b["saved"] for b in active.values())), "lifetime_saved": float(n.lifetime_saved),
        "n_tool_calls": n.n_tool_calls, "last_compress_turn": n.last_compress_turn, "last_nudge_turn": n.last_nudge_turn, "pruned_tool_ids": sorted([*s.pruned.keys(), *newly_pruned(s, rules)]), "blocks": [block(i, s.blocks[i]) for i in sorted(s.blocks)],
    }


def events_of(pdf: pd.DataFrame) -> Iterator[dict[str, Any]]:
    for e in pdf["event"]:
        yield json.loads(e)


def replay(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """State of each session from (session_id string, pos, event JSON)."""
    given = asdict(rules)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, s, own = pdf.sort_values("pos"), Session(), Rules(**given)
        for event in events_of(pdf):
            fold(s, event, own)
        return pd.DataFrame([observed(pdf["session_id"].iloc[0], s, own)])

    return events.select("session_id", "pos", "event").groupBy("session_id").applyInPandas(one, STATE)


def entry_events(rows: DataFrame) -> DataFrame:
    """(session_id, pos, event JSON) for ``replay`` from the entries of one branch a session
    (``sources.jsonl.entries``), row by row, so from a stream of them, too. Entries that are no messages make
    none."""
    m = as_messages(rows)
    native = (F.col("type") == "compaction") & (F.try_variant_get("v", "$.details.source", "string") == NATIVE_SOURCE)
    calls = F.transform(F.filter("parts", lambda p: p["type"] == "toolCall"), lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), fingerprint(F.coalesce(p["name"], F.lit("")), p["arguments"]).alias("print"), F.when(p["name"] == COMPRESS, p["arguments"]).alias("arguments")))
    event = F.struct(
        "role", message_estimate(F.col("content"), F.col("parts")).alias("tokens"), F.col("message_ts").alias("ts"), F.when(F.col("role") == "assistant", calls).alias("calls"), F.col("tool_call_id").alias("call"), F.col("tool_name").alias("tool"),
        fingerprint(F.coalesce("tool_name", F.lit("")), F.lit(None).cast("string")).alias("print"), "is_error", F.when(native, F.try_variant_get("v", "$.details.representedBlockIds", "array<long>")).alias("represented"),
    )
    return m.select(F.col("session_id").cast("string").alias("session_id"), F.col("pos").cast("long").alias("pos"), F.to_json(event).alias("event"))
