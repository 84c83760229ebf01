"""Every registered query of the library's own operators against its SQL on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from threadloom import queries_agent as core

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(core.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(str([plain(row[names.index(c)]) for c in columns]) for row in found.fetchall())
    assert sorted(str([plain(v) for v in row]) for row in df.select(*columns).collect()) == want


def js_length(s):
    return len(s.encode("utf-16-le")) // 2


def one_line(s):
    return " ".join(s.split())


def cut(s, most):
    return s if len(s) <= most else s[: most - 1].rstrip() + "…"


def test_excerpt_budget_against_a_plain_fold(spark):
    from threadloom.sources import adapters

    lines = {}
    for r in adapters.messages(spark, SF).orderBy("ordinal").collect():
        lines.setdefault(r.session_id, []).append((r.ordinal, js_length(f"- {r.role}: {cut(one_line(r.content), 420) or '(no text content)'}")))
    want = {}
    for session, own in lines.items():
        kept, chars = [], 0
        for ordinal, n in own:
            if len(kept) < 6 and chars + n <= 900:
                kept.append(ordinal)
                chars += n
        want[session] = (kept, chars, len(own), len(kept), len(own) - len(kept))
    assert {r.session_id: (r.kept, r.chars, r.uncovered, r.rendered, r.truncated) for r in core.QUERIES["excerpt_budget"](spark, SF).collect()} == want
    assert any(w[4] for w in want.values())


def plain_tiers(blocks, budget, render, full=4, compact=8):
    """Tiers of blocks in order of time, demoted one by one while what they render to is too long."""
    n = len(blocks)
    level = [0 if n - i <= full else 1 if n - i <= full + compact else 2 for i in range(n)]
    while budget > 0 and int(js_length(render(blocks, level)) / 4 + 0.5) > budget and min(level) < 3:
        level[level.index(min(level))] += 1
    return level


def plain_summary(texts):
    """``texts`` of a block: full section, compact section, archived line."""

    def render(blocks, level):
        parts = [texts(t)[2] for t, k in zip(blocks, level, strict=True) if k == 2]
        parts = ["<archived-sections>\n" + "\n".join(parts) + "\n</archived-sections>"] if parts else []
        return "\n\n".join(parts + [texts(t)[k] for want in (1, 0) for t, k in zip(blocks, level, strict=True) if k == want])

    return render


def test_summary_demotion_against_a_plain_loop(spark):
    blocks = {}
    out = core.QUERIES["summary_demotion"](spark, SF).collect()
    for r in out:
        blocks.setdefault(r.session_id, []).append((r.created_at or 0, r.block_id, ["x" * r.full_length, "x" * r.compact_length, "x" * r.archived_length], r.tier))
    names = ("full", "compact", "archived", "dropped")
    for own in blocks.values():
        own.sort(key=lambda b: b[:2])
        level = plain_tiers([b[2] for b in own], 1500, plain_summary(lambda t: t))
        assert [b[3] for b in own] == [names[k] for k in level]
    assert len({r.tier for r in out}) >= 3


def test_native_summaries_against_a_plain_loop(spark):
    from threadloom.sources import adapters

    events = adapters.read(spark, SF, "events").collect()
    got = {r.session_id: r.summary for r in core.QUERIES["native_summaries"](spark, SF).collect()}
    assert set(got) == {e.user_id for e in events}
    seen = set()
    for user in got:
        blocks = []
        for e in (e for e in events if e.user_id == user):
            k = e.event_id
            topic = f'a "b"  {e.event_type}'
            summary = " " if k % 11 == 0 else f"Did {e.event_type} 😀. Then {e.props}{' more' * (k % 40)}"
            head, log = f"[Compressed section: {topic}]\n\n\n\n", f"\n\n<activity-log>\nread: f{k}\n</activity-log>" if k % 4 == 0 else ""
            body = (head + (f"<agent-summary>\n{summary.strip()}\n</agent-summary>{log}" if log else summary.strip()) + "\n\n").strip()
            name = topic.replace('"', "&quot;")
            lead = f"Did {e.event_type} 😀." if k % 11 else ""
            texts = [f'<section topic="{name}">\n{body}\n</section>', f'<section topic="{name}" tier="compact">\n{summary.strip() or "(no summary)"}\n</section>', f"- {one_line(topic)}" + (f" — {lead}" if lead else "")]
            blocks.append(((k * 7919 % 10007) if k % 6 else 0, k, texts))
        blocks = [b[2] for b in sorted(blocks, key=lambda b: b[:2])]
        render = plain_summary(lambda t: t)
        level = plain_tiers(blocks, 700, render)
        seen |= set(level)
        parts = []
        if user % 3 == 0:
            residue = ("Notes of the user. " + "x y " * (user * 3)).strip()
            total = int(len(residue) / 4 + 0.5)
            if total > 40:
                head = residue[: int(len(residue) * (40 / total))].rstrip()
                residue = f"{head}\n[truncated ~{total - int(len(head) / 4 + 0.5)} tokens of previous summary]"
            parts.append(residue)
        if text := render(blocks, level):
            parts.append(f'<dcp-summary version="1">\n{text}\n</dcp-summary>')
        reads = {f"f{e.event_id % 5}" for e in events if e.user_id == user and e.event_type == "view"}
        writes = {f"f{e.event_id % 5}" for e in events if e.user_id == user and e.event_type == "purchase"} - {"f0"}
        tags = [f"<{t}>\n" + "\n".join(sorted(f)) + f"\n</{t}>" for t, f in (("read-files", reads - writes), ("modified-files", writes)) if f and user % 2 == 0]
        assert got[user] == "\n\n".join(parts) + ("\n\n" + "\n\n".join(tags) if tags else ""), user
    assert len(seen) >= 2


def test_imports_without_the_optional_subpackage(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/threadloom", tmp_path / "threadloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship_savings' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
