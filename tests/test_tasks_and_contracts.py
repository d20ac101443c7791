"""The task queue, watch events, contracts and sights."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from memloom.operators import crdt
from memloom.sources import intake
from memloom.streaming.tasks import TaskQueue

T = dt.datetime(2026, 1, 1)


def test_queue():
    q, ran = TaskQueue(2), []
    assert q.enqueue("a", lambda: ran.append("a")) and not q.enqueue("a", lambda: None)
    assert q.enqueue("b", lambda: 1 / 0) and not q.enqueue("c", lambda: None) and not q.submit("c", lambda: None, 0.01)
    assert q.run() == {"done": 1, "failed": 1} and ran == ["a"] and q.last_error[0] == "b"
    assert q.submit("c", lambda: ran.append("c")) and q.run(1) == {"done": 1, "failed": 0}
    assert (q.counts["repeated"], q.counts["refused"], q.counts["accepted"]) == (1, 2, 3)


def test_watch_events(spark):
    at = lambda s: T + dt.timedelta(seconds=s)
    rows = [("/w/a.py", "create", None, "old", at(0)), ("/w/a.py", "modify", None, "new", at(1)), ("/w/b.md", "rename", "/w/x.md", "moved", at(2)), ("/w/c.rs", "create", None, "c", at(0)),
            ("/w/c.rs", "delete", None, None, at(3)), ("/w/d.txt", "rename", "/w/e.txt", "d", at(1)), ("/w/e.txt", "create", None, "e again", at(2)), ("/w/.git/x", "create", None, "g", at(1)),
            ("/w/empty", "create", None, "", at(1)), (None, "create", None, "n", at(1)), ("/w/b.md", "modify", None, "moved on", at(4))]
    events = spark.createDataFrame(rows, "path string, event string, old_path string, content string, at timestamp")
    got = {r.source_uri: (r.content, r.replaces, r.language) for r in intake.watch_records(events).collect()}
    assert got == {"file:///w/a.py": ("new", None, "python"), "file:///w/b.md": ("moved on", "file:///w/x.md", got["file:///w/b.md"][2]), "file:///w/d.txt": ("d", None, "text"), "file:///w/e.txt": ("e again", None, "text")}


def entry(text, lamport, writer="w", kind="fact", retired=False, body=True):
    return (hashlib.sha256(text.encode()).hexdigest(), text if body else None, lamport, writer, kind, None, retired)


KIND = "entity_id string, text string, lamport bigint, producer_id string, kind string, valid_until timestamp, retired boolean"


def test_contract(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), KIND)
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    state, refused = crdt.apply_contract(frame(), frame(entry("a", 1), entry("a", 3, "v"), entry("b", 1, kind="claim"), ("f" * 64, "forged", 1, "w", "fact", None, False)), now, kinds=["fact"], ttl_s=60)
    rows = state.collect()
    assert [(r.text, r.lamport, r.valid_until) for r in rows] == [("a", 3, T + dt.timedelta(seconds=60))]
    assert {r.reason for r in refused.collect()} == {"kind_not_admissible", "forged_id"}
    # only the owner retires, and what is older doesn't come back
    state, refused = crdt.apply_contract(state, frame(entry("a", 9, "thief", retired=True, body=False)), now, owner="owner")
    assert refused.first().reason == "retired_by_another" and not state.first().retired
    state, _ = crdt.apply_contract(state, frame(entry("a", 5, "owner", retired=True, body=False)), now, owner="owner")
    state, _ = crdt.apply_contract(state, frame(entry("a", 4)), now, owner="owner")
    assert state.first().retired
    _, refused = crdt.apply_contract(frame(), frame(entry("a", 1), entry("b", 1)), now, cap=1)
    assert {r.reason for r in refused.collect()} == {"over_cap"}


def test_sights_across_a_slot_border(spark):
    rows = [("k", T + dt.timedelta(seconds=s)) for s in (59, 60, 100, 119, 120)]
    got = crdt.first_seen_sliding(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"], 60).collect()
    assert [r.ts_us - int(T.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 for r in sorted(got, key=lambda r: r.ts_us)] == [59_000_000, 119_000_000]
