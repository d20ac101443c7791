"""Change feed replay against a sequential fold, and its defined cases."""

import random
import struct

from memloom.operators import changefeed as cf

SCHEMA = ("arrival_seq bigint, arrived_at timestamp, object_id string, target int, replica string, value bigint, lamport bigint, producer string, op string, "
          "lww_value binary, lww_double double, lww_ts timestamp, seq int, v string, commit_seq int")


def row(seq, obj, lamport, producer, op, value=b"\0" * 8, target=2):
    return (seq, None, obj, target, "", 0, lamport, producer, op, value, None, None, 9, "clash", 9)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(df):
    return {(r.object_id, r.target): (r.lamport, r.producer) for r in df.collect()}


def fold(rows):
    best = {}
    for r in rows:
        seq, _, obj, target, _, _, lamport, producer, op, value = r[:10]
        name = (op or "").strip().lower()
        if target not in (2, 3) or lamport is None or name not in ("insert", "update", "delete"):
            continue
        good = value is not None and (len(value) == 8 if target == 2 else value == b"\0" or len(value) in (7, 11) and value[:1] == b"\1")
        if name != "delete" and not good:
            continue
        key = (lamport, (producer is not None, (producer or "").encode()))
        if (obj, target) not in best or best[obj, target][0] < key:
            best[obj, target] = (key, name, lamport, producer)
    return {k: v[2:] for k, v in best.items() if v[1] != "delete"}


def test_against_fold(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        obj = "hot" if rng.random() < 0.35 else f"o{rng.randrange(60)}"
        target = rng.choice([0, 1, 2, 2, 2, 3, 3])
        value = rng.choice([struct.pack("<d", rng.random()), b"\0", b"\1" * 7, b"\1" * 11, b"\2" * 7, b"", None, b"xx"])
        lamport = rng.choice([None, *range(1, 400)])
        # one change per (object, target, lamport, producer)
        producer = f"p{i % 7}" + ("É" if i % 3 else "")
        rows.append(row(i + 1, obj, lamport, f"{producer}-{i}", rng.choice(["insert", " Update", "DELETE ", "delete", "odd", None]), value, target))
    rows += rng.sample(rows, 200)  # repeats
    rng.shuffle(rows)
    assert state(cf.replay(frame(spark, rows), closed=True)) == fold(rows)


def test_watermark_holds_gaps(spark):
    rows = [row(s, f"o{s}", s, "p", "insert") for s in (1, 2, 3, 5, 6)]
    mark = cf.committed_watermark(frame(spark, rows)).first()
    assert (mark.first_seq, mark.last_seq, mark.distinct_seqs, mark.watermark) == (1, 6, 5, 3)
    assert set(state(cf.replay(frame(spark, rows)))) == {("o1", 2), ("o2", 2), ("o3", 2)}
    assert len(state(cf.replay(frame(spark, rows), closed=True))) == 5


def test_transaction_is_whole(spark):
    # one producer's lamport 7 touches two objects; its second change is beyond the gap, so neither shows
    rows = [row(1, "a", 7, "p", "insert"), row(2, "b", 3, "p", "insert"), row(4, "c", 7, "p", "insert")]
    assert set(state(cf.replay(frame(spark, rows)))) == {("b", 2)}


def test_delete_and_ties(spark):
    rows = [row(1, "a", 5, "b", "insert"), row(2, "a", 5, "a", "insert"), row(3, "b", 1, "p", "insert"), row(4, "b", 2, "p", " DELETE\t", None), row(5, "c", 5, None, "insert"), row(6, "c", 5, "", "update")]
    assert state(cf.replay(frame(spark, rows), closed=True)) == {("a", 2): (5, "b"), ("c", 2): (5, "")}


def test_empty(spark):
    assert cf.replay(frame(spark, [])).count() == 0
    mark = cf.committed_watermark(frame(spark, [])).first()
    assert mark.watermark is None and mark.distinct_seqs == 0


def test_apply_batch_any_order(spark):
    rows = [row(1, "a", 1, "p", "insert"), row(2, "a", 3, "p", "delete"), row(3, "a", 2, "p", "update"), row(4, "b", 1, "p", "insert")]
    log = cf.apply_batch(cf.register_changes(frame(spark, [])), frame(spark, rows[1:]))
    log = cf.apply_batch(log, frame(spark, rows[:1]))
    assert {(r.object_id, r.lamport, r.is_delete) for r in log.collect()} == {("a", 3, True), ("b", 1, False)}


def test_null_numbers_and_gaps_at_the_end(spark):
    """A change without a number is held with its whole transaction until the feed ends."""
    rows = [row(1, "a", 1, "p", "insert"), row(None, "b", 2, "p", "insert"), row(2, "c", 2, "p", "insert"), row(4, "d", 3, "p", "insert")]
    assert set(state(cf.replay(frame(spark, rows)))) == {("a", 2)}
    assert state(cf.replay(frame(spark, rows), closed=True)) == fold(rows)
    gapless = rows[:3]
    assert set(state(cf.replay(frame(spark, gapless)))) == {("a", 2)} and state(cf.replay(frame(spark, gapless), closed=True)) == fold(gapless)


def test_watermark_over_words(spark):
    for first, last, missing, mark in ((5, 400, (), 400), (64, 127, (), 127), (0, 63, (), 63), (3, 300, (128,), 127), (3, 300, (127,), 126), (-70, 10, (-1,), -2), (0, 191, (63, 64), 62), (1, 63, (), 63)):
        rows = [row(s, "o", 1, "p", "insert") for s in range(first, last + 1) if s not in missing]
        got = cf.committed_watermark(frame(spark, rows)).first()
        assert (got.first_seq, got.last_seq, got.distinct_seqs, got.watermark) == (first, last, len(rows), mark)


def test_stream_of_transactions_equals_batch(spark, tmp_path):
    """Multi-change transactions over gaps, in batches out of order: the stream exposes what the batch form exposes."""
    from memloom.sources.store import Store
    from memloom.streaming import jobs

    rng = random.Random(11)
    rows = [row(s + 1, f"o{rng.randrange(40)}", (s + rng.randrange(30)) // 6, f"p{rng.randrange(3)}", rng.choice(["insert", "update", "delete"]), struct.pack("<d", s)) for s in range(420)]
    missing = rows.pop(300)
    late = rows[40:60]
    batches = [rows[:40] + rows[60:150], rows[150:260] + rows[:30], late, rows[260:]]
    store, seen, before = Store(spark, f"file://{tmp_path}/s"), [], {}
    for i, b in enumerate(batches):
        jobs.step(store, "feed", frame(spark, b), f"b{i}")
        jobs.step(store, "feed", frame(spark, b), f"b{i}")  # replayed: nothing changes
        seen += b
        now = state(store.read("feed_registers").where("not is_delete"))
        assert now == state(cf.replay(frame(spark, seen))), i
        before = now
    jobs.step(store, "feed", frame(spark, [missing]), "b9")
    assert state(store.read("feed_registers").where("not is_delete")) == state(cf.replay(frame(spark, seen + [missing])))
    jobs.end_feed(store)
    assert state(store.read("feed_registers").where("not is_delete")) == fold(seen + [missing]) and store.read("feed_held").count() == 0 and before
