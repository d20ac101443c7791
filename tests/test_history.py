"""Attribute history against a plain sequential computation, over word, slot and key borders."""

import datetime as dt
import random

from memloom.operators import history

SCHEMA = ("job_id bigint, received_at timestamp, text string, source struct<scheme: string, object_id: string, section: string>, kind string, confidence double, "
          "valid_until timestamp, valid_from timestamp, slot int, vhash string, bits bigint")
T0 = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)


def us(t):
    return (t - T0) // dt.timedelta(microseconds=1) + int(T0.timestamp()) * 1_000_000


def frame(spark, jobs):
    return spark.createDataFrame([(j["id"], None, j["text"], ("s", j["obj"], j["sec"]), j["kind"], j["conf"], j["until"], j["from"], 1, "clash", 1) for j in jobs], SCHEMA)


def plain(jobs):
    best = {}
    for j in jobs:
        if None in (j["obj"], j["sec"], j["from"]) or j["until"] is not None and j["until"] <= j["from"]:
            continue
        k = (j["obj"], j["sec"], j["from"])
        if k not in best or best[k]["id"] < j["id"]:
            best[k] = j
    out, keys = set(), {}
    for j in best.values():
        keys.setdefault((j["obj"], j["sec"]), []).append(j)
    for (obj, sec), rows in keys.items():
        rows.sort(key=lambda j: j["from"])
        runs = []
        for j, nxt in zip(rows, [*rows[1:], None]):
            ends = [x for x in (j["until"], nxt and nxt["from"]) if x is not None]
            end = min(ends) if ends else None
            value = (" ".join(j["text"].split()) if j["text"] is not None else None, j["kind"], j["conf"])
            if runs and runs[-1][1] == j["from"] and runs[-1][2] == value:
                runs[-1][1] = end
            else:
                runs.append([j["from"], end, value])
        out |= {(obj, sec, us(a), us(b) if b else None) for a, b, _ in runs}
    return out


def found(df):
    return {(r.object_id, r.section, r.from_us, r.to_us) for r in df.collect()}


def test_against_plain(spark):
    rng = random.Random(3)
    jobs = []
    for i in range(1800):
        obj = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "", None])
        start = rng.choice([None, T0 + dt.timedelta(minutes=rng.randrange(6000) * 10)])
        until = start and rng.choice([None, None, start + dt.timedelta(minutes=rng.choice([-10, 0, 10, 30, 2000]))])
        jobs.append({"id": i, "obj": obj, "sec": rng.choice(["s", "t", None, "s"]), "text": rng.choice(["x", " x ", "x  y", "x\t y", None]), "kind": rng.choice(["k", None]),
                     "conf": rng.choice([0.5, None]), "from": start, "until": until})
    jobs += rng.sample(jobs, 100)
    assert found(history.attribute_history(frame(spark, jobs))) == plain(jobs)


def test_one_version_over_many_words_and_days(spark):
    jobs = [{"id": i, "obj": "o", "sec": "s", "text": "same", "kind": None, "conf": None, "from": T0 + dt.timedelta(minutes=5 * i), "until": None} for i in range(1000)]
    assert found(history.attribute_history(frame(spark, jobs))) == {("o", "s", us(T0), None)}


def test_gap_splits_equal_values(spark):
    h = dt.timedelta(hours=1)
    jobs = [{"id": i, "obj": "o", "sec": "s", "text": "x", "kind": "k", "conf": 1.0, "from": T0 + i * 30 * h, "until": T0 + i * 30 * h + h} for i in range(3)]
    assert len(found(history.attribute_history(frame(spark, jobs)))) == 3


def test_empty(spark):
    assert history.attribute_history(frame(spark, [])).count() == 0


def test_bits_do_the_merging(spark):
    """Of equal touching statements, bitmaps merge all but one in 32; order merges only what words cut."""
    jobs = [{"id": i, "obj": "o", "sec": "s", "text": "ab"[i // 700], "kind": None, "conf": None, "from": T0 + dt.timedelta(hours=5 * i), "until": None} for i in range(1400)]
    runs = history.runs(history.snapshots(history.statements(frame(spark, jobs))))
    assert runs.count() == 1400 // 32 + 1 + 1 and history.attribute_history(frame(spark, jobs)).count() == 2


def test_runs_over_blocks_of_words(spark):
    """More than a block of 64 words of one value, then others at every border."""
    n = history.WORD * history.BLOCK
    text = lambda i: "same" if i < 2 * n + 5 else str(i // history.WORD)
    jobs = [{"id": i, "obj": "o", "sec": "s", "text": text(i), "kind": None, "conf": None, "from": T0 + dt.timedelta(minutes=i), "until": None} for i in range(2 * n + 200)]
    assert found(history.attribute_history(frame(spark, jobs))) == plain(jobs)
