"""Laws of the merges: order, repetition and grouping don't matter."""

import datetime as dt
import random

from pyspark.sql import functions as F

from memloom.operators import crdt

T = dt.datetime(2026, 1, 1)
SCHEMA = ("entity_id string, kern_id string, kind string, review string, text string, conf_alpha float, conf_beta float, score double, status string, superseded_by string, "
          "created_at timestamp, updated_at timestamp, accessed_at timestamp, heat float, valid_until timestamp, valid_until_lamport bigint, valid_until_producer string, producer_id string")


def entity(i, rng):
    return (f"e{i}", "k", "fact", "active", f"t{i}", 1.0, 1.0, 0.5, rng.choice(["active", "superseded"]), rng.choice([None, "x", "y"]), T + dt.timedelta(rng.randrange(9)),
            T + dt.timedelta(rng.randrange(9)), rng.choice([None, T + dt.timedelta(rng.randrange(9))]), float(rng.randrange(5)), T + dt.timedelta(rng.randrange(90)), rng.randrange(4),
            rng.choice(["p", "q"]) + str(i) + str(rng.randrange(100)), "n")


def rows(df):
    return sorted(map(str, df.collect()))


def test_entity_join_laws(spark):
    rng = random.Random(1)
    copies = [entity(i % 10, rng) for i in range(60)]
    a, b = spark.createDataFrame(copies[:35], SCHEMA), spark.createDataFrame(copies[35:], SCHEMA)
    ab, ba = crdt.absorb(a, b), crdt.absorb(b, a)
    assert rows(ab) == rows(ba) == rows(crdt.absorb(ab, ab)) == rows(crdt.absorb(crdt.entity_join(a), crdt.entity_join(b)))


def test_counters(spark):
    schema = "object_id string, target int, replica string, value bigint"
    slots = crdt.counter_slots(spark.createDataFrame([("o", 0, "r1", 4), ("o", 0, "r2", 7), ("o", 0, "r1", 6), ("o", 0, None, 9), ("o", 0, "", 9), ("o", 0, "r3", 2_000_000), ("o", 0, "r4", 0), ("o", 1, "r1", 5)], schema))
    assert {(r.replica, r.value) for r in slots.collect()} == {("r1", 6), ("r2", 7)}
    assert crdt.counter_values(slots).first().total == 13
    assert rows(crdt.merge_slots(slots, slots)) == rows(slots)


def test_lww(spark):
    r = spark.createDataFrame([("k", 5, "r1", "a"), ("k", 5, "r2", "b"), ("k", 4, "z", "c")], "k string, lamport bigint, producer string, v string")
    assert crdt.lww(r, ["k"], ["v"]).first().v == "b"


def test_remote_insert(spark):
    rng = random.Random(2)
    local = spark.createDataFrame([entity(0, rng)], SCHEMA)
    other = spark.createDataFrame([entity(i, rng) for i in range(6)], SCHEMA).withColumn("kern_id", F.lit("remote-x"))
    got = crdt.remote_insert(local, other, cap=3).collect()
    assert len(got) == 3 and all(r.heat == 0 and r.accessed_at is None and r.score == 0.5 for r in got) and "e0" not in {r.entity_id for r in got}


def test_contract_diff(spark):
    mine = spark.createDataFrame([("a1", 1), ("a2", 2), ("b1", 5), ("c1", 1)], "entity_id string, lamport bigint")
    theirs = spark.createDataFrame([("a1", 1), ("a2", 1), ("c1", 1), ("d1", 9)], "entity_id string, lamport bigint")
    assert {(r.entity_id, r.lamport) for r in crdt.contract_diff(mine, theirs).collect()} == {("a2", 2), ("b1", 5)}
    assert crdt.contract_diff(mine, mine).count() == 0
    assert crdt.within_cap(mine, theirs, 5).first().fits and not crdt.within_cap(mine, theirs, 4).first().fits


def test_forced_ttl(spark):
    r = spark.createDataFrame([(None,), (T,)], "valid_until timestamp")
    got = sorted(x.valid_until for x in crdt.forced_ttl(r, F.lit(T), 3600).collect())
    assert got == [T, T + dt.timedelta(hours=1)]
