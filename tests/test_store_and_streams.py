"""The versioned store, intake, streaming jobs, configuration and the engine."""

import datetime as dt
import json
import time

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from memloom import config
from memloom.api import MemoryEngine
from memloom.operators import changefeed, crdt
from memloom.sources import intake
from memloom.sources.store import Locked, StaleEpoch, Store
from memloom.streaming import feed, jobs


def frame(spark, rows, schema="entity_id string, kern_id string, n int"):
    return spark.createDataFrame(rows, schema)


def test_versions(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    assert s.epoch == 0 and not s.exists("t")
    s.commit({"t": frame(spark, [("a", "k", 1)])}, expected=0)
    old = s.read("t")
    s.replace("t", frame(spark, [("b", "k", 2)]))
    assert [r.entity_id for r in old.collect()] == ["a"] and [r.entity_id for r in s.read("t").collect()] == ["b"]
    with pytest.raises(StaleEpoch):
        s.replace("t", old, expected=1)
    s.append("t", frame(spark, [("c", "j", 3)]), batch_id="b1")
    s.append("t", frame(spark, [("c", "j", 3)]), batch_id="b1")
    assert s.read("t").count() == 2
    s.upsert_partition("t", frame(spark, [("d", "k", 4)]), "k")
    assert {r.entity_id for r in s.read("t").collect()} == {"c", "d"} and s.partition("t", "j").count() == 1
    before = s.epoch
    s.compact("t")
    assert s.epoch == before + 1 and s.vacuum() > 0 and s.read("t").count() == 2
    assert s.stamp("m", 3) == "adopted" and s.stamp("m", 3) == "match" and s.stamp("n", 3) == "mismatch"


def test_flush_retries(spark, tmp_path):
    s, tries = Store(spark, f"file://{tmp_path}/s"), []

    def build(old):
        tries.append(1)
        if len(tries) == 1:
            s.replace("other", frame(spark, [("x", "k", 1)]))
        return frame(spark, [("a", "k", 1)])

    s.flush("t", build)
    assert len(tries) == 2 and s.exists("other") and s.exists("t")


def test_lock(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.lock("me")
    with pytest.raises(Locked):
        s.lock("you")
    s.lock("you", stale_s=-1)
    s.unlock()
    s.lock("third")


def test_cold_and_compress(spark, tmp_path):
    s, t = Store(spark, f"file://{tmp_path}/s"), dt.datetime(2026, 1, 1)
    schema = "entity_id string, vector array<float>, spilled_at timestamp"
    s.spill(spark.createDataFrame([("a", [1.0, 0.5], t)], schema))
    s.spill(spark.createDataFrame([("a", [0.0, 1.0], t + dt.timedelta(1)), ("b", None, t)], schema))
    assert {r.entity_id: r.vector for r in s.cold().collect()} == {"a": [0.0, 1.0], "b": None}
    s.compress("cold_entities")
    assert "vector" not in s.read("cold_entities").columns and s.read("cold_entities").where("vector_int8 is not null").count() == 2


def test_feed_pages(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [(f"e{i}", "fact", "superseded" if i % 2 else "active", t + dt.timedelta(i // 2), t + dt.timedelta(9) if i % 2 else None) for i in range(7)]
    e = spark.createDataFrame(rows, "entity_id string, kind string, status string, created_at timestamp, invalidated_at timestamp")
    got, cursor = [], None
    while True:
        page, cursor = feed.poll(e, feed.Cursor.decode(cursor) if cursor else None, 3)
        if not page:
            break
        got += [(r.us, r.entity_id, r.change_ord) for r in page]
    assert got == sorted(got) and len(got) == len(set(got)) == 10
    assert feed.poll(e, feed.Cursor.decode(cursor))[1] == cursor
    with pytest.raises(ValueError):
        feed.Cursor.decode("nonsense")


def test_intake(spark, tmp_path):
    (tmp_path / "a.txt").write_text("user: hi\n\nassistant: ok")
    (tmp_path / "b.md").write_text("# note")
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe\x00\x01")
    (tmp_path / "d.md").write_text("")
    got = {r.path.rsplit("/", 1)[1]: r.way for r in intake.read_intake(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "distil", "b.md": "document", "c.bin": "failed"}
    assert intake.archive_empty(tmp_path) == 1
    intake.archive(tmp_path / "b.md", tmp_path)
    intake.fail(tmp_path / "c.bin", tmp_path, "not text")
    assert intake.folder_report(tmp_path) == {"pending": 1, "stuck": 0, "done": 2, "failed": 1} and (tmp_path / "errors" / "c.bin.txt").read_text() == "not text"
    assert intake.prune(tmp_path, now=time.time() + 8 * 86_400) == 2


def test_ignore_rules(spark):
    rows = [("file:///w/.git/x",), ("file:///w/a.tmp",), ("file:///w/src/a.py",), ("file:///secret/a",), ("file:///w/build/o.py",), (None,)]
    df = spark.createDataFrame(rows, "uri string").withColumn("i", intake.ignored(F.col("uri"), ["*.tmp", "build/"], ["/secret"]))
    assert [r.i for r in df.collect()] == [True, True, False, True, True, False]


def test_direct_jobs_stream(spark, tmp_path):
    for text in ("one", "two", "one"):
        intake.submit_direct(tmp_path, {"text": text})
    assert len(list((tmp_path / "direct").glob("*.json"))) == 2
    (tmp_path / "direct" / "again.json").write_text(json.dumps({"text": "one", "kind": "fact"}))
    store = Store(spark, f"file://{tmp_path}/s")
    q = jobs.drain(jobs.direct_jobs_stream(spark, str(tmp_path / "direct")), store, "jobs", str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r.text for r in store.read("jobs").collect()) == ["one", "two"]


def test_delta_stream_equals_batch(spark, tmp_path):
    deltas = spark.read.parquet(f"{DATA}/pending_deltas.parquet")
    deltas.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(deltas.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = Store(spark, f"file://{tmp_path}/s")
    jobs.merge_deltas(stream, store, str(tmp_path / "cp")).awaitTermination(180)
    state = {(r.object_id, r.target, r.lamport, r.producer) for r in store.read("register_log").where("not is_delete").collect()}
    assert state == {(r.object_id, r.target, r.lamport, r.producer) for r in changefeed.replay(deltas, closed=True).collect()}


def memory(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streaming_cooldown_and_seen(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    log = spark.createDataFrame([("e", t + dt.timedelta(seconds=s)) for s in (0, 30, 60, 100, 121)] + [("f", t)], "entity_id string, ts timestamp")
    log.write.parquet(str(tmp_path / "log"))
    stream = lambda: spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    got = memory(spark, jobs.access_commits(stream().withWatermark("ts", "1 minute")), "accepted")
    assert sorted(r.entity_id for r in got) == ["e", "e", "e", "f"]
    assert len(memory(spark, jobs.seen_frames(stream(), ["entity_id"]), "seen")) == 2
    rates = memory(spark, jobs.frame_rates(stream().withColumnRenamed("entity_id", "peer")), "rates", "update")
    assert sum(r.n for r in rates) == 6


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("[retrieval]\nseed_k = 7\n[ingest.review]\nagent = 'pending'\n")
    c = config.load(p, tmp_path / "absent.toml")
    assert c["retrieval"]["seed_k"] == 7 and c["retrieval"]["deliver"] == 40 and c["ingest"]["review"] == {"agent": "pending"}
    assert config.load(p, preset="tight")["retrieval"]["seed_k"] == 10
    p.write_text("[ingest]\ndedup_threshold = 1.5\n")
    with pytest.raises(ValueError):
        config.load(p)
    with pytest.raises(ValueError):
        config.load(preset="odd")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = MemoryEngine(spark, f"file://{tmp_path_factory.mktemp('engine')}/s")
    ent = spark.read.parquet(f"{DATA}/entities.parquet").where("status = 'active'").drop("vector", "gnn_vector").withColumn("gnn_vector", F.lit(None).cast("array<float>"))
    from memloom.sources import embedding

    ent = embedding.embedded(ent, "text").drop("embed_failed")
    e.load(ent, spark.read.parquet(f"{DATA}/reasons.parquet"), spark.read.parquet(f"{DATA}/kerns.parquet"))
    return e


def test_engine_recalls_itself(engine):
    row = engine.entities.where("text is not null and kind = 'claim' and kern_id not like 'remote-%' and valid_until is null").orderBy("entity_id").first()
    assert engine.search(row.text, 1).first().entity_id == row.entity_id
    got = engine.query(row.text, 5, now="2026-03-01 00:00:00").collect()
    assert row.entity_id in {r.entity_id for r in got}


def test_engine_ingest_dedups(spark, engine):
    schema = "job_id bigint, text string, kind string, received_at timestamp, confidence double, source_tag string, valid_from timestamp, valid_until timestamp, user_id string, agent_id string, session_id string"
    job = [(1, "A wholly new remark about heliotropes and tungsten.", "claim", dt.datetime(2026, 1, 1), 0.9, "user", None, None, None, None, None)]
    before = engine.entities.count()
    assert engine.ingest(spark.createDataFrame(job, schema), "2026-03-01 00:00:00") == {"inserted": 1, "merged": 0}
    assert engine.ingest(spark.createDataFrame(job, schema), "2026-03-01 00:00:00") == {"inserted": 0, "merged": 1}
    assert engine.entities.count() == before + 1
    hit = engine.search("heliotropes and tungsten", 1).first().entity_id
    assert engine.forget([hit]) == {"removed": 1, "kept": 0} and engine.entities.count() == before


def test_engine_tools(spark, engine):
    ids = [r.entity_id for r in engine.entities.orderBy("entity_id").limit(3).collect()]
    assert engine.get([ids[0], "nope"]).where("found").count() == 1 and engine.resolve([ids[0][:14]]).first().entity_id == ids[0]
    n = engine.reasons.count()
    engine.link(ids[0], ids[1], "by hand")
    assert engine.reasons.count() == n + 1
    engine.degrade([ids[0]])
    engine.move(ids[2], "root")
    assert engine.entities.where(F.col("entity_id") == ids[2]).first().kern_id == "root"
    engine.promote(ids)
    engine.graviton_add("storms", "wind and rain\nthunder and rain")
    assert engine.gravitons().where("graviton_text = 'storms'").count() == 1
    engine.graviton_remove("storms")
    assert engine.gravitons().where("graviton_text = 'storms'").count() == 0
    engine.claim_kind_add("decision", ["fact"])
    assert engine.health().first().n_entities == engine.entities.count() and engine.pulse().count() > 0 and engine.list_partitions().count() > 0 and engine.top(3).count() == 3
    engine.commit_access(spark.createDataFrame([(ids[0], 2)], "entity_id string, n bigint"), "2026-03-01 00:00:00")
    engine.commit_access(spark.createDataFrame([(ids[0], 1)], "entity_id string, n bigint"), "2026-03-01 00:00:00")
    assert engine.accesses().first().access_count == 3
    rows, cursor = engine.events(limit=5)
    assert len(rows) == 5 and engine.events(cursor, 5)[0][0] != rows[0]
    assert engine.history(ids).columns == ["head", "entity_id", "depth"]
    assert engine.resource(f"thought/{ids[0]}").first().entity_id == ids[0] and engine.resource("local/health").count() == 1
    with pytest.raises(ValueError):
        engine.resource("local/nothing")
    empty = engine.unnamed().where("n_entities > 0").orderBy("kern_id").first()
    engine.promote_unnamed(empty.kern_id, "found")
    assert engine.gravitons().where("graviton_text = 'found'").count() == 1
    done = engine.tick("2025-01-01 00:00:00")
    assert done["pulsed"] > 0 and done["spilled"] == 0
    gone = engine.gc("2026-12-01 00:00:00")
    assert gone == engine.store.cold().count()


def test_absorb(spark, engine, tmp_path):
    other = MemoryEngine(spark, f"file://{tmp_path}/s")
    e = crdt.entity_join(spark.read.parquet(f"{DATA}/entities.parquet"))
    other.load(e, spark.read.parquet(f"{DATA}/reasons.parquet").limit(5), spark.read.parquet(f"{DATA}/kerns.parquet"))
    engine.absorb(other)
    assert engine.entities.count() >= e.count()
    with pytest.raises(ValueError):
        other.absorb(other)


def test_steps_of_a_scope_are_deleted(spark):
    from pathlib import Path

    from memloom.session import scratch, shared_dir, written

    folder = Path(shared_dir(spark).removeprefix("file://"))
    with scratch(spark):
        with scratch(spark):
            df = written(spark.range(5), "scoped")
        assert df.count() == 5 and list(folder.glob("memloom-scoped-*"))
    assert not list(folder.glob("memloom-scoped-*"))
