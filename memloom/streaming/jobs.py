"""Structured Streaming jobs: intake, direct jobs, delta merge, access commit, seen sets and rates (S-04 to S-06, C-07, C-11, R-22)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from memloom.functions import scalars as sc
from memloom.operators import changefeed
from memloom.session import scratch
from memloom.sources import intake
from memloom.sources.store import Store

#: Parts of a log after which it is rewritten as one.
COMPACT_PARTS = 16
#: Key of a register and what tells its deciding change.
REGISTER_KEY = (["object_id", "target"], ["lamport", "producer", "is_delete", "lww_value", "lww_double", "lww_ts"])
JOB_SCHEMA = (
    "text string, source struct<scheme: string, object_id: string, section: string, title: string, author: string, url: string, system: string>, kind string, "
    "hint string, confidence double, valid_until timestamp, valid_from timestamp, source_tag string, user_id string, agent_id string, session_id string"
)


def intake_stream(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """S-04, W-10: whole files of a folder as they appear, with the way each is handled; admission is the rate limit."""
    raw = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*").load(folder)
    return intake.classified(raw)


def direct_jobs_stream(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """S-06: JSON jobs, one per file, named by content; repeated contents are dropped by their hash."""
    raw = spark.readStream.schema(JOB_SCHEMA).option("maxFilesPerTrigger", max_files).option("mode", "PERMISSIVE").json(folder)
    return raw.where("text is not null").withColumn("doc_id", sc.content_hash(F.col("text"))).dropDuplicates(["doc_id"])


def drain(stream: DataFrame, store: Store, name: str, checkpoint: str, poll_seconds: int | None = None) -> StreamingQuery:
    """S-05: append a stream to a table; all there is and stop, or every ``poll_seconds``."""
    writer = stream.writeStream.foreachBatch(lambda batch, epoch: store.append(name, batch, batch_id=f"{name}-{epoch}")).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{poll_seconds} seconds") if poll_seconds else writer.trigger(availableNow=True)).start()


def merge_deltas(stream: DataFrame, store: Store, checkpoint: str, name: str = "register_log") -> StreamingQuery:
    """C-07, C-18: fold a stream of deltas into the kept register log; late and repeated deltas are harmless, so no watermark.

    A batch appends its deciding changes only; the table has a key, so reading folds the parts, and every COMPACT_PARTS parts
    the log is rewritten as one.
    """
    def fold(batch: DataFrame, epoch: int) -> None:
        new = changefeed.deciding(changefeed.register_changes(batch))
        full = store.parts(name) + 1 >= COMPACT_PARTS
        if full:
            new = changefeed.deciding(store.read(name).unionByName(new))
        store.commit({name: new}, batch_id=f"{name}-{epoch}", append=not full, keys={name: REGISTER_KEY})

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_deltas(stream: DataFrame, store: Store, checkpoint: str, name: str = "feed") -> StreamingQuery:
    """Commit-ordered replay of a stream: ``NAME_registers`` shows only transactions at or below the contiguous watermark.

    A batch commits, at once, what it exposes as a further part of the registers, the held changes and the numbers that
    arrived; a batch that is replayed after a failure changes nothing. :func:`end_feed` releases what is held.
    """
    return stream.writeStream.foreachBatch(lambda batch, epoch: step(store, name, batch, f"{name}-{epoch}")).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def end_feed(store: Store, name: str = "feed") -> int:
    """The feed has ended: held transactions are released."""
    return step(store, name, None, f"{name}-end")


def step(store: Store, name: str, batch: DataFrame | None, batch_id: str) -> int:
    with scratch(store.spark):
        return _stepped(store, name, batch, batch_id)


def _stepped(store: Store, name: str, batch: DataFrame | None, batch_id: str) -> int:
    names = {k: f"{name}_{k}" for k in ("arrived", "held", "registers")}
    state = {k: store.read(n) for k, n in names.items() if store.exists(n)}
    new, _ = changefeed.advance(state, batch if batch is not None else changefeed.no_deltas(store.spark), closed=batch is None)
    full = store.parts(names["registers"]) + 1 >= COMPACT_PARTS
    if full:
        new["registers"] = changefeed.deciding(store.read(names["registers"]).unionByName(new["registers"]))
    return store.commit({names[k]: df for k, df in new.items()}, batch_id=batch_id, append=() if full else (names["registers"],),
                        keys={names["registers"]: REGISTER_KEY})


def access_commits(stream: DataFrame, cooldown_s: int = 60) -> DataFrame:
    """R-22, T-01: accesses (entity_id, ts) that count under a cooldown, with one stamp of state per entity.

    State ends a day after an entity's last access by event time; call ``withWatermark`` on the stream first.
    """
    step = cooldown_s * 1_000_000

    def scan(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        stamps = sorted({int(t) for b in batches for t in b["ts_us"]})
        keep = []
        for t in stamps:
            if last is None or t - last >= step:
                keep.append(t)
                last = t
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + 86_400_000)
        yield pd.DataFrame({"entity_id": [key[0]] * len(keep), "ts_us": keep})

    rows = stream.withColumn("ts_us", F.unix_micros("ts"))
    return rows.groupBy("entity_id").applyInPandasWithState(scan, "entity_id string, ts_us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def seen_frames(stream: DataFrame, key: list[str], ttl: str = "60 seconds") -> DataFrame:
    """C-11: frames not seen before within the time to live."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(key)


def frame_rates(stream: DataFrame, window: str = "60 seconds", late: str = "60 seconds") -> DataFrame:
    """C-11: frames of each peer per fixed window."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "peer").agg(F.count("*").alias("n")).select(
        "peer", F.col("window.start").alias("window_start"), "n")
