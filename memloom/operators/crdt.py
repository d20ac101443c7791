"""Conflict-free merges of replicated tables (C-01 to C-11, C-14 to C-19), all mergeable aggregates keyed by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import scalars as sc
from memloom.operators import changefeed, ranking

COUNTER_MAX, REMOTE_CAP, HOT_BATCH = 1_000_000, 50_000, 32
ACCESS, TRAVERSAL = 0, 1


def counter_slots(deltas: DataFrame, target: int = ACCESS) -> DataFrame:
    """C-01, C-07: (object_id, replica, value): the greatest possible total of each replica.

    Totals outside 1..1 000 000 and rows without a replica are refused. Idempotent and order-free.
    """
    ok = deltas.where((F.col("target") == target) & F.col("value").between(1, COUNTER_MAX) & (F.length("replica") > 0))
    return ok.groupBy("object_id", "replica").agg(F.max("value").alias("value"))


def counter_values(slots: DataFrame) -> DataFrame:
    """C-01: (object_id, total): the sum of the slots."""
    return slots.groupBy("object_id").agg(F.sum("value").alias("total"))


def merge_slots(a: DataFrame, b: DataFrame) -> DataFrame:
    """C-01: the slot-wise greatest of two counters."""
    return a.select("object_id", "replica", "value").unionByName(b.select("object_id", "replica", "value")).groupBy(
        "object_id", "replica"
    ).agg(F.max("value").alias("value"))


def lww(rows: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """C-02: per key the values of the row with the greatest (lamport, producer)."""
    return rows.groupBy(*key).agg(F.max(F.struct("lamport", "producer", *value)).alias("w")).select(*key, "w.*")


ENTITY_COLUMNS = [
    "kern_id", "external_id", "kind", "review", "text", "vector", "gnn_vector", "conf_alpha", "conf_beta", "score", "valid_from",
    "valid_to", "invalidated_at", "producer_id", "user_id", "agent_id", "session_id",
]


def entity_join(entities: DataFrame, origin: str | None = None) -> DataFrame:
    """C-03: one row per entity_id of any number of copies.

    Superseded is sticky, superseded_by the greatest, created_at the least, updated_at, accessed_at and heat the greatest,
    the deadline last-writer-wins. Confidence, text and whatever else is never merged are one copy's, whole: that of
    the least ``origin`` (a column that ranks sources, the local one first), then the earliest created, then the least by a hash
    of the copy, so the result depends neither on order nor on partitions.
    """
    present = [c for c in ENTITY_COLUMNS if c in entities.columns]
    deadline = F.max(F.struct(
        F.coalesce("valid_until_lamport", F.lit(0)).alias("lamport"), F.coalesce("valid_until_producer", F.lit("")).alias("producer"), "valid_until"
    )).alias("d")
    rank = F.struct(F.col(origin) if origin else F.lit(0), F.coalesce(F.unix_micros("created_at"), F.lit((1 << 63) - 1)), F.xxhash64(*present))
    out = entities.groupBy("entity_id").agg(
        F.min_by(F.struct(*present), rank).alias("one"),
        F.when(F.max(F.when(F.col("status") == "superseded", 1).otherwise(0)) == 1, "superseded").otherwise("active").alias("status"),
        F.max("superseded_by").alias("superseded_by"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
        F.max("accessed_at").alias("accessed_at"), F.max("heat").alias("heat"), deadline,
    )
    return out.select(
        "entity_id", "one.*", "status", "superseded_by", "created_at", "updated_at", "accessed_at", "heat",
        F.col("d.valid_until").alias("valid_until"), F.col("d.lamport").alias("valid_until_lamport"),
        F.when(F.col("d.producer") != "", F.col("d.producer")).alias("valid_until_producer"),
    )


def reason_join(reasons: DataFrame, origin: str | None = None) -> DataFrame:
    """C-06: one row per reason_id, the score last-writer-wins, the rest one copy's, whole, as in :func:`entity_join`."""
    rest = [c for c in reasons.columns if c not in ("reason_id", "score", "score_lamport", "score_producer", origin)]
    w = F.max(F.struct(F.coalesce("score_lamport", F.lit(0)).alias("lamport"), F.coalesce("score_producer", F.lit("")).alias("producer"), "score")).alias("w")
    rank = F.struct(F.col(origin) if origin else F.lit(0), F.xxhash64(*rest))
    return reasons.groupBy("reason_id").agg(F.min_by(F.struct(*rest), rank).alias("one"), w).select(
        "reason_id", "one.*", F.col("w.score").alias("score"), F.col("w.lamport").alias("score_lamport"),
        F.when(F.col("w.producer") != "", F.col("w.producer")).alias("score_producer"),
    )


def remote_insert(local: DataFrame, incoming: DataFrame, cap: int = REMOTE_CAP) -> DataFrame:
    """C-04: incoming entities that may be stored: not owned by another partition, at most ``cap`` per partition with those
    already there, without heat, access and confidence of their own."""
    owned = local.select("entity_id", F.col("kern_id").alias("owner")).distinct()
    ok = incoming.join(owned, "entity_id", "left").where(F.col("owner").isNull() | (F.col("owner") == F.col("kern_id")))
    have = local.groupBy("kern_id").agg(F.countDistinct("entity_id").alias("have"))
    fresh = ok.where("owner is null").join(have, "kern_id", "left")
    room = Window.partitionBy("kern_id").orderBy("entity_id")
    fresh = fresh.withColumn("n", F.row_number().over(room)).where(F.col("n") + F.coalesce("have", F.lit(0)) <= cap)
    cols = [c for c in incoming.columns]
    stripped = {"heat": F.lit(0.0).cast("float"), "accessed_at": F.lit(None).cast("timestamp"), "conf_alpha": F.lit(1.0).cast("float"),
                "conf_beta": F.lit(1.0).cast("float"), "score": F.lit(0.5)}
    both = fresh.select(*cols).unionByName(ok.where("owner is not null").select(*cols))
    return both.select(*[stripped[c].alias(c) if c in stripped else F.col(c) for c in cols])


def absorb(a: DataFrame, b: DataFrame) -> DataFrame:
    """C-05, X-02: the union of two stores' entities; where copies differ in what is never merged, those of ``a`` stay."""
    return entity_join(a.withColumn("_origin", F.lit(0)).unionByName(b.withColumn("_origin", F.lit(1)), allowMissingColumns=True), "_origin")


def absorb_reasons(a: DataFrame, b: DataFrame) -> DataFrame:
    """C-05, C-06: the union of two stores' edges; the texts and ends of ``a`` stay."""
    return reason_join(a.withColumn("_origin", F.lit(0)).unionByName(b.withColumn("_origin", F.lit(1)), allowMissingColumns=True), "_origin")


def absorb_partitions(a: DataFrame, b: DataFrame) -> DataFrame:
    """C-05: partitions of both stores; the local shell wins."""
    return a.unionByName(b.join(a.select("kern_id"), "kern_id", "left_anti"))


def apply_deltas(entities: DataFrame, reasons: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C-07: (access totals, entities with new deadlines, reasons with new scores).

    Counters apply anywhere; registers only in remote partitions, and only if they are newer than what stands there.
    """
    totals = counter_values(counter_slots(deltas))
    state = changefeed.replay(deltas, closed=True)
    ttl = state.where(F.col("target") == changefeed.DEADLINE).select(
        F.col("object_id").alias("entity_id"), F.col("lamport").alias("l"), F.col("producer").alias("p"), F.col("lww_ts").alias("t"))
    newer = lambda have_l, have_p: F.struct(F.col("l"), F.coalesce("p", F.lit(""))) > F.struct(
        F.coalesce(have_l, F.lit(0)).cast("long"), F.coalesce(have_p, F.lit("")))
    e = entities.join(ttl, "entity_id", "left")
    use = F.coalesce(sc.is_remote(F.col("kern_id")) & F.col("l").isNotNull() & newer("valid_until_lamport", "valid_until_producer"), F.lit(False))
    e = e.withColumn("use", use).select(*[
        F.when(F.col("use"), F.col({"valid_until": "t", "valid_until_lamport": "l", "valid_until_producer": "p"}[c])).otherwise(F.col(c)).alias(c)
        if c in ("valid_until", "valid_until_lamport", "valid_until_producer") else F.col(c) for c in entities.columns])
    marks = state.where(F.col("target") == changefeed.SCORE).select(
        F.col("object_id").alias("reason_id"), F.col("lamport").alias("l"), F.col("producer").alias("p"), F.col("lww_double").alias("s"))
    r = reasons.join(marks, "reason_id", "left")
    use = F.coalesce(sc.is_remote(F.col("kern_id")) & F.col("s").isNotNull() & newer("score_lamport", "score_producer"), F.lit(False))
    r = r.withColumn("use", use).select(*[
        F.when(F.col("use"), F.col({"score": "s", "score_lamport": "l", "score_producer": "p"}[c])).otherwise(F.col(c)).alias(c)
        if c in ("score", "score_lamport", "score_producer") else F.col(c) for c in reasons.columns])
    return totals, e, r


def hottest(entities: DataFrame, n: int = HOT_BATCH) -> DataFrame:
    """C-08: the n local entities of greatest heat, ties by id."""
    return entities.where(~sc.is_remote(F.col("kern_id"))).orderBy(F.desc("heat"), "entity_id").limit(n)


def entity_sync(incoming: DataFrame, own_network: str) -> DataFrame:
    """C-09: what a sync may bring: from another network, and with ids that match their bodies."""
    return incoming.where(
        ~F.coalesce(F.col("producer_id") == own_network, F.lit(False)) & F.coalesce(sc.id_matches_body(F.col("entity_id"), F.col("text")), F.lit(False))
    )


def refusal(entity: Column, text: Column, writer: Column, writers: list[str], kind: Column, kinds: list[str]) -> Column:
    """C-10: the first reason to refuse a delta row, in the order id, writer, kind; null if admissible."""
    return F.when(~F.coalesce(sc.id_matches_body(entity, text), F.lit(False)), "forged_id").when(
        F.lit(bool(writers)) & ~F.coalesce(writer.isin(*writers) if writers else F.lit(True), F.lit(False)), "writer_not_admissible"
    ).when(F.lit(bool(kinds)) & ~F.coalesce(kind.isin(*kinds) if kinds else F.lit(True), F.lit(False)), "kind_not_admissible")


def summary(state: DataFrame) -> DataFrame:
    """C-10: (bucket, n, digest) over ``state(entity_id, lamport)``: sixteen buckets by the first hex digit.

    The digest is an order-free combination of entry hashes, so it is a partial aggregate: no bucket is gathered.
    """
    h = F.xxhash64("entity_id", "lamport")
    return state.groupBy(F.substring("entity_id", 1, 1).alias("bucket")).agg(
        F.count("*").alias("n"), F.bit_xor(h).alias("digest"), F.sum(F.shiftrightunsigned(h, 16)).alias("total")
    )


def contract_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """C-10: local entries (entity_id, lamport) the remote lacks or has older, looked for only in buckets that differ."""
    a, b = summary(local), summary(remote)
    theirs = b.select("bucket", F.col("n").alias("n2"), F.col("digest").alias("d2"), F.col("total").alias("t2"))
    differs = a.join(theirs, "bucket", "left").where(
        F.col("n2").isNull() | (F.col("n") != F.col("n2")) | (F.col("digest") != F.col("d2")) | (F.col("total") != F.col("t2"))
    ).select("bucket")
    # at most one bucket per possible first character
    here = local.withColumn("bucket", F.substring("entity_id", 1, 1)).join(F.broadcast(differs), "bucket", "left_semi")
    have = remote.select("entity_id", F.col("lamport").alias("have"))
    return here.join(have, "entity_id", "left").where(F.col("have").isNull() | (F.col("have") < F.col("lamport"))).select("entity_id", "lamport")


def within_cap(state: DataFrame, delta: DataFrame, cap: int) -> DataFrame:
    """C-10: one row: whether the delta's new ids fit the cap."""
    new = delta.select("entity_id").distinct().join(state.select("entity_id"), "entity_id", "left_anti").agg(F.count("*").alias("new_ids"))
    have = state.agg(F.countDistinct("entity_id").alias("have"))
    return new.join(F.broadcast(have), F.lit(True)).withColumn("fits", F.col("have") + F.col("new_ids") <= cap)


def forced_ttl(rows: DataFrame, now: Column, ttl_s: int) -> DataFrame:
    """C-10: deadlines no later than ``ttl_s`` from now."""
    return rows.withColumn("valid_until", sc.resolve_valid_until(F.col("valid_until"), sc.valid_until_from_retention(now, F.lit(ttl_s))))


def over_rate(frames: DataFrame, per_window: int = 30, window: str = "60 seconds") -> DataFrame:
    """C-11: (peer, window_start, n, refused): frames of each peer per fixed window and how many are over the limit."""
    return frames.groupBy("peer", F.window("ts", window).alias("w")).agg(F.count("*").alias("n")).select(
        "peer", F.col("w.start").alias("window_start"), "n", F.greatest(F.col("n") - per_window, F.lit(0)).alias("refused")
    )


def first_seen(frames: DataFrame, key: list[str], ttl_s: int = 60) -> DataFrame:
    """C-11: frames whose key was not seen in the ``ttl_s`` before; each sight, repeated or not, renews nothing.

    A frame counts as new in its own time-to-live slot, so state is one slot; streams use dropDuplicatesWithinWatermark.
    """
    slot = F.floor(F.unix_micros("ts") / (ttl_s * 1_000_000))
    return frames.withColumn("slot", slot).groupBy(*key, "slot").agg(F.min("ts").alias("ts"), F.count("*").alias("n_sights"))


def first_seen_sliding(frames: DataFrame, key: list[str], ttl_s: int = 60) -> DataFrame:
    """C-11: (key, ts_us) of the frames that count as new: the first sight of a key, and each at least ``ttl_s`` after the last that
    counted, wherever slot borders lie. Repeats renew nothing.

    Rows are sorted within partitions and folded as they stream by, so a key seen a third of the time is never gathered.
    """
    named = F.concat_ws("\u0000", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in key])
    new = ranking.accepted_accesses(frames.select(named.alias("entity_id"), "ts"), ttl_s)
    parts = F.split("entity_id", "\u0000")
    return new.select(*[F.when(parts[i] != "\u0001", parts[i]).alias(c) for i, c in enumerate(key)], "ts_us")


def apply_contract(state: DataFrame, delta: DataFrame, now: Column, writers: list[str] | None = None, kinds: list[str] | None = None,
                   cap: int = REMOTE_CAP, ttl_s: int | None = None, owner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """C-10, C-20: (new state, refused rows with ``reason``) after a delta of a contract.

    ``state`` and ``delta`` have entity_id, text, lamport, producer_id, kind, valid_until and retired. Rows are refused for a forged
    id, then the writer, then the kind; a retirement for a writer that isn't the ``owner``. If the new ids don't fit the cap the whole
    delta is refused. Of what is left the greatest (lamport, producer) of an id stands; a retirement stands against
    anything older. Deadlines of what came in are at most ``ttl_s`` from now.
    """
    cols = ["entity_id", "text", "lamport", "producer_id", "kind", "valid_until", "retired"]
    why = F.when(F.coalesce("retired", F.lit(False)) & F.lit(owner is not None) & ~F.col("producer_id").eqNullSafe(F.lit(owner)), "retired_by_another").otherwise(
        refusal(F.col("entity_id"), F.col("text"), F.col("producer_id"), writers or [], F.col("kind"), kinds or []))
    # a retirement has no body to match
    why = F.when(F.coalesce("retired", F.lit(False)) & F.col("text").isNull() & (F.lit(owner is None) | F.col("producer_id").eqNullSafe(F.lit(owner))), F.lit(None).cast("string")).otherwise(why)
    judged = delta.select(*cols, why.alias("reason"))
    fits = within_cap(state.where("not coalesce(retired, false)"), judged.where("reason is null and not coalesce(retired, false)"), cap).select("fits")
    judged = judged.join(F.broadcast(fits), F.lit(True)).withColumn("reason", F.when(F.col("reason").isNull() & ~F.col("fits"), "over_cap").otherwise(F.col("reason")))
    good = judged.where("reason is null").select(cols)
    good = forced_ttl(good, now, ttl_s) if ttl_s else good
    rank = F.struct("lamport", F.coalesce("producer_id", F.lit("")).alias("p"), F.coalesce("retired", F.lit(False)).alias("r"))
    both = state.select(cols).unionByName(good).groupBy("entity_id").agg(F.max_by(F.struct(*cols[1:]), rank).alias("x"))
    return both.select("entity_id", "x.*"), judged.where("reason is not null").select(*cols, "reason")


def fetched(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """C-14: (entity_id, text) of the asked ids that are held, without any whose body doesn't match its id."""
    found = held.select("entity_id", "text").join(wanted.select("entity_id").distinct(), "entity_id", "left_semi")
    return found.where(F.coalesce(sc.id_matches_body(F.col("entity_id"), F.col("text")), F.lit(False)))


def flush_buffer(deltas: DataFrame) -> DataFrame:
    """C-18: the last delta of each (object, target) by arrival."""
    last = deltas.groupBy("object_id", "target").agg(F.max(F.struct("arrival_seq", "replica", "value", "lamport", "producer")).alias("d"))
    return last.select("object_id", "target", "d.*")


def observed_clock(deltas: DataFrame, own: int = 0) -> DataFrame:
    """C-19: one row: the clock after observing every lamport: the greatest plus one."""
    return deltas.agg((F.greatest(F.coalesce(F.max("lamport"), F.lit(0)), F.lit(own)) + 1).alias("clock"))


def announce(kerns: DataFrame, spheres: DataFrame, network: str) -> DataFrame:
    """C-15: partitions with ``spheres(kern_id, graviton_text, graviton_vec, inner_radius, outer_radius, mass)`` of a peer upserted
    as ``remote-<network>-<kern_id>`` under the root."""
    shells = spheres.select(
        F.concat(F.lit(f"remote-{network}-"), F.col("kern_id")).alias("kern_id"), F.lit("root").alias("parent_id"), "graviton_text", "graviton_vec",
        "inner_radius", "outer_radius", "mass", F.lit(None).cast("timestamp").alias("last_access"),
    )
    return kerns.join(shells.select("kern_id"), "kern_id", "left_anti").unionByName(shells)


def remote_pulse(kerns: DataFrame, pulses: DataFrame) -> DataFrame:
    """C-16: pulses of existing remote partitions, strength within [0, 1]."""
    known = kerns.where(sc.is_remote(F.col("kern_id"))).select("kern_id")
    return pulses.join(known, "kern_id", "left_semi").withColumn("strength", F.least(F.greatest("strength", F.lit(0.0)), F.lit(1.0)))
