"""Replaying a change feed of inserts, updates and deletes into current state.

Commit-ordered transactional replay, in four distributed steps:

1. *Assemble transactions.* A change is one (key, lamport, producer); its repeats collapse to its first arrival. The changes
   one producer stamps with one lamport form a transaction, which commits at the last sequence number any of them has.
2. *Hold sequence gaps.* The contiguous committed watermark is the last sequence number before the first missing one.
   Transactions that commit beyond it, or hold a change without a number, are held.
3. *Parallelise nonconflicting keys.* Keys never interact, so the exposed changes are reduced per key with a
   mergeable aggregate: a key holding a third of the feed is combined map-side and reaches no single task whole.
4. *Expose.* The greatest (lamport, producer), producers by bytes, decides; a deciding delete removes the key.

A feed that has ended releases what it holds: no number can come any more. The streaming form (:func:`advance`) takes the same
steps batch by batch and keeps what is held, what has arrived, and the deciding change of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.session import small, written

SCORE, DEADLINE = 2, 3


def clean_op(op: Column) -> Column:
    """The operation in lower case without surrounding white space; null for anything unknown."""
    name = F.lower(F.regexp_replace(op, r"(?U)^\s+|\s+$", ""))
    return F.when(name.isin("insert", "update", "delete"), name)


def decodable(target: Column, value: Column) -> Column:
    """Whether ``lww_value`` can be decoded for its target; false for null."""
    n = F.octet_length(value)
    first = F.hex(F.substring(value, 1, 1))
    score = (target == SCORE) & (n == 8)
    deadline = (target == DEADLINE) & (((n == 1) & (first == "00")) | (n.isin(7, 11) & (first == "01")))
    return F.coalesce(score | deadline, F.lit(False))


def register_changes(deltas: DataFrame) -> DataFrame:
    """The rows of ``pending_deltas`` that are changes of a last-writer-wins register.

    Null lamports, unknown or null operations, and inserts or updates whose value can't be decoded are no changes;
    a delete needs no value. Columns not named here are dropped, so extra or clashing ones do no harm.
    """
    op = clean_op(F.col("op"))
    return deltas.where(F.col("target").isin(SCORE, DEADLINE) & F.col("lamport").isNotNull()).where(
        (op == "delete") | (op.isin("insert", "update") & decodable(F.col("target"), F.col("lww_value")))
    ).select(
        "arrival_seq", "object_id", "target", "lamport", "producer",
        (op == "delete").alias("is_delete"), "lww_value", "lww_double", "lww_ts",
    )


def arrivals(feed: DataFrame, seq: str = "arrival_seq") -> DataFrame:
    """Bitmaps of the sequence numbers that arrived: word (64 numbers), mask, lo and hi. Repeats and order don't matter; nulls are
    passed over.

    Combined map-side: what is shuffled is about a row per 64 numbers of a partition.
    """
    at = feed.where(F.col(seq).isNotNull()).select(F.col(seq).cast("long").alias("s"))
    return at.groupBy(F.floor(F.col("s") / 64).cast("long").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(pmod(s, 64) as int)))").alias("mask"), F.min("s").alias("lo"), F.max("s").alias("hi"))


def contiguous(words: DataFrame) -> DataFrame:
    """One row: ``first_seq``, ``last_seq``, ``distinct_seqs`` and ``watermark`` of the bitmaps of :func:`arrivals`.

    Each word tells how far it is filled from its lowest number on; the first that isn't full, or whose successor is
    missing, holds the watermark. A hash anti-join of words: no sort, no window over the feed.
    """
    span = words.agg(F.min("lo").alias("first_seq"), F.max("hi").alias("last_seq"), F.sum(F.expr("bit_count(mask)")).cast("long").alias("distinct_seqs"))
    # of the first word the numbers below the lowest don't belong to the feed
    at = words.join(F.broadcast(span.select("first_seq")), F.lit(True)).withColumn("mask", F.expr(
        "case when lo = first_seq and pmod(lo, 64) > 0 then mask | shiftrightunsigned(-1L, cast(64 - pmod(lo, 64) as int)) else mask end"))
    ends = at.where("mask = -1").select("word").join(words.select((F.col("word") - 1).alias("word")), "word", "left_anti").select((F.col("word") * 64 + 63).alias("stop"))
    torn = at.where("mask <> -1").select((F.col("word") * 64 + F.expr(
        "case when mask = 9223372036854775807 then 63 else bit_count(mask & ~(mask + 1)) end") - 1).alias("stop"))
    return span.join(F.broadcast(ends.unionByName(torn).agg(F.min("stop").alias("watermark"))), F.lit(True))


def committed_watermark(feed: DataFrame, seq: str = "arrival_seq") -> DataFrame:
    """One row: ``first_seq``, ``last_seq``, ``distinct_seqs`` and ``watermark``, the last number before the first gap.

    Null numbers are passed over; an empty feed gives one row of nulls and a count of 0.
    """
    return contiguous(arrivals(feed, seq)).withColumn("distinct_seqs", F.coalesce("distinct_seqs", F.lit(0).cast("long")))


_CHANGE = ["object_id", "target", "lamport", "producer"]
_VALUE = ["is_delete", "lww_value", "lww_double", "lww_ts"]


def distinct_changes(changes: DataFrame) -> DataFrame:
    """``changes`` as from :func:`register_changes`, a repeat (same key, lamport and producer) once, at its first arrival ``seq``.

    Should repeats disagree, a delete wins over a value and then the greater value bytes, so the result doesn't depend on
    arrival order.
    """
    return changes.groupBy(*_CHANGE).agg(F.min("arrival_seq").alias("seq"), F.max(F.struct(*_VALUE)).alias("v")).select(*_CHANGE, "seq", "v.*")


def split_by_commit(once: DataFrame, watermark: int | None) -> tuple[DataFrame, DataFrame]:
    """Changes of transactions that commit at or below the watermark, and those of held ones.

    ``once`` are distinct changes with ``seq``. A transaction is held if any change of it lies beyond the watermark or has no number.
    """
    late = once.where(F.col("seq").isNull() | (F.col("seq") > F.lit(watermark).cast("long")) | F.lit(watermark is None))
    held = small(written(late.select(F.col("lamport").alias("t_l"), F.col("producer").alias("t_p")).distinct(), "held"))
    on = (F.col("lamport") == F.col("t_l")) & F.col("producer").eqNullSafe(F.col("t_p"))
    return once.join(held, on, "left_anti"), once.join(held, on, "left_semi")


def deciding(changes: DataFrame) -> DataFrame:
    """The deciding change of each (object_id, target), deletes included."""
    last = changes.groupBy("object_id", "target").agg(F.max(F.struct("lamport", "producer", *_VALUE)).alias("d"))
    return last.select("object_id", "target", "d.*")


def replay(deltas: DataFrame, closed: bool = False) -> DataFrame:
    """Current register state of ``pending_deltas``, one row per (object_id, target) that stands.

    Columns: object_id, target, lamport, producer, lww_value, lww_double, lww_ts. With ``closed=False`` only transactions at or
    below the contiguous watermark are exposed; ``closed=True`` says that the feed has ended: numbers still missing are
    given up, and held transactions, those of changes without a number among them, are released. Where the feed has no gap
    nothing is held, and the transactions needn't be told apart. A null producer sorts before every other. Null object ids
    form one key of their own. Empty feed: no rows.
    """
    changes = register_changes(deltas)
    mark = committed_watermark(deltas).first()
    gapless = mark.watermark == mark.last_seq
    if closed and gapless or gapless and changes.where("arrival_seq is null").isEmpty():
        exposed = changes
    else:
        exposed, held = split_by_commit(written(distinct_changes(changes), "changes"), mark.watermark)
        exposed = exposed.unionByName(held) if closed else exposed
    return deciding(exposed).where(~F.col("is_delete")).drop("is_delete")


def no_deltas(spark: SparkSession) -> DataFrame:
    """An empty batch."""
    return spark.createDataFrame([], "arrival_seq long, object_id string, target int, lamport long, producer string, op string, lww_value binary, lww_double double, lww_ts timestamp")


def advance(state: dict[str, DataFrame], feed: DataFrame, closed: bool = False) -> tuple[dict[str, DataFrame], int | None]:
    """One step of the streaming form: the new state, and the watermark through which it is exposed.

    ``state`` has ``arrived`` (bitmaps of numbers from the watermark's word on), ``held`` (distinct changes not exposed yet) and
    ``registers`` (deciding changes of the keys this step touches; fold them over the earlier ones with :func:`deciding`). Batches
    may repeat, overlap and come in any order. ``closed`` releases what is held.
    """
    words = arrivals(feed)
    if "arrived" in state:
        every = words.unionByName(state["arrived"]).groupBy("word").agg(F.bit_or("mask").alias("mask"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        base = state["arrived"].agg(F.min("word").alias("base"))
        # what lies below the words kept was committed: the watermark never falls back
        words = every.join(F.broadcast(base), F.lit(True)).where("base is null or word >= base").drop("base")
    words = written(words, "arrived")
    mark = contiguous(words).first().watermark
    once = register_changes(feed)
    if "held" in state:
        once = once.unionByName(state["held"].withColumnRenamed("seq", "arrival_seq").select(once.columns))
    visible, held = split_by_commit(written(distinct_changes(once), "changes"), mark)
    if closed:
        visible, held = visible.unionByName(held), held.limit(0)
    # words below the watermark's are full and needn't be kept; its own, filled up to there, says where the feed goes on
    kept = words
    if mark is not None:
        own, filled = mark // 64, (1 << (mark % 64 + 1)) - 1
        low = F.lit(filled if filled < 1 << 63 else filled - (1 << 64)).cast("long")
        kept = words.where(F.col("word") >= own).withColumn("mask", F.when(F.col("word") == own, F.col("mask").bitwiseOR(low)).otherwise(F.col("mask"))).withColumn(
            "lo", F.when(F.col("word") == own, F.lit(own * 64).cast("long")).otherwise(F.col("lo")))
    return {"arrived": kept, "held": written(held, "held"), "registers": deciding(visible)}, mark


def apply_batch(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """Fold one batch of deltas into a kept register log and return the new log, at once and whatever its numbers.

    The log keeps the deciding change of each key, deletes included, so that later, older arrivals can't revive a key.
    Columns: object_id, target, lamport, producer, is_delete, lww_value, lww_double, lww_ts.
    """
    cols = [*_CHANGE, *_VALUE]
    return deciding(state.select(cols).unionByName(register_changes(deltas).select(cols)))
