"""History of changing attributes: every version of each attribute with the period in which it held.

Presence bitmaps. The statements of a key are its snapshots, numbered in order of ``valid_from``; between two snapshots lies the
span from the first to the second. For every (key, value hash) bit ``2i`` is set where snapshot i states the value, and bit
``2i + 1`` where it held through the whole span to snapshot i + 1. Runs of consecutive bits are validity intervals: a gap
leaves its span's bit unset, another value has its own bitmap.

A key may hold a third of all rows, so no step takes a whole key into one task: snapshots are numbered by prefix sums of
the counts of calendar slots, of which a key has at most as many as the calendar, and by rank within a slot; bitmaps are
words of 32 snapshots. Only runs that touch a border of their word are joined by order, within blocks of 64 words and
then across blocks: of n statements at most n / 16, and n / 1024 in the last step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.session import written

#: Width of a calendar slot in microseconds (one day), snapshots in a bitmap word of 64 bits, words in a block.
SLOT_US, WORD, BLOCK = 86_400_000_000, 32, 64
_KEY = ["object_id", "section"]
_BLANKS = r"(?U)[\s\x1c-\x1f]+"


def folded(text: Column) -> Column:
    """``text`` without outer blanks and with inner runs of white space as one blank; null stays null."""
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def value_hash(*cols: Column) -> Column:
    """A 128-bit hash of the columns in which null differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in cols]
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.unhex(F.md5(F.concat(*sized)))


def statements(jobs: DataFrame) -> DataFrame:
    """The deciding statement of each (object_id, section, valid_from) in ``direct_jobs``, with ``slot``.

    Rows without object_id, section or valid_from, or whose valid_until isn't after valid_from, are passed over; of the
    rest the highest job_id counts (a null job_id counts least), repeated arrivals of it being one.
    """
    us = lambda c: F.unix_micros(F.col(c))
    rows = jobs.select(
        F.col("source.object_id").alias("object_id"), F.col("source.section").alias("section"), "job_id",
        us("valid_from").alias("from_us"), us("valid_until").alias("until_us"),
        value_hash(folded(F.col("text")), F.col("kind"), F.col("confidence")).alias("vhash"),
    ).where(
        F.col("object_id").isNotNull() & F.col("section").isNotNull() & F.col("from_us").isNotNull()
        & (F.col("until_us").isNull() | (F.col("until_us") > F.col("from_us")))
    ).withColumn("slot", F.floor(F.col("from_us") / SLOT_US))
    best = rows.groupBy("object_id", "section", "slot", "from_us").agg(
        F.max(F.struct("job_id", "until_us", "vhash")).alias("b")
    )
    return best.select("object_id", "section", "slot", "from_us", "b.job_id", "b.until_us", "b.vhash")


def snapshots(stated: DataFrame) -> DataFrame:
    """Number each key's statements (``snap``, from 0) and give each its end ``to_us``: the earlier of its own bound and the next
    statement's start, null if neither; ``holds`` says whether it held until the next statement."""
    slots = stated.groupBy(*_KEY, "slot").agg(F.count("*").alias("n"), F.min("from_us").alias("first_us"))
    by_slot = Window.partitionBy(*_KEY).orderBy("slot")
    slots = slots.select(*_KEY, "slot", (F.sum("n").over(by_slot) - F.col("n")).alias("before"), F.lead("first_us").over(by_slot).alias("later_us"))
    order = Window.partitionBy(*_KEY, "slot").orderBy("from_us")
    nxt = F.coalesce(F.lead("from_us").over(order), F.col("later_us"))
    at = stated.join(slots, [*_KEY, "slot"]).withColumn("next_us", nxt).withColumn("snap", F.col("before") + F.row_number().over(order) - 1)
    return at.select(*_KEY, "snap", "from_us", "job_id", "vhash", F.least("until_us", "next_us").alias("to_us"),
                     F.coalesce(F.col("until_us").isNull() | (F.col("until_us") >= F.col("next_us")), F.lit(False)).alias("holds"))


def runs(snaps: DataFrame) -> DataFrame:
    """Runs of set bits in the presence bitmaps of ``snaps``: object_id, section, word, vhash, from_us, to_us, job_id (of the last
    statement), ``low`` and ``high``, whether the run touches the lower or the upper border of its word."""
    at = snaps.withColumn("word", F.floor(F.col("snap") / WORD)).withColumn("bit", (F.col("snap") % WORD * 2).cast("int"))
    # at most 32 snapshots in a word, hence in a group
    maps = at.groupBy(*_KEY, "word", "vhash").agg(
        F.bit_or(F.expr("shiftleft(if(holds, 3L, 1L), bit)")).alias("bits"),
        F.array_sort(F.collect_list(F.struct("bit", "from_us", "to_us", "job_id"))).alias("seen"),
    ).withColumn("opens", F.expr("bits & ~shiftleft(bits, 1)")).withColumn("closes", F.expr("bits & ~shiftrightunsigned(bits, 1)"))
    # a run opens at a snapshot's bit, and closes at that bit or at the bit of the span behind it
    ends = maps.select(
        *_KEY, "word", "vhash",
        F.expr("filter(seen, x -> (shiftrightunsigned(opens, x.bit) & 1L) = 1L)").alias("o"),
        F.expr("transform(filter(seen, x -> (shiftrightunsigned(closes, x.bit) & 3L) <> 0L), x -> struct(x.to_us, x.job_id, (x.bit = 62 and closes < 0) as high))").alias("c"),
    )
    return ends.select(*_KEY, "word", "vhash", F.explode(F.arrays_zip("o", "c")).alias("r")).select(
        *_KEY, "word", "vhash", F.col("r.o.from_us").alias("from_us"), F.col("r.c.to_us").alias("to_us"), F.col("r.c.job_id").alias("job_id"),
        (F.col("r.o.bit") == 0).alias("low"), F.col("r.c.high").alias("high"),
    )


def _joined(rims: DataFrame, by: list[str]) -> DataFrame:
    """Join runs at borders, within ``by``: one that ends high goes on in one of the same value that begins low in the next word."""
    order = Window.partitionBy(*by).orderBy("from_us")
    on = F.col("low") & F.lag("high").over(order) & (F.lag("vhash").over(order) == F.col("vhash")) & (F.lag("last").over(order) + 1 == F.col("word"))
    isle = F.sum(F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    keep = [c for c in [*_KEY, "block"] if c not in by]
    return rims.withColumn("isle", isle).groupBy(*by, "isle").agg(
        *[F.first(c).alias(c) for c in keep], F.min(F.struct("from_us", "vhash", "word", "low")).alias("o"), F.max(F.struct("from_us", "to_us", "job_id", "last", "high")).alias("c"),
    ).select(*_KEY, "block", F.col("o.vhash").alias("vhash"), F.col("o.from_us").alias("from_us"), F.col("o.word").alias("word"), F.col("o.low").alias("low"),
             F.col("c.to_us").alias("to_us"), F.col("c.job_id").alias("job_id"), F.col("c.last").alias("last"), F.col("c.high").alias("high"))


def attribute_history(jobs: DataFrame) -> DataFrame:
    """Versions of each (object_id, section) of ``direct_jobs``: from_us, to_us (null if open), vhash, job_id.

    ``job_id`` is the last statement of the version; join on it for the text. Touching periods with equal text, kind and
    confidence (nulls equal) are one version. Extra columns are dropped; an empty table gives no rows. The table is read
    once: the deciding statements, without their texts, and then the runs are written to the shared folder.
    """
    found = written(runs(snapshots(written(statements(jobs), "statements"))), "runs")
    cols = [*_KEY, "from_us", "to_us", "vhash", "job_id"]
    rims = found.where("low or high").withColumn("block", F.floor(F.col("word") / BLOCK)).withColumn("last", F.col("word"))
    blocks = _joined(rims, [*_KEY, "block"])
    # of a block only runs that touch its borders can go on in another
    edge = (F.col("low") & (F.col("word") % BLOCK == 0)) | (F.col("high") & (F.col("last") % BLOCK == BLOCK - 1))
    marked = blocks.withColumn("edge", edge)
    across = _joined(marked.where("edge"), _KEY)
    return found.where("not (low or high)").select(cols).unionByName(marked.where("not edge").select(cols)).unionByName(across.select(cols))
