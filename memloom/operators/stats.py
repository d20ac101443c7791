"""Counts, inequality, summaries and evaluation figures (A-02 to A-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(kerns: DataFrame, entities: DataFrame, reasons: DataFrame) -> DataFrame:
    """A-02: one row: partitions, entities, edges, unnamed partitions, entities of the largest partition."""
    k = kerns.agg(F.count("*").alias("n_partitions"), F.sum((F.coalesce("graviton_text", F.lit("")) == "").cast("int")).alias("n_unnamed"))
    per = entities.groupBy("kern_id").agg(F.count("*").alias("n"))
    e = per.agg(F.sum("n").alias("n_entities"), F.max("n").alias("largest_partition"))
    r = reasons.agg(F.count("*").alias("n_reasons"))
    return k.join(F.broadcast(e), F.lit(True)).join(F.broadcast(r), F.lit(True))


def gini(rows: DataFrame, value: str) -> DataFrame:
    """A-03: one row, the Gini coefficient of a column of non-negative whole numbers; 0 if empty or all 0.

    From the histogram of values with a running count, so it sorts distinct values, not rows.
    """
    h = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    upto = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = h.withColumn("last", F.sum("c").over(upto))
    # ranks last-c+1 .. last all have x: the sum of ranks is c * (2*last - c + 1) / 2
    a = t.agg(F.sum("c").alias("n"), F.sum(F.col("x") * F.col("c")).alias("s"),
              F.sum(F.col("x") * F.col("c") * (2 * F.col("last") - F.col("c") + 1) / 2).alias("w"))
    return a.select(F.when(F.coalesce("s", F.lit(0.0)) > 0, 2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"))


def top_thoughts(entities: DataFrame, n: int = 50) -> DataFrame:
    """A-05: the n entities of greatest score, ties by id."""
    return entities.where(F.col("score").isNotNull() & ~F.isnan("score")).orderBy(F.desc("score"), "entity_id").limit(n)


def partition_summary(entities: DataFrame) -> DataFrame:
    """A-06: per partition: entities, active ones, facts, mean score."""
    return entities.groupBy("kern_id").agg(
        F.count("*").alias("n_entities"), F.sum((F.col("status") == "active").cast("int")).alias("n_active"),
        F.sum((F.col("kind") == "fact").cast("int")).alias("n_facts"), F.round(F.avg("score"), 6).alias("mean_score"),
    )


def nearest_rank(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """F-36: (share, value) by the nearest-rank rule, over whole numbers; no row order over all rows is needed.

    Ranks come from running counts of the histogram.
    """
    h = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("c"))
    upto = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = h.withColumn("last", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(1))))
    asked = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    r = t.select("x", "c", "last", "n", asked).withColumn("want", F.greatest(F.ceil(F.col("share") * F.col("n")), F.lit(1)))
    return r.where((F.col("want") <= F.col("last")) & (F.col("want") > F.col("last") - F.col("c"))).select("share", F.col("x").alias("value"))


def eval_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """A-09: one row of means over ``ranks(gold_n, ranks)``: any and all gold items within k, reciprocal rank, NDCG at 10.

    ``ranks`` are the 1-based places of the gold items that were found.
    """
    found = lambda k: F.size(F.filter("ranks", lambda r: r <= k))
    gain = lambda places: F.aggregate(
        F.transform(places, lambda r: 1.0 / F.log2(r.cast("double") + 1.0)), F.lit(0.0), lambda s, x: s + x)
    ideal = F.sequence(F.lit(1), F.greatest(F.least(F.col("gold_n"), F.lit(10)), F.lit(1)))
    cols = []
    for k in ks:
        cols.append(F.round(F.avg((found(k) > 0).cast("double")), 6).alias(f"recall_any_{k}"))
        cols.append(F.round(F.avg((found(k) >= F.col("gold_n")).cast("double")), 6).alias(f"recall_all_{k}"))
    cols.append(F.round(F.avg(F.coalesce(1.0 / F.array_min("ranks"), F.lit(0.0))), 6).alias("mrr"))
    cols.append(F.round(F.avg(gain(F.filter("ranks", lambda r: r <= 10)) / gain(ideal)), 6).alias("ndcg_10"))
    return ranks.where(F.col("gold_n") > 0).agg(*cols)
