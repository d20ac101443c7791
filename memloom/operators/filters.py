"""One predicate for every filter: P-01 and its parts P-02 to P-13, delivery (P-14), chains (P-15) and selectors."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions.scalars import Fixed
from memloom.operators import walks
from memloom.session import small


def _ts(value: datetime | str) -> Column:
    return F.lit(value).cast("timestamp")


@dataclass(frozen=True)
class QueryOptions:
    """What a query may ask of the entities it returns; None asks nothing."""

    exclude_pending: bool = False
    system: str | None = None
    kind: str | None = None
    scheme: str | None = None
    claim_kinds: tuple[str, ...] = field(default_factory=tuple)
    min_conf: float = 0.0
    since: datetime | str | None = None
    before: datetime | str | None = None
    valid_at: datetime | str | None = None
    as_of: datetime | str | None = None
    user_id: str | None = None
    agent_id: str | None = None
    session_id: str | None = None
    sort: str | None = None
    ascending: bool = False

    def check(self) -> None:
        """Refuse unknown labels, as the tool boundary does."""
        if self.scheme is not None and self.scheme not in Fixed.SCHEMES:
            raise ValueError(f"unknown scheme {self.scheme!r}")
        if self.kind is not None and self.kind not in Fixed.ENTITY_KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")
        if self.sort not in (None, "score", "date", "access", "confidence"):
            raise ValueError(f"unknown sort {self.sort!r}")

    @property
    def is_active(self) -> bool:
        """P-12: whether any predicate is set."""
        return any((
            self.exclude_pending, self.system, self.kind, self.scheme, self.claim_kinds, self.min_conf > 0, self.since,
            self.before, self.valid_at, self.as_of, self.user_id, self.agent_id, self.session_id,
        ))


def valid_at_window(at: Column) -> Column:
    """P-10: within the half-open window [valid_from or created_at, valid_to); a missing bound never excludes."""
    start = F.coalesce(F.col("valid_from"), F.col("created_at"))
    return (start.isNull() | (start <= at)) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))


def predicate(o: QueryOptions) -> Column:
    """P-01: the conjunction of all that ``o`` asks; true where it asks nothing. Nulls never make it null."""
    o.check()
    parts: list[Column] = []
    if o.exclude_pending:
        parts.append(F.col("review") != "pending")
    if o.system is not None:
        parts.append(F.col("source.system") == o.system)
    if o.kind is not None:
        parts.append(F.col("kind") == o.kind)
    if o.scheme is not None:
        parts.append(F.col("source.scheme") == o.scheme)
    if o.claim_kinds:
        label = F.when(F.col("source.title").startswith("session://"), F.substring(F.col("source.title"), 11, 1 << 20)).otherwise("")
        parts.append(label.isin(*o.claim_kinds))
    if o.min_conf > 0:
        parts.append(~(F.col("score") < o.min_conf))
    if o.since is not None:
        parts.append(F.col("created_at").isNull() | (F.col("created_at") >= _ts(o.since)))
    if o.before is not None:
        parts.append(F.col("created_at").isNull() | (F.col("created_at") <= _ts(o.before)))
    if o.valid_at is not None:
        parts.append(F.col("valid_until").isNull() | (F.col("valid_until") >= _ts(o.valid_at)))
    if o.as_of is not None:
        parts.append(valid_at_window(_ts(o.as_of)))
    for name in ("user_id", "agent_id", "session_id"):
        if (value := getattr(o, name)) is not None:
            parts.append(F.col(name) == value)
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def not_expired(o: QueryOptions, now: Column) -> Column:
    """P-13: drop what has expired, unless the query names a time itself."""
    if o.as_of is not None or o.valid_at is not None:
        return F.lit(True)
    return F.col("valid_until").isNull() | (F.col("valid_until") >= now)


def deliverable(hits: DataFrame, floor: float, keep: int, by: str = "query_id") -> DataFrame:
    """P-14: drop superseded hits, keep those at or above the quality floor - all, if none clears it - and the best ``keep``.

    Input columns: ``by``, entity_id, status, score; output adds rank. Groups are the bounded hit lists of queries.
    """
    live = hits.where(F.col("status") != "superseded")
    best = F.max("score").over(Window.partitionBy(by))
    kept = live.withColumn("best", best).where((F.col("score") >= floor) | (F.col("best") < floor)).drop("best")
    order = Window.partitionBy(by).orderBy(F.desc("score"), "entity_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def whole_chains(chains: DataFrame, passing: DataFrame) -> DataFrame:
    """P-15: chains (query_id, chain_no, nodes, score) all of whose known entities are among ``passing(entity_id, ok)``.

    ``nodes`` alternate entity and edge ids. An entity that ``passing`` doesn't know doesn't exclude.
    """
    ends = chains.select("query_id", "chain_no", F.explode(F.filter("nodes", lambda x, i: i % 2 == 0)).alias("entity_id"))
    bad = ends.join(passing.where(~F.col("ok")), "entity_id").select("query_id", "chain_no").distinct()
    return chains.join(bad, ["query_id", "chain_no"], "left_anti")


def dominant_dim(entities: DataFrame) -> DataFrame:
    """A-04, P-16: the commonest vector length among entities that aren't superseded; ties go to the longer. One row."""
    sizes = entities.where((F.col("status") != "superseded") & (F.size("vector") > 0)).groupBy(F.size("vector").alias("dim")).agg(
        F.count("*").alias("n")
    )
    return sizes.agg(F.max_by("dim", F.struct("n", "dim")).alias("dim"), F.max("n").alias("n_vectors"))


def forgotten_by_source(rows: DataFrame, scheme: str, object_id: str) -> Column:
    """P-17: of one scheme and object, across all its sections."""
    return F.coalesce((F.col("source.scheme") == scheme) & (F.col("source.object_id") == object_id), F.lit(False))


def idle(now: Column, timeout_s: int) -> Column:
    """P-18: partitions other than root not touched for ``timeout_s``; never touched isn't idle."""
    age = F.unix_micros(now) - F.unix_micros(F.col("last_access"))
    return F.coalesce((F.col("kern_id") != "root") & (age >= timeout_s * 1_000_000), F.lit(False))


def resolve_ids(wanted: DataFrame, entities: DataFrame, aliases: DataFrame | None = None, cold: DataFrame | None = None,
                prefix_chars: int = 12) -> DataFrame:
    """P-19: (asked, entity_id): the exact id, else its alias, else the least id it is a prefix of, else an exact cold id.

    ``wanted(asked)``; prefixes shorter than ``prefix_chars`` match only exactly. Joins are on whole ids or on the first
    ``prefix_chars`` characters, never on inequality alone.
    """
    w = wanted.select("asked").distinct()
    found = w.join(entities.select(F.col("entity_id").alias("asked")).distinct(), "asked").select("asked", F.col("asked").alias("entity_id"), F.lit(0).alias("way"))
    if aliases is not None:
        found = found.unionByName(w.join(aliases.select(F.col("alias_id").alias("asked"), "entity_id"), "asked").withColumn("way", F.lit(1)))
    head = w.where(F.length("asked") >= prefix_chars).withColumn("head", F.substring("asked", 1, prefix_chars))
    ids = entities.select("entity_id", F.substring("entity_id", 1, prefix_chars).alias("head")).distinct()
    found = found.unionByName(head.join(ids, "head").where(F.col("entity_id").startswith(F.col("asked"))).select(
        "asked", "entity_id", F.lit(2).alias("way")))
    if cold is not None:
        found = found.unionByName(w.join(cold.select(F.col("entity_id").alias("asked")).distinct(), "asked").select(
            "asked", F.col("asked").alias("entity_id"), F.lit(3).alias("way")))
    best = found.groupBy("asked").agg(F.min(F.struct("way", "entity_id")).alias("b"))
    return best.select("asked", "b.entity_id", "b.way")


def closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """P-06: (start, reached, depth) over ``edges(child, parent)``: what lies below each parent, itself included, at its least depth."""
    links = edges.select("child", "parent").where("child is not null and parent is not null").distinct()
    starts = links.select(F.explode(F.array("parent", "child")).alias("head")).distinct().select("head", F.col("head").alias("entity_id"), F.lit(0).alias("depth"))
    below = walks.levels(starts, lambda at: at.join(links, F.col("entity_id") == F.col("parent")).select("head", F.col("child").alias("entity_id")))
    return below.select(F.col("head").alias("start"), F.col("entity_id").alias("reached"), "depth")


def of_kinds(rows: DataFrame, label: str, asked: list[str], registry: DataFrame) -> DataFrame:
    """P-06: rows whose label is one of the asked kinds or a kind below one, over ``registry(child, parent)``."""
    below = closure(rows.sparkSession, registry).where(F.col("start").isin(*asked)).select(F.col("reached").alias(label)).distinct()
    named = rows.sparkSession.createDataFrame([(a,) for a in asked], f"{label} string")
    return rows.join(small(below.unionByName(named).distinct()), label, "left_semi")
