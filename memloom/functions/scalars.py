"""Scalar functions over ids, confidence, time, heat, routing and rank evidence, as Column builders.

All stay inside the JVM. Fixed values that results depend on stand together in ``Fixed``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Fixed:
    """Fixed values of the data model."""

    CONF_FLOOR, CONF_DEFAULT, CONF_AGENT_CAP = 0.01, 0.5, 0.95
    CORE_STEEPNESS, ACCEPT_MIN, MASS_MIN = 8.0, 0.5, 1e-6
    QBST_CAP, QBST_COUNT, QBST_RECENT, QBST_TAU_S = 0.1, 0.02, 0.05, 86_400.0
    FACT_BONUS, LCB_Z, REMOTE_TRUST, GRAVITY = 0.3, 1.0, 0.4, 0.15
    TRAVERSAL_CAP, TRAVERSAL_WEIGHT = 0.1, 0.01
    GC_HEAT, GC_AGE_S = 0.01, 7 * 86_400
    DEGRADE_STEP, DEGRADE_RATIO, DEGRADE_DROP = 0.15, 0.75, 0.05
    LINK_USER, LINK_AGENT, PROVENANCE, REPHRASE, CLAIM_CONF = 1.0, 0.95, 0.85, 0.5, 0.6
    SIMILARITY, PROVENANCE_KIND, QUESTION, SPAWN, SUPERSEDES, RATIFICATION, REPHRASE_KIND = range(7)
    ENTITY_KINDS = ("fact", "claim", "document", "question", "conclusion")
    SCHEMES = ("file", "ticket", "session", "agent", "inline")


def lit_ts(text: str) -> Column:
    """A timestamp literal in UTC."""
    return F.to_timestamp(F.lit(text))


def seconds(ts: Column) -> Column:
    """Seconds since 1970, with microseconds."""
    return F.unix_micros(ts) / 1e6


def content_hash(text: Column) -> Column:
    """F-01: SHA-256 hex of the UTF-8 text; null for null."""
    return F.sha2(text, 256)


def joined_hash(*parts: Column) -> Column:
    """SHA-256 hex of parts separated by NUL, null parts empty."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def source_id(source: Column) -> Column:
    """Hash of scheme, object and section; null if the object is null or empty."""
    obj = source["object_id"]
    return F.when(F.length(obj) > 0, joined_hash(source["scheme"], obj, source["section"]))


def reason_id(from_id: Column, to_id: Column, kind: Column, text: Column, to_net: Column) -> Column:
    """Content id of an edge."""
    return joined_hash(from_id, to_id, kind, text, to_net)


def chunk_source_id(source: Column, index: Column) -> Column:
    """F-22."""
    return F.concat(source, F.lit("#chunk"), index.cast("string"))


def clamp_confidence(conf: Column, principal: Column) -> Column:
    """F-06: (confidence, kind) struct. Null or not positive gives the default; others than the user are capped."""
    given = F.when(conf.isNull() | (conf <= 0), F.lit(Fixed.CONF_DEFAULT)).otherwise(conf)
    cap = F.when(principal == "user", F.lit(1.0)).otherwise(F.lit(Fixed.CONF_AGENT_CAP))
    value = F.least(F.greatest(given, F.lit(Fixed.CONF_FLOOR)), cap)
    return F.struct(value.alias("confidence"), F.when(value >= 1.0, "fact").otherwise("claim").alias("kind"))


def conf_mean(alpha: Column, beta: Column) -> Column:
    """Mean of the beta distribution; one half where alpha + beta isn't positive."""
    a, b = alpha.cast("double"), beta.cast("double")
    return F.when(a + b <= 0, F.lit(0.5)).otherwise(a / (a + b))


def conf_variance(alpha: Column, beta: Column) -> Column:
    a, b = alpha.cast("double"), beta.cast("double")
    n = a + b
    return F.when(n <= 0, F.lit(0.0)).otherwise(a * b / (n * n * (n + 1)))


def conf_lcb(alpha: Column, beta: Column, z: float = Fixed.LCB_Z) -> Column:
    """Mean less z standard deviations, at least 0."""
    return F.greatest(F.lit(0.0), conf_mean(alpha, beta) - F.lit(z) * F.sqrt(conf_variance(alpha, beta)))


def observe(alpha: Column, beta: Column, weight: Column, supports: Column) -> Column:
    """X-07: (alpha, beta) after an observation of weight within [0, 1]."""
    w = F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0))
    return F.struct(
        (alpha + F.when(supports, w).otherwise(0.0)).alias("alpha"), (beta + F.when(supports, F.lit(0.0)).otherwise(w)).alias("beta")
    )


def acceptance_probability(distance: Column, inner: Column, outer: Column) -> Column:
    """F-23: 1 within the inner radius, 0 from the outer on, a falling logistic between."""
    x = (distance - inner) / (outer - inner)
    return F.when(distance <= inner, F.lit(1.0)).when(distance >= outer, F.lit(0.0)).otherwise(
        1.0 / (1.0 + F.exp(F.lit(Fixed.CORE_STEEPNESS) * (x - 0.5)))
    )


def effective_distance(distance: Column, mass: Column) -> Column:
    """F-24."""
    return distance / F.greatest(mass, F.lit(Fixed.MASS_MIN))


def qbst(accesses: Column, age_seconds: Column) -> Column:
    """F-25: bonus of frequent and recent access, capped."""
    recent = F.when(age_seconds.isNull(), F.lit(0.0)).otherwise(
        Fixed.QBST_RECENT * F.exp(-F.greatest(age_seconds, F.lit(0.0)) / Fixed.QBST_TAU_S)
    )
    return F.least(F.lit(Fixed.QBST_CAP), F.log(F.coalesce(accesses, F.lit(0)) + 1.0) * Fixed.QBST_COUNT + recent)


def decayed(value: Column, since: Column, now: Column, half_life_s: Column) -> Column:
    """F-26: exponential decay by half-life; not positive gives 0; null or future ``since`` leaves the value."""
    v = value.cast("double")
    dt = seconds(now) - seconds(since)
    return F.when(v <= 0, F.lit(0.0)).when(since.isNull() | (dt <= 0), v).otherwise(
        v * F.pow(F.lit(2.0), -dt / F.greatest(half_life_s.cast("double"), F.lit(1.0)))
    )


def deposit(value: Column, since: Column, now: Column, half_life_s: Column, amount: Column) -> Column:
    """F-26: decayed heat plus an amount."""
    return decayed(value, since, now, half_life_s) + amount


def resolve_valid_until(a: Column, b: Column) -> Column:
    """F-27: the earlier bound, null being no bound."""
    return F.least(a, b)


def valid_until_from_retention(now: Column, retention_s: Column) -> Column:
    """F-28: null for a retention of 0 or null, else now plus it."""
    return F.when(retention_s > 0, F.timestamp_micros(F.unix_micros(now) + retention_s.cast("long") * 1_000_000))


def review_for(policy: dict[str, str], scheme: Column) -> Column:
    """F-29: the review state of a scheme, active by default."""
    out = F.lit("active")
    for name, state in sorted(policy.items()):
        out = F.when(scheme == name, F.lit(state)).otherwise(out)
    return out


def dedup_threshold_for(kind: Column, overrides: dict[str, float], default: float) -> Column:
    """F-30."""
    out = F.lit(float(default))
    for name, value in sorted(overrides.items()):
        out = F.when(kind == name, F.lit(float(value))).otherwise(out)
    return out


def edge_evidence(cosine: Column, score: Column, traversals: Column, w_reason: float, w_edge: float) -> Column:
    """F-31: evidence an edge gives for a query."""
    used = F.least(F.lit(Fixed.TRAVERSAL_CAP), F.log(traversals + 1.0) * Fixed.TRAVERSAL_WEIGHT)
    strength = F.least(F.lit(1.0), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) + used)
    return w_reason * cosine + w_edge * strength


def is_cold_victim(kern_id: Column, status: Column, kind: Column, heat_now: Column, accessed: Column, created: Column, now: Column) -> Column:
    """F-33: cold enough to spill. Local active facts and documents never are; a future stamp never is."""
    immune = ~is_remote(kern_id) & (status == "active") & kind.isin("fact", "document")
    age = seconds(now) - seconds(F.coalesce(accessed, created))
    return F.coalesce(~immune & (heat_now < Fixed.GC_HEAT) & (age > Fixed.GC_AGE_S), F.lit(False))


def is_remote(kern_id: Column) -> Column:
    return F.coalesce(kern_id.startswith("remote-"), F.lit(False))


def id_matches_body(entity_id: Column, text: Column) -> Column:
    """F-34: an id of 64 hex digits must be the hash of the text; other ids pass."""
    return ~entity_id.rlike("^[0-9a-f]{64}$") | F.coalesce(entity_id == content_hash(text), F.lit(False))


def ring_distance(a: Column, b: Column) -> Column:
    """F-35: distance on a ring of circumference 1."""
    d = F.abs(a - b)
    return F.least(d, 1.0 - d)


def loc_of(hex_id: Column) -> Column:
    """F-35: place on the ring: the first 8 bytes, little-endian, shifted right by 11, over 2^53."""
    # the top 53 bits of the reversed bytes: 13 hex digits and one bit
    swapped = F.concat(*[F.substring(hex_id, 15 - 2 * i, 2) for i in range(8)])
    high = F.conv(F.substring(swapped, 1, 13), 16, 10).cast("double") * 2.0
    low = F.floor(F.conv(F.substring(swapped, 14, 1), 16, 10).cast("double") / 8.0)
    return (high + low) / float(1 << 53)
