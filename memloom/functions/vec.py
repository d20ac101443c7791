"""Vector functions as Column builders over ``ARRAY<FLOAT>``, in double precision inside the JVM, and a blocked NumPy
scorer for many vectors against a bounded set of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return _sum(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def usable(a: Column) -> Column:
    """A vector of at least one number, all finite, not all zero."""
    return F.coalesce(
        (F.size(a) > 0)
        & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(a, lambda x: x != 0),
        F.lit(False),
    )


def cosine(a: Column, b: Column) -> Column:
    """F-02: cosine over the shorter length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    both = norm(x) * norm(y)
    return F.when(both > 0, dot(x, y) / both).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine(a, b)


def average_vec(a: Column, b: Column) -> Column:
    """F-03: element mean over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: ((x.cast("double") + y.cast("double")) / 2).cast("float"))


def l2_normalize(a: Column) -> Column:
    """F-04: unit vector; the zero vector unchanged."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def quantize_int8(a: Column) -> Column:
    """F-08: struct(scale, q): the greatest magnitude over 127 (1 if that is 0) and the rounded, clamped quotients."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127.0).otherwise(F.lit(1.0))
    q = F.transform(a, lambda x: F.least(F.greatest(F.round(x.cast("double") / scale), F.lit(-127.0)), F.lit(127.0)).cast("tinyint"))
    return F.struct(scale.alias("scale"), q.alias("q"))


def dequantize_int8(code: Column) -> Column:
    """F-08: the numbers of a code."""
    return F.transform(code["q"], lambda x: (x.cast("double") * code["scale"]).cast("float"))


def int8_cosine_distance(a: Column, b: Column) -> Column:
    """F-10: 1 less the cosine of two codes, clamped to [-1, 1]; 1 for a zero code or unequal lengths."""
    prod = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("long") * q.cast("long")), F.lit(0).cast("long"), lambda s, v: s + v
    )
    xx, yy, xy = prod(a["q"], a["q"]), prod(b["q"], b["q"]), prod(a["q"], b["q"])
    cos = xy / F.sqrt(xx.cast("double") * yy.cast("double"))
    ok = (F.size(a["q"]) == F.size(b["q"])) & (xx > 0) & (yy > 0)
    return F.when(ok, 1.0 - F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(1.0))


def binary_code(a: Column) -> Column:
    """F-09: bits packed into longs, 32 each; a bit is set where the number is at least 0."""
    words = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 32).cast("int"))
    return F.transform(words, lambda w: F.aggregate(
        F.transform(F.slice(a, w * 32 + 1, F.lit(32)), lambda x, i: F.when(x >= 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda s, v: s + v,
    ))


def hamming_cosine_distance(a: Column, b: Column, dim: Column) -> Column:
    """F-09: 1 - cos(pi h / d) of two binary codes."""
    h = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return 1.0 - F.cos(F.lit(np.pi) * h / dim)


def cosine_align(a: Column, b: Column) -> Column:
    """F-32: cosine mapped to [0, 1]; one half for unequal lengths."""
    return F.when(F.size(a) == F.size(b), F.least(F.greatest((cosine(a, b) + 1) / 2, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.5))


def mean_pool(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """F-05: per group the normalised mean of its vectors; null for unequal lengths or a zero mean.

    Element sums are partial aggregates: no group is collected.
    """
    flat = rows.where(F.size(vector) > 0).select(*by, F.size(vector).alias("n"), F.posexplode(vector).alias("i", "x"))
    cells = flat.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    whole = cells.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"),
    )
    return whole.select(*by, F.when((F.col("lo") == F.col("hi")) & (F.col("norm") > 0),
                                    F.transform("c", lambda s: s["m"] / F.col("norm"))).alias("pooled"))


def _score(batches: Iterator[pa.RecordBatch], queries: np.ndarray, names: list, k: int, least: float) -> Iterator[pa.RecordBatch]:
    dim = queries.shape[1]
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, dim)
        s = (flat / np.linalg.norm(flat, axis=1, keepdims=True)) @ q.T
        if k and len(s) > k:  # only what may be among the best k of this batch
            border = np.partition(s, len(s) - k, axis=0)[len(s) - k]
            keep = (s >= border - 1e-6) & (s >= least)  # within rounding of the border
        else:
            keep = s >= least
        r, c = np.nonzero(keep)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[j] for j in c.tolist()], pa.string()), batch.column(0).take(pa.array(r)), pa.array(s[r, c])],
            ["query_id", "entity_id", "cosine"],
        )


#: Stands for an undefined cosine in a block of edges.
NO_COSINE = -2000.0


def _ends(va: pa.Array, vb: pa.Array, ka: np.ndarray, kb: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Usable vectors of both ends of edges as rows of matrices, and their midpoints; 0 where one isn't usable."""
    a, b = np.zeros((len(ka), dim)), np.zeros((len(kb), dim))
    a[ka] = np.asarray(va.filter(pa.array(ka)).flatten(), dtype=np.float64).reshape(-1, dim)
    b[kb] = np.asarray(vb.filter(pa.array(kb)).flatten(), dtype=np.float64).reshape(-1, dim)
    mid = ((a + b) / 2).astype(np.float32).astype(np.float64)
    mid[~(ka & kb)] = 0
    return a, b, mid


def _odd_cosine(x: list | None, q: np.ndarray) -> float:
    """F-02 of a vector that isn't usable: over the shorter length."""
    v = np.array([np.nan if e is None else e for e in x or []], dtype=np.float64)
    y = q[: len(v)]
    both = np.linalg.norm(v[: len(q)]) * np.linalg.norm(y)
    return (v[: len(q)] @ y / both if np.isfinite(both) else np.nan) if not both <= 0 else 0.0


def edge_blocks(batches: Iterator[pa.RecordBatch], names: list[str], queries: np.ndarray, w_reason: float, w_edge: float) -> Iterator[pa.RecordBatch]:
    """Edges (e, u, v, score, va, vb, ka, kb), numbered, as a row (query_id, block) for each batch and query, scored as by
    :func:`edge_cosines` and ``scalars.edge_evidence``. A block holds, one after the other, e, u and v as 64-bit integers and the
    evidence, u's cosine and v's cosine in millionths as 32-bit ones (an undefined cosine as NO_COSINE), so that what is
    shuffled is a few rows of numbers."""
    for numbers, scores in _edge_scores(batches, queries, w_reason, w_edge):
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([numbers + x for x in scores], pa.binary())], ["query_id", "block"])


def shared_edge_blocks(batches: Iterator[pa.RecordBatch], queries: np.ndarray, w_reason: float, w_edge: float) -> Iterator[pa.RecordBatch]:
    """As :func:`edge_blocks`, but a row (block, scores) for each batch: the numbers once and the scores of each query."""
    for numbers, scores in _edge_scores(batches, queries, w_reason, w_edge):
        yield pa.RecordBatch.from_arrays([pa.array([numbers], pa.binary()), pa.array([scores], pa.list_(pa.binary()))], ["block", "scores"])


def _edge_scores(batches: Iterator[pa.RecordBatch], queries: np.ndarray, w_reason: float, w_edge: float) -> Iterator[tuple[bytes, list[bytes]]]:
    """The two parts of the blocks of each batch: numbers, and scores of each query."""
    norms, dim = np.linalg.norm(queries, axis=1), queries.shape[1]
    for batch in batches:
        if not batch.num_rows:
            continue
        ka, kb = (np.asarray(batch.column(i).fill_null(False)).astype(bool) for i in (6, 7))
        ends = _ends(batch.column(4), batch.column(5), ka, kb, dim)
        sizes = [np.linalg.norm(x, axis=1) for x in ends]
        odd = [(np.flatnonzero(~k), batch.column(i).filter(pa.array(~k)).to_pylist()) for k, i in ((ka, 4), (kb, 5))]
        score = np.asarray(batch.column(3).cast(pa.float64()).fill_null(0.0))
        strength = np.where(np.isnan(score), 1.0, np.clip(score, 0.0, 1.0))  # a NaN counts as the greatest
        numbers = [np.asarray(batch.column(i)).astype(np.int64).tobytes() for i in (0, 1, 2)]
        scores = []
        for q, size in zip(queries, norms):
            near = [np.divide(x @ q, n * size, out=np.zeros(len(x)), where=n * size > 0) for x, n in zip(ends, sizes)]
            for cos, (at, held) in zip(near, odd):
                cos[at] = [_odd_cosine(x, q) for x in held]
            evidence = w_reason * near[2] + w_edge * strength
            scores.append(b"".join([np.round(np.nan_to_num(x, nan=NO_COSINE) * 1e6).astype(np.int32).tobytes() for x in (evidence, near[0], near[1])]))
        yield b"".join(numbers), scores


def edges_of_blocks(blocks) -> list[np.ndarray]:
    """e, u, v, evidence, u's cosine and v's cosine of the edges in blocks."""
    held = [(np.frombuffer(x, np.int64, 3 * (len(x) // 36)).reshape(3, -1), np.frombuffer(x, np.int32, offset=24 * (len(x) // 36)).reshape(3, -1)) for x in blocks]
    if not held:
        return [np.zeros(0, dtype=t) for t in (np.int64,) * 3 + (np.float64,) * 3]
    numbers = np.concatenate([x for x, _ in held], axis=1)
    scores = np.concatenate([x for _, x in held], axis=1) / 1e6
    scores[scores == NO_COSINE] = np.nan
    return [*numbers, *scores]


def edge_cosines(batches: Iterator[pa.RecordBatch], names: list[str], queries: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Half-edges (query_id, reason_id, u, v, hub, score, va, vb, ka, kb) with the cosine of vb and of the midpoint of va and vb to
    their query, or to every query where query_id is null. ``ka``, ``kb`` say whether a vector is usable: without both the
    midpoint counts 0; an unusable vb counts by F-02, over the shorter length."""
    norms = np.linalg.norm(queries, axis=1)
    place = {n: i for i, n in enumerate(names)}
    for batch in batches:
        n, dim = batch.num_rows, queries.shape[1]
        if not n:
            continue
        ka, kb = (np.asarray(batch.column(i).fill_null(False)).astype(bool) for i in (8, 9))
        a, b, mid = _ends(batch.column(6), batch.column(7), ka, kb, dim)
        asked = batch.column(0).to_pylist()
        if asked[0] is None:
            rows, who = np.repeat(np.arange(n), len(names)), np.tile(np.arange(len(names)), n)
        else:
            rows, who = np.arange(n), np.array([place[x] for x in asked])
        q, size = queries[who], norms[who]

        def cos(x: np.ndarray) -> np.ndarray:
            both = np.linalg.norm(x, axis=1)[rows] * size
            dots = np.einsum("ij,ij->i", x[rows], q)
            return np.divide(dots, both, out=np.zeros(len(rows)), where=both > 0)

        near, between = cos(b), cos(mid)
        odd = np.flatnonzero(~kb[rows])
        for i, x in zip(odd.tolist(), batch.column(7).take(pa.array(rows[odd])).to_pylist()):
            near[i] = _odd_cosine(x, queries[who[i]])
        take = pa.array(rows)
        cols = [pa.array([names[i] for i in who.tolist()], pa.string()), *[batch.column(i).take(take) for i in range(1, 6)],
                pa.array(near, from_pandas=True), pa.array(between)]
        yield pa.RecordBatch.from_arrays(cols, ["query_id", "reason_id", "u", "v", "hub", "score", "cosine", "mid"])


def score_against(store: DataFrame, queries: list[tuple[str, list]], k: int = 0, least: float = -2.0) -> DataFrame:
    """(query_id, entity_id, cosine) of ``store(entity_id, vector)`` against a bounded list of query vectors.

    One pass over the store in Arrow batches, a matrix product each; with ``k``, each batch gives only what may be among
    its best k, so what is shuffled doesn't grow with the store but with its batches. Rows whose vector isn't usable or
    has another length than the queries' are passed over (P-16).
    """
    if not queries:
        return store.sparkSession.createDataFrame([], "query_id string, entity_id string, cosine double")
    if len(queries) > 4096:
        raise ValueError("a query list holds at most 4096 vectors")
    names, matrix = [str(n) for n, _ in queries], np.array([v for _, v in queries], dtype=np.float64)
    dim = matrix.shape[1]
    rows = store.where((F.size("vector") == dim) & usable(F.col("vector"))).select("entity_id", "vector")
    return rows.mapInArrow(lambda it: _score(it, matrix, names, k, least), "query_id string, entity_id string, cosine double")


def top_k(hits: DataFrame, k: int, score: str = "cosine", by: str = "query_id", decimals: int = 6) -> DataFrame:
    """The best ``k`` of each group by score (rounded, so that equal means equal everywhere), ties by id, with rank."""
    order = Window.partitionBy(by).orderBy(F.desc(score), "entity_id")
    return hits.withColumn(score, F.round(score, decimals)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
