"""The k most similar vectors of every vector, by balanced posting lists.

* Exact copies of a vector collapse to one representative that carries its first ``k + 1`` ids, so a copy group of any size is
  one point of the index.
* Centroids come from a two-level k-means on a bounded sample (``SAMPLE`` vectors at most); clusters above twice their share
  are split, so lists are balanced. Centroids are searched through an in-memory graph: a query enters at its nearest pivot,
  whose ball of graph neighbours is scored at once, and then moves along the neighbours of its best centroid.
* A vector is stored in the lists of its nearest centroids: boundary vectors, whose distances to several centroids are
  within a ratio of the least, go to several lists. A query probes the lists within a wider ratio (distance-ratio pruning).
* The sample carries ``MAX_LISTS`` lists. A list above ``SPLIT_ROWS`` rows - all are, above some millions of vectors - gets
  centroids, a graph and lists of its own in the task that scores it, so work grows with the rows and not with their square.
* Pairs are chosen in single precision and scored again in double before they are ranked.

The index holds every row; only the centroids are fitted on a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.session import written

#: Vectors the centroids are fitted on, at most; rows a list should hold; lists of the first level at most, as the sample
#: carries no more; rows above which a list gets lists of its own; rows scored at once.
SAMPLE, LIST_TARGET, MAX_LISTS, SPLIT_ROWS, LIST_ROWS = 32_768, 256, 8192, 2048, 2048
#: Lists a vector is stored in and a query probes, at most, and the distance ratios that prune them.
STORE_LISTS, PROBE_LISTS, STORE_RATIO, PROBE_RATIO = 3, 4, 1.1, 1.2
_DEGREE, _BALL = 16, 96


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; an emptied cluster takes over a random vector."""
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        who = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, who, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), x[rng.integers(0, len(x), size=len(c))])
    return c.astype(np.float32)


def fit_centroids(sample: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """About ``count`` centroids by two-level k-means, the second level in proportion to each part's size; then clusters that
    hold more than twice the mean are split in proportion, twice at most."""
    rng = np.random.default_rng(seed)
    count = max(1, min(count, len(sample) // 4 or 1))
    top = _kmeans(sample, max(1, int(np.sqrt(count))), rng)
    who = (sample @ top.T).argmax(1)
    out = []
    for j in range(len(top)):
        part = sample[who == j]
        if len(part):
            out.append(_kmeans(part, max(1, round(count * len(part) / len(sample))), rng))
    found = np.concatenate(out)
    share = len(sample) / len(found)
    for _ in range(2):
        who = np.concatenate([(sample[i : i + 4096] @ found.T).argmax(1) for i in range(0, len(sample), 4096)])
        size = np.bincount(who, minlength=len(found))
        great = np.flatnonzero((size > 2 * share) & (size >= 8))
        if not len(great):
            break
        new = [_kmeans(sample[who == j], int(np.ceil(size[j] / share)), rng) for j in great]
        found = np.concatenate([np.delete(found, great, axis=0), *new])
    return found


class CentroidGraph:
    """Centroids with neighbour lists; finds the nearest few for many queries at once."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        n = len(centroids)
        deg = min(_DEGREE, n - 1)
        near = np.empty((n, deg), dtype=np.int64)
        for i in range(0, n, 1024):
            s = centroids[i : i + 1024] @ centroids.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
            near[i : i + 1024] = np.argpartition(-s, max(deg - 1, 0), axis=1)[:, :deg] if deg else 0
        step = max(1, int(np.sqrt(n) / 4))
        self.pivots = np.arange(0, n, step)
        # neighbourhood holds both ways, or a centroid nobody is nearest to could not be reached
        both = [set(row) for row in near.tolist()]
        for u, row in enumerate(near.tolist()):
            for v in row:
                both[v].add(u)
        self.links = [np.fromiter(x, dtype=np.int64, count=len(x)) for x in both]
        # each pivot's ball: graph neighbours, breadth first
        self.balls = []
        for p in self.pivots:
            seen, frontier = [int(p)], [int(p)]
            known = {int(p)}
            while frontier and len(seen) < _BALL:
                nxt = []
                for u in frontier:
                    for v in self.links[u].tolist():
                        if v not in known:
                            known.add(v)
                            nxt.append(v)
                seen += nxt
                frontier = nxt
            self.balls.append(np.array(seen[: _BALL * 2]))

    def nearest(self, x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the ``p`` nearest centroids found for each row of ``x``."""
        n = len(self.c)
        p = min(p, n)
        ids, sims = np.full((len(x), p), -1, dtype=np.int64), np.full((len(x), p), -2.0, dtype=np.float32)
        entry_sims = x @ self.c[self.pivots].T
        entry = entry_sims.argmax(1)
        entry_sims[np.arange(len(x)), entry] = -2
        pair = entry * len(self.pivots) + entry_sims.argmax(1)
        for e in np.unique(pair):
            rows = np.flatnonzero(pair == e)
            ball = np.union1d(self.balls[e // len(self.pivots)], self.balls[e % len(self.pivots)])
            for _ in range(4):  # move on to the neighbourhoods of the best centroids found
                s = x[rows] @ self.c[ball].T
                best = np.unique(ball[s.argmax(1)])
                more = np.setdiff1d(np.concatenate([self.links[u] for u in best.tolist()]), ball)
                if not len(more):
                    break
                ball = np.concatenate([ball, more])
            s = x[rows] @ self.c[ball].T
            q = min(p, len(ball))
            top = np.argpartition(-s, q - 1, axis=1)[:, :q]
            v = np.take_along_axis(s, top, 1)
            order = np.argsort(-v, axis=1, kind="stable")
            ids[rows, :q] = ball[np.take_along_axis(top, order, 1)]
            sims[rows, :q] = np.take_along_axis(v, order, 1)
        return ids, sims


def unit_rows(values: pa.Array, dim: int) -> np.ndarray:
    """A list column whose rows all have ``dim`` numbers, as a matrix of unit rows in double precision."""
    flat = np.asarray(values.flatten(), dtype=np.float64).reshape(-1, dim)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def valid_vector(column: str, dim: int) -> str:
    """SQL for: the vector has ``dim`` finite numbers, not all zero."""
    return (
        f"{column} is not null and size({column}) = {dim} and "
        f"forall({column}, x -> x is not null and not isnan(x) and abs(x) <> float('infinity')) and exists({column}, x -> x <> 0)"
    )


def _chosen(graph: CentroidGraph, unit: np.ndarray, asks: np.ndarray, store: int, probe: int, store_ratio: float, probe_ratio: float) -> tuple:
    """Row, list, stored and probing of each list that stores a row or that it probes."""
    ids, sims = graph.nearest(unit, max(store, probe))
    dist = np.sqrt(np.maximum(2 - 2 * sims, 1e-12))
    rank = np.arange(ids.shape[1])
    base = np.maximum(dist[:, :1], 1e-3)
    stored = (rank < store) & (dist <= store_ratio * base) & (ids >= 0)
    probing = (rank < probe) & (dist <= probe_ratio * base) & (ids >= 0) & asks[:, None]
    r, c = np.nonzero(stored | probing)
    return r, ids[r, c], stored[r, c], probing[r, c]


def _route(batches: Iterator[pa.RecordBatch], graphs: dict[str, CentroidGraph], dim: int, tuning: tuple) -> Iterator[pa.RecordBatch]:
    """Rows (space, list, rep, v, stored, probing): each vector in the lists that store it or that it probes."""
    for batch in batches:
        spaces = np.asarray(batch.column(0).to_pylist(), dtype=object)
        raw = np.asarray(batch.column(2).flatten(), dtype=np.float32).reshape(-1, dim)
        unit = unit_rows(batch.column(2), dim).astype(np.float32)
        asks = np.asarray(batch.column(3)).astype(bool)
        for space in dict.fromkeys(spaces.tolist()):
            at = np.flatnonzero(spaces == space)
            r, lists, stored, probing = _chosen(graphs[space], unit[at], asks[at], *tuning)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at[r])), pa.array(lists, pa.int32()), batch.column(1).take(pa.array(at[r])),
                 _rows_binary(raw[at[r]]), pa.array(stored), pa.array(probing)],
                ["space", "list", "rep", "v", "stored", "probing"],
            )


def _rows_binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def _best(unit: np.ndarray, rep: np.ndarray, stored: np.ndarray, probing: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row that probes, the places of the best ``2 k`` stored ones, in blocks."""
    for i in range(0, len(probing), LIST_ROWS):
        q = probing[i : i + LIST_ROWS]
        best_s, best_i = np.full((len(q), 0), 0, np.float32), np.full((len(q), 0), 0, np.int64)
        for j in range(0, len(stored), LIST_ROWS):
            t = stored[j : j + LIST_ROWS]
            s = unit[q] @ unit[t].T
            s[rep[q][:, None] == rep[t][None, :]] = -2
            best_s = np.concatenate([best_s, s], axis=1)
            best_i = np.concatenate([best_i, np.broadcast_to(t, s.shape)], axis=1)
            if best_s.shape[1] > 2 * k:  # near ties survive in twice as many places
                top = np.argpartition(-best_s, 2 * k - 1, axis=1)[:, : 2 * k]
                best_s, best_i = np.take_along_axis(best_s, top, 1), np.take_along_axis(best_i, top, 1)
        r, c = np.nonzero(best_s >= max(least, -1.5) - 1e-5)
        yield q[r], best_i[r, c]


def _score_list(rows: pa.Table, dim: int, k: int, min_cosine: float, tuning: tuple, split_rows: int) -> pa.Table:
    """The best ``2 k`` stored rows of one list for each row that probes it, with their cosines in double precision.

    A list of more than ``split_rows`` stored rows is searched through lists of its own, built here on a sample of it.
    """
    values = rows.column("v").combine_chunks()
    raw = np.frombuffer(b"".join(values.to_pylist()), dtype=np.float32).reshape(-1, dim)
    rep = np.asarray(rows.column("rep"))
    norm = np.sqrt(np.einsum("ij,ij->i", raw, raw, dtype=np.float64))
    unit = (raw / norm[:, None]).astype(np.float32)
    holds, asks = np.asarray(rows.column("stored")).astype(bool), np.asarray(rows.column("probing")).astype(bool)
    stored, probing = np.flatnonzero(holds), np.flatnonzero(asks)
    if len(stored) > split_rows and len(probing):
        draw = stored[:: max(1, len(stored) // (SAMPLE // 2))]
        graph = CentroidGraph(fit_centroids(unit[draw], len(stored) // LIST_TARGET))
        r, lists, st, pr = _chosen(graph, unit, asks, *tuning)
        st &= holds[r]
        order = np.argsort(lists, kind="stable")
        cuts = np.flatnonzero(np.diff(lists[order], prepend=-1))
        parts = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)])]
        found = (x for part in parts for x in _best(unit, rep, r[part][st[part]], r[part][pr[part]], k, min_cosine))
    else:
        found = _best(unit, rep, stored, probing, k, min_cosine)
    got_a, got_b, got_s = [], [], []
    for q, t in found:
        for i in range(0, len(q), 1 << 16):
            x, y = q[i : i + (1 << 16)], t[i : i + (1 << 16)]
            s = np.einsum("ij,ij->i", raw[x].astype(np.float64), raw[y].astype(np.float64)) / (norm[x] * norm[y])
            keep = s >= min_cosine - 1e-12
            got_a.append(rep[x[keep]])
            got_b.append(rep[y[keep]])
            got_s.append(s[keep])
    space = rows.column("space")[0].as_py()
    a = np.concatenate(got_a) if got_a else np.zeros(0, np.int64)
    b, s = (np.concatenate(got_b), np.concatenate(got_s)) if got_a else (np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"space": pa.array([space] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "s": pa.array(s, pa.float64())})


def points(rows: DataFrame, dim: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct vectors of ``rows(space, id, v)``: heads, first ids, members.

    Heads (written to the shared folder): space, rep (a number), v. First ids: space, rep, ids, the first k + 1 ids with
    this vector. Members: space, rep, id. Rows whose
    vector isn't ``dim`` finite numbers, not all zero, and rows of null id are no points. Repeated rows count once.
    """
    ok = rows.where(F.expr(valid_vector("v", dim)) & F.col("id").isNotNull()).select(
        "space", "id", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")
    )
    # vectors travel once, with map-side combining; the ids of copies travel without them
    heads = ok.groupBy("space", "h1", "h2").agg(F.first("v").alias("v"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    heads = written(heads.withColumn("rep", F.monotonically_increasing_id()), "points")
    names = ok.select("space", "h1", "h2", "id").join(heads.where("lo <> hi").select("space", "h1", "h2", "rep"), ["space", "h1", "h2"])
    copies = names.select("space", "rep", "id").distinct()
    first = copies.withColumn("n", F.row_number().over(Window.partitionBy("space", "rep").orderBy("id"))).where(F.col("n") <= k + 1)
    ids = first.groupBy("space", "rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    single = heads.where("lo = hi").select("space", "rep", F.array("lo").alias("ids"))
    listed = single.unionByName(ids)
    members = heads.where("lo = hi").select("space", "rep", F.col("lo").alias("id")).unionByName(copies)
    return heads.select("space", "rep", "v"), listed, members


def build_graphs(heads: DataFrame, dim: int, most_lists: int = MAX_LISTS) -> dict[str, CentroidGraph]:
    """A centroid graph per space, fitted on at most ``SAMPLE`` vectors drawn by a hash of the vector."""
    sizes = {r[0]: r[1] for r in heads.groupBy("space").count().collect()}  # a row per space
    out = {}
    for space, n in sorted(sizes.items()):
        share = min(1.0, SAMPLE / n)
        drawn = heads.where(F.col("space") == space).where(
            F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))
        ).select("v").limit(SAMPLE + SAMPLE // 8).toArrow()
        sample = unit_rows(drawn.column("v").combine_chunks(), dim).astype(np.float32) if drawn.num_rows else np.zeros((0, dim), np.float32)
        if not len(sample):
            one = heads.where(F.col("space") == space).select("v").limit(64).toArrow()
            sample = unit_rows(one.column("v").combine_chunks(), dim).astype(np.float32)
        out[space] = CentroidGraph(fit_centroids(sample, min(most_lists, max(1, n // LIST_TARGET))))
    return out


def nearest_points(heads: DataFrame, graphs: dict[str, CentroidGraph], dim: int, k: int, min_cosine: float = -1.0,
                   asking: DataFrame | None = None, store: int = STORE_LISTS, probe: int = PROBE_LISTS,
                   store_ratio: float = STORE_RATIO, probe_ratio: float = PROBE_RATIO, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(space, a, b, s): up to ``2 k`` best points b found for each point a that asks (all, or those of ``asking(rep)``)."""
    if asking is None:
        rows = heads.select("space", "rep", "v", F.lit(True).alias("asks"))
    else:
        rows = heads.join(asking.select("rep", F.lit(True).alias("asks")), "rep", "left").select(
            "space", "rep", "v", F.coalesce("asks", F.lit(False)).alias("asks")
        )
    tuning = (store, probe, store_ratio, probe_ratio)
    routed = rows.mapInArrow(
        lambda it: _route(it, graphs, dim, tuning),
        "space string, list int, rep bigint, v binary, stored boolean, probing boolean",
    )
    found = routed.groupBy("space", "list").applyInArrow(
        lambda rows: _score_list(rows, dim, k, min_cosine, tuning, split_rows), "space string, a bigint, b bigint, s double"
    )
    return found.groupBy("space", "a", "b").agg(F.max("s").alias("s"))


def nearest_entities(rows: DataFrame, dim: int, k: int, min_cosine: float = -1.0, asking_ids=None, most_lists: int = MAX_LISTS, **tuning) -> DataFrame:
    """(space, id, other, s): the at most ``k`` others of greatest cosine, at least ``min_cosine``, ties by id.

    ``asking_ids``: a predicate Column over ``id``; only those ids ask, all are searched. Copies of one vector have each
    other at cosine 1. Columns beside space, id and v are dropped.
    """
    heads, listed, members = points(rows.select("space", "id", "v"), dim, k)
    graphs = build_graphs(heads, dim, most_lists)
    asking = members.where(asking_ids).select("rep").distinct() if asking_ids is not None else None
    near = nearest_points(heads, graphs, dim, k, min_cosine, asking, **tuning)
    # the k best points of each suffice, as each stands for at least one id
    head_ids = listed.select("space", F.col("rep").alias("b"), "ids")
    order = Window.partitionBy("space", "a").orderBy(F.desc("s"), F.col("ids")[0])
    best = near.join(head_ids, ["space", "b"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    own = listed.where(F.size("ids") > 1).select("space", F.col("rep").alias("a"), F.lit(1.0).alias("s"), "ids")
    every = best.select("space", "a", "s", "ids").unionByName(own)
    asked = members.where(asking_ids) if asking_ids is not None else members
    pairs = asked.select("space", F.col("rep").alias("a"), "id").join(every, ["space", "a"]).select(
        "space", "id", "s", F.explode("ids").alias("other")
    ).where("id <> other")
    rank = Window.partitionBy("space", "id").orderBy(F.desc("s"), "other")
    return pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).where(
        F.col("s") >= min_cosine - 1e-12
    ).select("space", "id", "other", "s", "rank")
