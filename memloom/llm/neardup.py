"""Near-duplicate texts: every pair whose word-shingle sets share at least a threshold of their union.

1. A scan turns each text into its set of shingle hashes and, from that, a content key (equal sets), a size, a 512-bit
   OR-bitmap and the keys of its min-hash bands. Texts with equal sets collapse to one representative.
2. Representatives meet in the buckets of their bands, each the root of a *signature tree*: leaves hold rows in order of size,
   nodes the OR of the bitmaps below them, the range of sizes and the greatest number of elements that share a bit. A dual
   traversal of the tree with itself drops every pair of nodes whose sizes can't fit or whose greatest possible overlap -
   bits in common plus shared-bit elements - is below what the threshold demands.
   Buckets above ``HOT`` rows are found by counting keys before any row is shuffled. Their rows are spread by size class
   and hash over blocks, the upper nodes of the tree; blocks are pruned against each other by the same bounds in the JVM, and
   only surviving block pairs are joined, each in a task of its own and of at most two blocks.
3. Candidates are verified exactly on the whole shingle sets.

Only the routing can lose a pair: 24 bands of 2 miss one of similarity s with probability (1 - s^2)^24, at the
threshold 0.6 2e-5, at 0.7 1e-7. Texts of fewer than ``min_words`` words, null and empty ones take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.arrow import blocks, list_array
from memloom.session import checkpoint, small, spread, written

BANDS, ROWS = 24, 2
WORDS64 = 8  # words of the bitmap: 512 bits
#: Rows of a bucket beyond which its blocks are spread over tasks, rows of a block, rows of a leaf, children of a node.
HOT, LEAF, FANOUT = 8192, 32, 8
#: Ids of candidates up to which a bitmap of 16 bits an id is broadcast to the scan of their texts; more are joined.
FILTER_IDS = 1 << 20

_M1, _M2, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123)]] = True
_FACTORS = np.random.default_rng(20240607).integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _word_hashes(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; words of one length go together."""
    order = np.argsort(-sizes, kind="stable")
    at, size = starts[order], sizes[order]
    h = np.full(len(at), _C, dtype=np.uint64)
    long = int(np.searchsorted(-size, -256, side="left"))  # words above 256 bytes
    for i in range(long):
        digest = hashlib.blake2b(buf[at[i] : at[i] + size[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(digest, dtype=np.uint64)[0]
    at, size = at[long:], size[long:]
    rest = h[long:]
    for k in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -k, side="left"))
        rest[:m] = rest[:m] * _M1 + buf[at[:m] + k]
    out = np.empty_like(h)
    out[order] = _mix(h)
    return out


def shingle_sets(texts: list, width: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which texts take part, the number of distinct shingles of each, and all their hashes, sorted within a text.

    Words are runs of [a-z0-9] in the lower-cased text.
    """
    coded = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    buf = np.frombuffer(b"\x00" + b"\x00".join(coded) + b"\x00", dtype=np.uint8)
    inside = _WORD[buf]
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = turn[::2], turn[1::2]
    none = np.zeros(0, dtype=np.int64)
    if not len(starts):
        return none, none, none.astype(np.uint64)
    text_ends = np.cumsum([len(c) + 1 for c in coded])
    owner = np.searchsorted(text_ends, starts, side="left")
    words = np.bincount(owner, minlength=len(texts))
    h = _word_hashes(buf, starts, ends - starts)
    n = len(h) - width + 1
    if n <= 0:
        return none, none, none.astype(np.uint64)
    s = h[:n].copy()
    for j in range(1, width):
        s = _mix(s * _C + h[j : j + n])
    fits = (owner[:n] == owner[width - 1 :]) & (words[owner[:n]] >= min_words)
    s, owner = s[fits], owner[:n][fits]
    if not len(s):
        return none, none, none.astype(np.uint64)
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(s)]):
        s[a:b].sort()
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[keep], owner[keep]
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    return owner[cuts], np.diff(np.append(cuts, len(s))), s


def _signatures(batches: Iterator[pa.RecordBatch], width: int, min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = np.asarray(batch.column(0)), batch.column(1).to_pylist()
        for a, b in blocks(texts):
            who, size, s = shingle_sets(texts[a:b], width, min_words)
            if not len(who):
                continue
            cuts = np.concatenate([[0], np.cumsum(size)[:-1]])
            flags = np.zeros((len(who), WORDS64 * 64), dtype=bool)
            flags[np.repeat(np.arange(len(who)), size), (s >> np.uint64(55)).astype(np.int64)] = True
            bits = np.packbits(flags, axis=1, bitorder="little").view(np.int64)
            low = np.stack([np.minimum.reduceat(s * f, cuts) for f in _FACTORS])
            bands = np.empty((len(who), BANDS), dtype=np.uint64)
            for j in range(BANDS):
                key = np.full(len(who), j, dtype=np.uint64)
                for r in range(ROWS):
                    key = _mix(key * _C + low[j * ROWS + r])
                bands[:, j] = key
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a:b][who]), *_content_keys(s, cuts), pa.array(size, pa.int32()),
                 *[pa.array(np.ascontiguousarray(bits[:, w])) for w in range(WORDS64)],
                 list_array(np.full(len(who), BANDS), pa.array(bands.view(np.int64).ravel()))],
                ["item_id", "k1", "k2", "size", *_BITS, "bands"],
            )


def _content_keys(s: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A 128-bit key of each set of shingles, in two halves."""
    return pa.array(np.add.reduceat(_mix(s ^ _M2), cuts).view(np.int64)), pa.array(np.bitwise_xor.reduceat(_mix(s + _C), cuts).view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], width: int, min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = np.asarray(batch.column(0)), batch.column(1).to_pylist()
        for a, b in blocks(texts):
            who, size, s = shingle_sets(texts[a:b], width, min_words)
            if len(who):
                cuts = np.concatenate([[0], np.cumsum(size)[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][who]), *_content_keys(s, cuts), list_array(size, pa.array(s.view(np.int64)))], ["item_id", "k1", "k2", "shingles"]
                )


_BITS = [f"w{i}" for i in range(WORDS64)]


class SignatureTree:
    """A tree over rows (size, bitmap), for the pairs that may reach a similarity."""

    def __init__(self, size: np.ndarray, bits: np.ndarray):
        order = np.argsort(size, kind="stable")
        self.rows, bits = order, bits[order]
        size = size[order].astype(np.int64)
        shared = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        #: From the rows up: least size, greatest size, greatest shared-bit count, OR of bitmaps.
        self.levels = [(size, size, shared, bits)]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            lo, hi, sh, bm = self.levels[-1]
            cuts = np.arange(0, len(lo), step)
            self.levels.append((np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(sh, cuts), np.bitwise_or.reduceat(bm, cuts, axis=0)))
            step = FANOUT

    def pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs (in blocks) that no bound excludes; each pair once."""
        yield from self.pairs_with(self, threshold)

    def pairs_with(self, other: "SignatureTree", threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a row here and one of ``other``, or of two here, that no bound excludes: a dual traversal, depth first in
        blocks, so memory is bounded. Of trees of unlike height the upper nodes of the higher one meet the other's root."""
        own = other is self
        top = min(len(self.levels), len(other.levels)) - 1
        heads = [np.arange(len(x.levels[top][0])) for x in (self, other)]
        u, v = np.repeat(heads[0], len(heads[1])), np.tile(heads[1], len(heads[0]))
        todo = [(top, u[u <= v], v[u <= v]) if own else (top, u, v)]
        while todo:
            level, u, v = todo.pop()
            ok = may_match(self.levels[level], u, v, threshold, other.levels[level])
            u, v = u[ok], v[ok]
            if level == 0:
                if own:
                    u, v = u[u != v], v[u != v]
                if len(u):
                    yield self.rows[u], other.rows[v]
                continue
            step, n, m = (LEAF if level == 1 else FANOUT), len(self.levels[level - 1][0]), len(other.levels[level - 1][0])
            for i in range(0, len(u), 256):
                a, b = (x[i : i + 256, None] * step + np.arange(step) for x in (u, v))
                left, right = np.repeat(a, step, axis=1).ravel(), np.tile(b, (1, step)).ravel()
                real = (left < n) & (right < m)
                if own:
                    real &= left <= right
                todo.append((level - 1, left[real], right[real]))


def may_match(level: tuple, u: np.ndarray, v: np.ndarray, threshold: float, other: tuple | None = None) -> np.ndarray:
    """Whether rows or nodes u of a level and v of it, or of another tree's, may hold a pair of at least the threshold."""
    (lo, hi, shared, bits), (lo_2, hi_2, shared_2, bits_2) = level, other or level
    need = threshold / (1 + threshold) * (lo[u] + lo_2[v]) - 1e-9
    ok = (hi[u] >= threshold * lo_2[v] - 1e-9) & (hi_2[v] >= threshold * lo[u] - 1e-9)
    most = np.bitwise_count(bits[u] & bits_2[v]).sum(1, dtype=np.int64) + np.minimum(shared[u], shared_2[v])
    return ok & (most >= need)


def _bucket_pairs(key: np.ndarray, size: np.ndarray, bits: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate row pairs of all buckets in rows sorted by key."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(cuts, len(key)))
    small = np.repeat(count <= LEAF, count)
    level = (size.astype(np.int64), size.astype(np.int64), size - np.bitwise_count(bits).sum(1, dtype=np.int64), bits)
    # a bucket that fits a leaf has no nodes: all its rows at once, shift by shift
    for d in range(1, int(min(count.max(), LEAF))):
        u = np.flatnonzero((key[:-d] == key[d:]) & small[:-d])
        if not len(u):
            break
        ok = may_match(level, u, u + d, threshold)
        yield u[ok], u[ok] + d
    for a, n in zip(cuts[count > LEAF].tolist(), count[count > LEAF].tolist()):
        for u, v in SignatureTree(size[a : a + n], bits[a : a + n]).pairs(threshold):
            yield a + u, a + v


_OUT = "a bigint, b bigint"


def _pair_batch(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _join_sorted(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Join each bucket of rows (key, id, size, w0..w7) sorted by key; none has more than HOT rows."""
    held: list[np.ndarray] = []  # the unfinished last bucket

    def joined(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for u, v in _bucket_pairs(rows[:, 0], rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64), threshold):
            if len(u):
                yield _pair_batch(rows[u, 1], rows[v, 1])

    for batch in batches:
        rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        rows = np.concatenate([*held, rows]) if held else rows
        last = int(np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))[-1])
        if last:
            yield from joined(rows[:last])
        held = [rows[last:]]
    if held:
        yield from joined(held[0])


def _meeting(rows: pa.Table, threshold: float) -> pa.Table:
    """Candidate pairs of one meeting (id, second, size, w0..w7): of a block with itself, or only across two blocks."""
    if not rows.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    ids, second = np.asarray(rows.column("id")), np.asarray(rows.column("second")).astype(bool)
    size = np.asarray(rows.column("size")).astype(np.int64)
    bits = np.stack([np.asarray(rows.column(w)) for w in _BITS], axis=1).view(np.uint64)
    if second.any():
        one, two = (SignatureTree(size[m], bits[m]) for m in (~second, second))
        found = one.pairs_with(two, threshold)
        left, right = ids[~second], ids[second]
    else:
        tree = SignatureTree(size, bits)
        found, left, right = tree.pairs(threshold), ids, ids
    parts = [_pair_batch(left[u], right[v]) for u, v in found]
    return pa.Table.from_batches(parts) if parts else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def candidate_pairs(reps: DataFrame, threshold: float, most: int | None = None) -> DataFrame:
    """Distinct (a, b), a < b, of representatives ``reps(id, size, w0..w7, bands)`` that may reach the threshold."""
    most = most or HOT
    rows = reps.select(F.explode("bands").alias("key"), "id", "size", *_BITS)
    # a row per key and partition at most is shuffled for the counts
    hot = written(reps.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"), "hot")
    if hot.isEmpty():
        cool = rows
    else:
        cool = rows.join(small(hot), "key", "left_anti")
    near = cool.repartition("key").sortWithinPartitions("key", "size").mapInArrow(lambda it: _join_sorted(it, threshold), _OUT)
    if hot.isEmpty():
        return near.distinct()
    # classes of sizes: rows of classes further apart than one can't match
    rows = rows.join(small(hot), "key").withColumn("class", F.floor(F.log(F.col("size").cast("double")) / float(-np.log(threshold))).cast("int"))
    counts = rows.groupBy("key", "class").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("n_blocks"))
    rows = rows.join(small(written(counts, "classes")), ["key", "class"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("n_blocks")).cast("int")).drop("n_blocks")
    rows = written(rows, "blocks")
    pop = " + ".join(f"bit_count({w})" for w in _BITS)
    nodes = rows.groupBy("key", "class", "block").agg(
        F.min("size").alias("lo"), F.max("size").alias("hi"), F.expr(f"max(size - ({pop}))").alias("shared"), *[F.bit_or(w).alias(w) for w in _BITS])
    nodes = written(nodes, "nodes")
    other = nodes.select("key", *[F.col(c).alias(f"{c}_2") for c in nodes.columns if c != "key"])
    common = " + ".join(f"bit_count({w} & {w}_2)" for w in _BITS)
    t = threshold
    reach = nodes.withColumn("class_2", F.explode(F.array(F.col("class"), F.col("class") + 1)))
    kept = reach.join(other, ["key", "class_2"]).where("class < class_2 or block <= block_2").where(
        f"hi >= {t} * lo_2 - 1e-9 and hi_2 >= {t} * lo - 1e-9 and "
        f"{common} + least(shared, shared_2) >= {t / (1 + t)} * (lo + lo_2) - 1e-9"
    ).select("key", "class", "block", "class_2", "block_2", F.xxhash64("key", "class", "block", "class_2", "block_2").alias("meeting"))
    apart = (F.col("class") != F.col("class_2")) | (F.col("block") != F.col("block_2"))
    sides = kept.select("key", "class", "block", "meeting", F.lit(False).alias("second")).unionByName(
        kept.where(apart).select("key", F.col("class_2").alias("class"), F.col("block_2").alias("block"), "meeting", F.lit(True).alias("second")))
    met = rows.join(sides, ["key", "class", "block"]).select("meeting", "id", "second", "size", *_BITS)
    return near.unionByName(met.groupBy("meeting").applyInArrow(lambda x: _meeting(x, threshold), _OUT)).distinct()


def near_duplicates(items: DataFrame, threshold: float = 0.8, width: int = 5, min_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Links and membership of ``items(item_id, text)``.

    Returns ``links(a, b, similarity, key_a, key_b)`` between classes, a <= b, and ``members(item_id, class_id, key)``: the texts with
    one shingle set form a class named by its least id. An id that holds several texts is in several classes, which
    may have one name; ``key`` tells them apart, a 64-bit hash of the set: of n classes two share it with
    probability n^2 / 2^65.
    """
    items = items.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    kind = "item_id bigint, k1 bigint, k2 bigint, size int, " + ", ".join(f"{w} bigint" for w in _BITS) + ", bands array<bigint>"
    sigs = written(spread(items).mapInArrow(lambda it: _signatures(it, width, min_words), kind), "signatures")
    reps = sigs.groupBy("k1", "k2").agg(
        F.min("item_id").alias("id"), F.first("size").alias("size"), *[F.first(w).alias(w) for w in _BITS], F.first("bands").alias("bands")
    ).withColumn("id", F.xxhash64("k1", "k2")).drop("k1", "k2")
    reps = written(reps, "classes")
    # a class goes by the hash of its content key, whatever ids its texts have
    cand = written(candidate_pairs(reps, threshold), "candidates")
    named = sigs.select("item_id", "k1", "k2", F.xxhash64("k1", "k2").alias("id"))
    ids = written(cand.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids")
    # one text of each class that takes part is read again
    heads = named.join(small(ids), "id", "left_semi").groupBy("id").agg(F.min("item_id").alias("item_id"))
    heads = written(heads, "heads")
    wanted = _texts_of(items, heads.select("item_id").distinct())
    kind = "item_id bigint, k1 bigint, k2 bigint, shingles array<bigint>"
    sets = wanted.mapInArrow(lambda it: _sets(it, width, min_words), kind).withColumn("id", F.xxhash64("k1", "k2"))
    sets = sets.join(heads, ["id", "item_id"], "left_semi").groupBy("id").agg(F.first("shingles").alias("shingles"))
    both = cand.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    inter = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    linked = inter.withColumn("similarity", F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).where(
        F.col("similarity") >= threshold
    ).select("a", "b", "similarity")
    owner = named.groupBy("id").agg(F.min("item_id").alias("class_id"))
    members = named.select("id", "item_id").distinct().join(owner, "id").select("item_id", "class_id", F.col("id").alias("key"))
    name = heads.select("id", F.col("item_id").alias("class_id"))  # the least id of each class that takes part
    links = linked.join(name.select(F.col("id").alias("a"), F.col("class_id").alias("ca")), "a").join(name.select(F.col("id").alias("b"), F.col("class_id").alias("cb")), "b")
    turned = F.col("ca") > F.col("cb")
    links = links.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "similarity",
                         F.when(turned, F.col("b")).otherwise(F.col("a")).alias("key_a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("key_b"))
    return links, members


def _texts_of(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``items(item_id, text)`` whose id is among ``ids(item_id)``, and perhaps a few others.

    Up to FILTER_IDS ids a bitmap of at least 16 bits an id goes to the scan, at most 4 MB; more ids are joined.
    """
    n = ids.count()
    if n > FILTER_IDS:
        return items.join(ids, "item_id", "left_semi")
    slot = F.pmod(F.xxhash64("item_id"), F.lit(1 << max(10, (16 * n - 1).bit_length())))
    bitmap = ids.withColumn("slot", slot).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask")
    )
    return items.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(bitmap), "word").where(
        F.expr("(shiftrightunsigned(mask, cast(slot & 63 as int)) & 1L) = 1L")
    ).select("item_id", "text")


def expanded_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """All (id_a, id_b), id_a < id_b, of items in linked classes or in one class."""
    first = members.select(F.col("key").alias("key_a"), F.col("item_id").alias("x"))
    second = members.select(F.col("key").alias("key_b"), F.col("item_id").alias("y"))
    across = links.select("key_a", "key_b").join(first, "key_a").join(second, "key_b").select("x", "y")
    within = first.join(second, F.col("key_a") == F.col("key_b")).where("x < y").select("x", "y")
    return across.unionByName(within).where("x <> y").select(
        F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")
    ).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, group_id): connected components by alternating large-star and small-star steps, each written to the shared
    folder; the number of rounds is logarithmic and nothing is collected but a change count."""
    edges = checkpoint(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        met = down.join(low, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            low.select("u", F.col("m").alias("v"))
        ).distinct()
        new = checkpoint(small)
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            break
        edges = new
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(roots)
