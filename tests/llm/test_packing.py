import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from memloom.llm import packing as pk


@pytest.mark.parametrize("open_bins", [1, 4, 256])
def test_best_fit_is_valid(open_bins):
    rng = random.Random(1)
    sizes = [rng.randrange(0, 101) for _ in range(5000)]
    bins = defaultdict(int)
    for s, b in zip(sizes, pk.best_fit(sizes, 100, open_bins)):
        bins[b] += s
    assert max(bins.values()) <= 100
    if open_bins == 256:
        assert sum(sizes) / (100 * len(bins)) > 0.95


def brute(sizes, capacity, open_bins):
    free, out, opened = {}, [], 0
    for s in sizes:
        fit = [(f, b) for b, f in free.items() if f >= s and f]
        if fit:
            least = min(f for f, _ in fit)
            f, b = least, None
            b = [x for x in free if free[x] == least][-1]
        else:
            if len(free) >= open_bins:
                full = min(free.values())
                del free[[x for x in free if free[x] == full][-1]]
            b, opened = opened, opened + 1
            f = capacity
        free.pop(b, None)
        if f - s:
            free[b] = f - s
        out.append(b)
    return out


def test_against_brute_force():
    rng = random.Random(7)
    for _ in range(30):
        sizes = [rng.randrange(1, 41) for _ in range(300)]
        assert pk.best_fit(sizes, 40, 5) == brute(sizes, 40, 5)


def test_operator(spark):
    rows = [(i, n, 1) for i, n in enumerate([5, 0, 12, 30, 10, None, 7, 7, 25])] + [(4, 10, 1), (None, 3, 1)]
    items = spark.createDataFrame(rows, "item_id bigint, n_tokens int, grp int")
    boxes = spark.createDataFrame([("s", 10, "t"), ("l", 100, "t"), ("zero", 0, "t")], "container string, capacity_tokens int, tokenizer string")
    got = pk.pack(items, boxes, len(rows), group_items=4)
    assert {r.container for r in got.collect()} == {"s", "l"}
    full = got.groupBy("container", "grp", "bin").agg(F.sum("n_tokens").alias("n")).collect()
    assert all(r.n <= {"s": 10, "l": 100}[r.container] for r in full)
    per = {(r.container, r.item_id): (r.n, r.k) for r in got.groupBy("container", "item_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).collect()}
    assert per["s", 3] == (30, 3) and per["s", 8] == (25, 3) and per["l", 3] == (30, 1) and per["s", 4] == (20, 2) and per["s", 5] == (0, 1) and per["l", None] == (3, 1)
    assert pk.pack(items.limit(0), boxes, 0).count() == 0 and pk.pack(items, boxes.limit(0), 5).count() == 0
    again = pk.pack(items.repartition(7), boxes, len(rows), group_items=4)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_tokenizers_beyond_the_bound_are_refused(spark, tmp_path):
    from memloom.llm import registry

    spark.createDataFrame([(1, "a")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(f"c{i}", 10, f"t{i}") for i in range(65)], "container string, capacity_tokens int, tokenizer string").write.parquet(str(tmp_path / "containers.parquet"))
    with pytest.raises(ValueError):
        registry.p7_packing(spark, str(tmp_path))


def test_fill():
    """Of containers filled with many small texts less than one in a hundred places stays empty."""
    import numpy as np

    from memloom.llm.packing import best_fit

    sizes = np.random.default_rng(1).integers(1, 300, 20_000).tolist()
    assert sum(sizes) >= 0.985 * 2048 * (max(best_fit(sizes, 2048)) + 1)
