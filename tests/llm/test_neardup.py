import random
import re

import numpy as np

from memloom.llm import neardup as nd


def sets(texts, width, least):
    out = {}
    for i, t in texts:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if len(w) >= least:
            out.setdefault(i, set()).add(frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)))
    return out


def brute(texts, threshold, width, least):
    s = {i: next(iter(v)) for i, v in sets(texts, width, least).items()}
    ids = sorted(s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if len(s[a] & s[b]) >= threshold * len(s[a] | s[b]) - 1e-12 and s[a]}


def corpus(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Äpfel", "K", "x" * 300, "deadbeef" * 40]
    shared = " ".join(rng.choice(words) for _ in range(30))
    texts, i = [], 0
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 150))]
        for k in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 3, 10])):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w = w[len(w) // 3:] + w[: len(w) // 3]
            texts.append((i, ("  ".join(w) if k % 2 else ". ".join(w)) + (" " + shared if rng.random() < 0.5 else "")))
            i += 1
    texts += [(900, texts[0][1]), (901, texts[0][1].upper()), (902, None), (903, ""), (904, "short"), (905, "a " * 60), (906, "a " * 90), (5, texts[5][1])]
    return texts


def run(spark, texts, threshold, width, least):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "item_id bigint, text string, size int, bands int")
    links, members = nd.near_duplicates(df, threshold, width, least)
    return {(r.id_a, r.id_b) for r in nd.expanded_pairs(links, members).collect()}, links, members


def test_against_brute_force(spark):
    texts = corpus()
    for threshold, width, least in ((0.6, 3, 40), (0.8, 5, 5)):
        got, _, _ = run(spark, texts, threshold, width, least)
        assert got == brute(texts, threshold, width, least)


def test_hot_buckets_are_spread(spark, monkeypatch):
    # every bucket of more than three rows goes the way of hot ones
    monkeypatch.setattr(nd, "HOT", 3)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 12):
            w[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    import pyspark.cloudpickle as cloudpickle

    cloudpickle.register_pickle_by_value(nd)  # workers see the changed bound
    try:
        got, _, _ = run(spark, texts, 0.6, 3, 40)
    finally:
        cloudpickle.unregister_pickle_by_value(nd)
    assert got == brute(texts, 0.6, 3, 40)


def test_tree_drops_nothing():
    rng = np.random.default_rng(3)
    sets_ = [set(rng.integers(0, 3000, rng.integers(5, 400)).tolist()) for _ in range(150)]
    sets_ += [set(list(s)[: max(1, int(len(s) * 0.8))]) for s in sets_[:60]]
    bits = np.zeros((len(sets_), 512), dtype=bool)
    for i, s in enumerate(sets_):
        bits[i, [x * 7 % 512 for x in s]] = True
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    size = np.array([len(s) for s in sets_])
    kept = {tuple(sorted(p)) for u, v in nd.SignatureTree(size, words).pairs(0.6) for p in zip(u.tolist(), v.tolist())}
    true = {(a, b) for a in range(len(sets_)) for b in range(a + 1, len(sets_)) if len(sets_[a] & sets_[b]) >= 0.6 * len(sets_[a] | sets_[b])}
    assert true <= kept and len(kept) < len(sets_) ** 2 / 8


def test_groups_and_empty(spark):
    texts = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "a b c d e f g h i"), (4, "z y x w v u t s")]
    _, links, members = run(spark, texts, 0.8, 3, 5)
    assert {(r.item_id, r.class_id) for r in members.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert {(r.id, r.group_id) for r in nd.components(links).collect()} == {(1, 1), (3, 1)}
    got, links, members = run(spark, [], 0.8, 3, 5)
    assert got == set() and members.count() == 0 and nd.components(links).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 1.0)], "a bigint, b bigint, similarity double")
    assert {(r.id, r.group_id) for r in nd.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_an_id_with_two_texts(spark):
    """Each text of an id is compared; the pairs of the one aren't those of the other."""
    rng = random.Random(2)
    a, b = ([f"{c}{rng.randrange(10**6)}" for _ in range(60)] for c in "ab")
    texts = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:55])), (3, " ".join(b[:55])), (4, " ".join(b))]
    got, _, _ = run(spark, texts, 0.6, 3, 40)
    assert got == {(1, 2), (1, 3), (1, 4), (3, 4)}


def test_two_trees_lose_nothing():
    rng = np.random.default_rng(5)
    sets_ = [set(rng.integers(0, 3000, rng.integers(40, 90)).tolist()) for _ in range(300)]
    sets_ += [set(list(s)[: int(len(s) * 0.85)]) for s in sets_[:80]]
    bits = np.zeros((len(sets_), 512), dtype=bool)
    for i, s in enumerate(sets_):
        bits[i, [x * 7 % 512 for x in s]] = True
    words, size = np.packbits(bits, axis=1, bitorder="little").view(np.uint64), np.array([len(s) for s in sets_])
    for cut in (1, 7, 300):
        one, two = nd.SignatureTree(size[:cut], words[:cut]), nd.SignatureTree(size[cut:], words[cut:])
        kept = {(int(a), int(b) + cut) for u, v in one.pairs_with(two, 0.6) for a, b in zip(u, v)}
        true = {(a, b) for a in range(cut) for b in range(cut, len(sets_)) if len(sets_[a] & sets_[b]) >= 0.6 * len(sets_[a] | sets_[b])}
        assert true <= kept
