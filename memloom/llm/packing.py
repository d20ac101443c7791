"""Filling fixed-capacity containers with whole texts.

Bounded-space online best-fit: a fixed number of bins is open, their free space held in a bitset whose set bits are the
amounts of free space some open bin has. An item goes to the bin of least sufficient free space - the lowest set bit at
or above its size; if none fits, a bin is opened, and when too many are open the fullest - the lowest set bit - closes.

Items are dealt to groups of bounded expected size by a hash of their id, and each group is packed by itself in id
order, so the result depends neither on file layout nor on the cluster; only the bins open at a group's end may be left
part empty.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items per group (expected) and bins open at once.
GROUP_ITEMS, OPEN_BINS = 20_000, 256
#: Kinds of container in one call, at most; the table is fixed and read by the driver.
MAX_CONTAINERS = 64


def best_fit(sizes: Iterable[int], capacity: int, open_bins: int = OPEN_BINS) -> list[int]:
    """The bin of each item, numbered as they open; every size must be within 0..capacity."""
    free_bits, bins, opened, held = 0, defaultdict(list), 0, 0
    out = []
    for size in sizes:
        fitting = free_bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            at = bins[free].pop()
            if not bins[free]:
                free_bits &= ~(1 << free)
        else:
            if held >= open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                bins[fullest].pop()
                if not bins[fullest]:
                    free_bits &= ~(1 << fullest)
                held -= 1
            free, at = capacity, opened
            opened += 1
            held += 1
        rest = free - size
        if rest:
            bins[rest].append(at)
            free_bits |= 1 << rest
        else:
            held -= 1
        out.append(at)
    return out


def _pack_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Pack one (container, group); items above the capacity give full pieces and a remainder."""
    capacity, container, group = int(rows["capacity"].iloc[0]), rows["container"].iloc[0], rows["grp"].iloc[0]
    rows = rows.sort_values(["item_id", "n_tokens"], kind="stable")
    ids, starts, sizes = [], [], []
    for item, n in zip(rows["item_id"].tolist(), rows["n_tokens"].tolist()):
        for at in range(0, max(n, 1), capacity):
            ids.append(item)
            starts.append(at)
            sizes.append(min(capacity, n - at))
    return pd.DataFrame({
        "container": container, "grp": group, "bin": best_fit(sizes, capacity), "item_id": ids, "tok_start": starts,
        "n_tokens": sizes,
    })


def pack(items: DataFrame, containers: DataFrame, n_items: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Assign ``items(item_id, n_tokens)`` to bins of every row of ``containers(container, capacity_tokens)``.

    Columns: container, grp, bin, item_id, tok_start, n_tokens; (container, grp, bin) names a bin. ``n_items`` sets only
    the number of groups. Items of no tokens take a place of size 0; null sizes count as 0; repeated ids are packed as
    often as they come; an item above the capacity is cut at multiples of it, its last piece packed like any other.
    """
    groups = max(1, math.ceil(n_items / group_items))
    held = items.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce("n_tokens", F.lit(0)).cast("int").alias("n_tokens"),
        F.pmod(F.xxhash64("item_id", F.lit(7)), F.lit(groups)).cast("int").alias("grp"),
    )
    boxes = [tuple(r) for r in containers.select("container", "capacity_tokens").where("capacity_tokens > 0").limit(MAX_CONTAINERS + 1).collect()]
    if len(boxes) > MAX_CONTAINERS:
        raise ValueError(f"more than {MAX_CONTAINERS} kinds of container")
    if not boxes:
        boxes, held = [(None, 1)], held.limit(0)
    kinds = F.array(*[F.struct(F.lit(c).cast("string").alias("container"), F.lit(n).alias("capacity")) for c, n in boxes])
    return held.select("item_id", "n_tokens", "grp", F.inline(kinds)).groupBy("container", "grp").applyInPandas(
        _pack_group, "container string, grp int, bin int, item_id bigint, tok_start int, n_tokens int"
    )
