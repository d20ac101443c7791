"""S-10: embedding texts in batches, by an injected model or the hashed bag of words that tests use."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a hashed vector, and pauses between tries in seconds (fixed values).
HASHED_DIM, PAUSES = 384, (0.15, 0.3, 0.6)
_TOKEN = re.compile(r"[a-z0-9]+")


class Permanent(Exception):
    """A failure that trying again can't mend."""


@lru_cache(200_000)
def _place(token: str) -> tuple[int, float]:
    h = hashlib.blake2b(token.encode(), digest_size=8).digest()
    return int.from_bytes(h[:4], "little") % HASHED_DIM, 1.0 if h[4] & 1 else -1.0


def hashed(texts: list[str]) -> list[list[float]]:
    """Unit vectors of signed, hashed word counts; the zero vector for a text without words."""
    out = np.zeros((len(texts), HASHED_DIM), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in _TOKEN.findall(t.lower()):
            j, sign = _place(w)
            out[i, j] += sign
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(n > 0, n, 1)).tolist()


def embed_safely(texts: list[str], model: Callable[[list[str]], list], pauses: tuple[float, ...] = PAUSES) -> list:
    """Vectors of a batch; if the batch fails, one text at a time with tries again; None for what fails for good."""
    try:
        got = list(model(texts))
        if len(got) == len(texts):
            return got
    except Exception:  # noqa: BLE001 - any failure of the injected model
        pass
    out = []
    for t in texts:
        vector = None
        for pause in (*pauses, None):
            try:
                vector = list(model([t])[0])
                break
            except Permanent:
                break
            except Exception:  # noqa: BLE001
                if pause is None:
                    break
                time.sleep(pause)
        out.append(vector)
    return out


def embedded(rows: DataFrame, text: str = "text", model: Callable[[list[str]], list] | None = None) -> DataFrame:
    """``rows`` with a ``vector`` column and ``embed_failed``; null and empty texts have no vector and didn't fail."""
    use = model or hashed

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            asked = [i for i, t in enumerate(s) if t]
            got = embed_safely([s.iloc[i] for i in asked], use) if asked else []
            out = [None] * len(s)
            for i, v in zip(asked, got):
                out[i] = v
            yield pd.Series(out, index=s.index, dtype=object)

    return rows.withColumn("vector", run(F.col(text))).withColumn("embed_failed", (F.length(text) > 0) & F.col("vector").isNull())
