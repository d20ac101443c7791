"""A two-layer graph convolution in NumPy over edge lists (G-01 to G-14), trained for link prediction.

Runs inside one partition's group; matrices are row-major, adjacency is never dense.
"""

from __future__ import annotations

import hashlib
import io
from dataclasses import dataclass

import numpy as np

#: Rounds, learning rate, width bounds, blend of input and learned vector, least partition size.
EPOCHS, RATE, WIDTH_LO, WIDTH_HI, KEEP, LEARNED, LEAST_NODES = 24, 0.01, 16, 256, 0.6, 0.4, 128
_VERSION = 1


def relu(x: np.ndarray) -> np.ndarray:
    """G-01."""
    return np.maximum(x, 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """G-01, without overflow."""
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


@dataclass
class Graph:
    """G-09: distinct undirected edges with self loops and their symmetric weights (G-10), as an edge list."""

    n: int
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray
    pairs: np.ndarray

    @classmethod
    def build(cls, n: int, edges: np.ndarray) -> "Graph":
        e = np.asarray(edges, dtype=np.int64).reshape(-1, 2)
        e = e[e[:, 0] != e[:, 1]]
        pairs = np.unique(np.sort(e, axis=1), axis=0) if len(e) else e
        loop = np.arange(n)
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1], loop]), np.concatenate([pairs[:, 1], pairs[:, 0], loop])
        root = 1 / np.sqrt(np.bincount(src, minlength=n))
        return cls(n, src, dst, root[src] * root[dst], pairs)

    def spread(self, x: np.ndarray) -> np.ndarray:
        """G-12: the sparse product of the weights with ``x``; the weights are symmetric."""
        out = np.zeros_like(x)
        np.add.at(out, self.dst, self.weight[:, None] * x[self.src])
        return out

    def dense(self) -> np.ndarray:
        """G-10: for tests."""
        a = np.zeros((self.n, self.n))
        a[self.src, self.dst] = self.weight
        return a


class LayerNorm:
    """G-04."""

    def __init__(self, width: int):
        self.gain, self.shift = np.ones(width), np.zeros(width)

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.std = np.sqrt(x.var(1, keepdims=True) + 1e-5)
        self.unit = (x - x.mean(1, keepdims=True)) / self.std
        return self.unit * self.gain + self.shift

    def backward(self, g: np.ndarray) -> np.ndarray:
        self.d_gain, self.d_shift = (g * self.unit).sum(0), g.sum(0)
        u = g * self.gain
        return (u - u.mean(1, keepdims=True) - self.unit * (u * self.unit).mean(1, keepdims=True)) / self.std


class Adam:
    """G-06."""

    def __init__(self, rate: float = RATE):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, values: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            values[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


class Model:
    """G-02, G-03, G-07: dim to hidden with layer norm and ReLU, hidden to dim."""

    def __init__(self, dim: int, rng: np.random.Generator):
        hidden = int(np.clip(dim // 2, WIDTH_LO, WIDTH_HI))
        scale = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
        self.norm = LayerNorm(hidden)
        self.p = {"w1": scale(dim, hidden), "b1": np.zeros(hidden), "w2": scale(hidden, dim), "b2": np.zeros(dim), "gain": self.norm.gain, "shift": self.norm.shift}

    def forward(self, g: Graph, x: np.ndarray) -> np.ndarray:
        self.x1 = g.spread(x)
        self.n1 = self.norm.forward(self.x1 @ self.p["w1"] + self.p["b1"])
        self.x2 = g.spread(relu(self.n1))
        return self.x2 @ self.p["w2"] + self.p["b2"]

    def backward(self, g: Graph, d: np.ndarray) -> dict[str, np.ndarray]:
        grads = {"w2": self.x2.T @ d, "b2": d.sum(0)}
        up = self.norm.backward(g.spread(d @ self.p["w2"].T) * (self.n1 > 0))
        return grads | {"w1": self.x1.T @ up, "b1": up.sum(0), "gain": self.norm.d_gain, "shift": self.norm.d_shift}

    def to_bytes(self) -> bytes:
        """G-08."""
        out = io.BytesIO()
        np.savez(out, version=np.array(_VERSION), **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, dim: int) -> "Model":
        """G-08: refuses another version, missing or unknown parts, and other shapes."""
        model = cls(dim, np.random.default_rng(0))
        with np.load(io.BytesIO(data)) as z:
            if int(z["version"]) != _VERSION or set(z.files) != {"version", *model.p}:
                raise ValueError("weights of another version")
            for k, v in model.p.items():
                if z[k].shape != v.shape:
                    raise ValueError(f"weights {k} have another shape")
                v[...] = z[k]
        return model


def link_loss(h: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, np.ndarray]:
    """G-05: mean cross-entropy of sigmoid of dot products over linked and unlinked pairs, and its gradient."""
    pairs = np.concatenate([pos, neg])
    label = np.concatenate([np.ones(len(pos)), np.zeros(len(neg))])
    a, b = h[pairs[:, 0]], h[pairs[:, 1]]
    p = sigmoid((a * b).sum(1))
    eps = 1e-12
    loss = -np.mean(label * np.log(p + eps) + (1 - label) * np.log(1 - p + eps))
    d = ((p - label) / len(pairs))[:, None]
    grad = np.zeros_like(h)
    np.add.at(grad, pairs[:, 0], d * b)
    np.add.at(grad, pairs[:, 1], d * a)
    return float(loss), grad


def negatives(g: Graph, want: int, rng: np.random.Generator) -> np.ndarray:
    """G-13: distinct undirected pairs without an edge, within 30 tries each."""
    have = {(int(a), int(b)) for a, b in g.pairs}
    out: set[tuple[int, int]] = set()
    for _ in range(30 * want):
        if len(out) >= want:
            break
        a, b = sorted(rng.integers(0, g.n, 2).tolist())
        if a != b and (a, b) not in have:
            out.add((a, b))
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 2)


def propagate(ids: list[str], x: np.ndarray, edges: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, list[float], bytes]:
    """M-16, G-14: unit vectors 0.6 x + 0.4 h, the losses, the weights. Seeded by the ids, so it repeats.

    Rows that come out not finite or zero keep their input vector.
    """
    seed = int.from_bytes(hashlib.sha256("\n".join(ids).encode()).digest()[:8], "little")
    rng = np.random.default_rng(seed)
    g = Graph.build(len(ids), edges)
    model, adam, losses = Model(x.shape[1], rng), Adam(), []
    if len(g.pairs):
        for _ in range(epochs):
            h = model.forward(g, x)
            loss, d = link_loss(h, g.pairs, negatives(g, len(g.pairs), rng))
            losses.append(loss)
            adam.step(model.p, model.backward(g, d))
    h = model.forward(g, x)
    h = h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
    out = KEEP * x + LEARNED * h
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    good = np.isfinite(out).all(1) & (norm[:, 0] > 0)
    return np.where(good[:, None], out / np.where(norm > 0, norm, 1), x), losses, model.to_bytes()
