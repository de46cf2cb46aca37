"""Hashed byte n-gram features of whole texts, and linear models over them.

A text's features are the frequencies of its hashed byte n-grams, so a linear model's value is the mean of its weights over the
text's positions: scoring needs one look-up per position and model, never a vector per text.
"""

from __future__ import annotations

import numpy as np

PAD = b"  "


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each lower-cased and padded on both sides, so that no n-gram holds letters of two texts; and where
    each text starts, with the end.
    """
    parts = [PAD + t.lower().encode("utf-8", "replace").replace(b"\n", b" ") + PAD for t in texts]
    ends = np.cumsum([0, *map(len, parts)])
    return np.frombuffer(b"".join(parts) + PAD, dtype=np.uint8), ends


def slots(data: np.ndarray, n: int, dims: int) -> np.ndarray:
    """The feature of the n-gram that starts at each byte (but for the last pad)."""
    code = np.full(len(data) - len(PAD), n, dtype=np.uint32)
    for i in range(n):
        code = code * np.uint32(257) + data[i : len(data) - len(PAD) + i]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - (dims.bit_length() - 1))


def frequencies(texts: list[str], dims: int, orders: tuple[int, ...], out: np.ndarray | None = None) -> np.ndarray:
    """One dense row per text, in ``out`` (zeros) if given; for bounded training samples."""
    data, ends = joined(texts)
    out = np.zeros((len(texts), dims), dtype=np.float32) if out is None else out
    for n in orders:
        s = slots(data, n, dims)
        for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            out[i] += np.bincount(s[a:b], minlength=dims) / (b - a)
    return out


def mean_weights(texts: list[str], weights: np.ndarray, orders: tuple[int, ...]) -> np.ndarray:
    """texts x models: frequencies(texts) @ weights, for weights of dims x models."""
    data, ends = joined(texts)
    dims, models = weights.shape
    out = np.zeros((len(texts), models))
    for n in orders:
        s = slots(data, n, dims)
        for m in range(models):
            out[:, m] += np.add.reduceat(weights[:, m][s], ends[:-1], dtype=np.float64)
    return out / np.diff(ends)[:, None]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression, by AdaGrad over the whole sample; classes weigh the same."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    return _descend(x, lambda z: (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share, penalty, steps, rate)


def svm(x: np.ndarray, sign: np.ndarray, penalty: float = 1e-4, steps: int = 200, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear support vector machine (hinge loss) for signs +1 and -1; classes weigh the same."""
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    return _descend(x, lambda z: np.where(sign * z < 1, -sign * share, 0.0), penalty, steps, rate)


def _descend(x, slope, penalty, steps, rate):
    w, b = np.zeros(x.shape[1], dtype=np.float64), 0.0
    seen_w, seen_b = np.full_like(w, 1e-12), 1e-12
    for _ in range(steps):
        g = slope(x @ w.astype(np.float32) + b)
        gw, gb = x.T @ g.astype(np.float32) + penalty * w, float(g.sum())
        seen_w += gw**2
        seen_b += gb**2
        w -= rate * gw / np.sqrt(seen_w)
        b -= 0.1 * rate * gb / np.sqrt(seen_b)
    return w, b


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
