"""Small feed-forward networks trained where the rows are.

In every round each task adds up the gradient over its own rows; one array of the size of the
network per task reaches the driver, which takes the step.  The loss is a callback, so the same
training serves weighted classes, masked regressions and several phases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A loss takes the outputs (rows, width) and the rows' frame; it gives the summed loss and its gradient by output.
Loss = Callable[[np.ndarray, pd.DataFrame], tuple[float, np.ndarray]]
Layers = list[tuple[np.ndarray, np.ndarray]]


def fresh(sizes: Sequence[int], seed: int = 42) -> Layers:
    """Layers of a network with normal weights scaled by their inputs."""
    draw = np.random.default_rng(seed)
    return [(draw.normal(0, np.sqrt(2.0 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """The values of all layers, rectified but for the last."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.maximum(z, 0.0) if i + 1 < len(layers) else z)
    return out


def backward(layers: Layers, values: list[np.ndarray], grad: np.ndarray) -> np.ndarray:
    """The gradient of all weights, flat, from that of the outputs."""
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(values[i].T @ grad).ravel(), grad.sum(axis=0), *parts]
        if i:
            grad = (grad @ layers[i][0].T) * (values[i] > 0)
    return np.concatenate(parts)


def _flat(layers: Layers) -> np.ndarray:
    return np.concatenate([p.ravel() for w, b in layers for p in (w, b)])


def _shaped(flat: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for w, b in like:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    """Chances of the classes in each row."""
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def class_loss(weights: Sequence[float], target: str = "target", row_weight: str | None = None) -> Loss:
    """Cross entropy with a weight for each class, and for each row if a column names it."""
    w = np.asarray(weights, dtype=float)

    def loss(out: np.ndarray, frame: pd.DataFrame) -> tuple[float, np.ndarray]:
        y = frame[target].to_numpy(dtype=np.int64)
        own = w[y] * (frame[row_weight].to_numpy(dtype=float) if row_weight else 1.0)
        p = softmax(out)
        value = float(-(own * np.log(np.maximum(p[np.arange(len(y)), y], 1e-12))).sum())
        p[np.arange(len(y)), y] -= 1
        return value, p * own[:, None]

    return loss


def choice_and_budget_loss(models: int, target: str, budgets: str, row_weight: str | None = None, share: float = 0.1) -> Loss:
    """Cross entropy over models plus the squared error of a budget per model, where one is known.

    ``budgets`` names a column of arrays with NaN where no budget of a model was right; ``target`` is
    negative where no model was, and such rows teach budgets alone.
    """
    def loss(out: np.ndarray, frame: pd.DataFrame) -> tuple[float, np.ndarray]:
        y = frame[target].to_numpy(dtype=np.int64)
        own = frame[row_weight].to_numpy(dtype=float) if row_weight else np.ones(len(y))
        known = y >= 0
        p = softmax(out[:, :models])
        at = np.where(known, y, 0)
        value = float(-(own * known * np.log(np.maximum(p[np.arange(len(y)), at], 1e-12))).sum())
        p[np.arange(len(y)), at] -= 1
        want = np.stack(frame[budgets].to_numpy()).astype(float)
        off = np.where(np.isnan(want), 0.0, out[:, models:] - np.nan_to_num(want))
        return value + share * float((own[:, None] * off * off).sum()), np.concatenate([p * (own * known)[:, None], 2 * share * own[:, None] * off], axis=1)

    return loss


def train(rows: DataFrame, features: str, layers: Layers, loss: Loss, rounds: int = 40, rate: float = 0.02) -> Layers:
    """Layers after ``rounds`` steps of Adam over all rows; as given where there are none.

    ``rows`` should be written or cheap to read, as each round reads them once.
    """
    flat = _flat(layers)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, rounds + 1):
        now = _shaped(flat, layers)

        def add(frames: Iterator[pd.DataFrame], now: Layers = now) -> Iterator[pd.DataFrame]:
            grad, value, n = np.zeros(sum(w.size + b.size for w, b in now)), 0.0, 0
            for frame in frames:
                if len(frame):
                    values = forward(now, np.stack(frame[features].to_numpy()).astype(float))
                    part, by_out = loss(values[-1], frame)
                    grad, value, n = grad + backward(now, values, by_out), value + part, n + len(frame)
            yield pd.DataFrame({"grad": [grad], "value": [value], "n": [n]})

        got = rows.mapInPandas(add, "grad array<double>, value double, n long").collect()
        n = sum(r["n"] for r in got)
        if not n:
            return layers
        grad = np.sum([np.array(r["grad"]) for r in got], axis=0) / n
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        flat = flat - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return _shaped(flat, layers)


def apply(rows: DataFrame, features: str, layers: Layers, name: str = "out") -> DataFrame:
    """``rows`` with the network's outputs as an array."""
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(forward(layers, np.stack(x.to_numpy()).astype(float))[-1])) if len(x) else pd.Series([], dtype=object)

    return rows.withColumn(name, run(features))
