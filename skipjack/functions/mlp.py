"""Small ReLU networks: NumPy, Column, pandas UDF and SQL text forms, training and metrics."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this width the Column form stays within one generated method.
COLUMN_WIDTH = 8


@dataclass
class Mlp:
    """Layers (W, b); ReLU between layers, none after the last."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    features: list[str]
    classes: int = 0

    @property
    def width(self) -> int:
        return max(len(b) for _, b in self.layers[:-1])

    def forward(self, x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(self.layers):
            x = x @ w.T + b
            if k < len(self.layers) - 1:
                x = np.maximum(x, 0)
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = self.forward(x)
        return out.argmax(axis=1) if self.classes else out[:, 0]

    def outputs_sql(self) -> list[str]:
        """SQL text of each output, valid in Spark and DuckDB."""
        now = [f"({f})" for f in self.features]
        for k, (w, b) in enumerate(self.layers):
            now = ["(" + " + ".join([f"{float(c)!r} * {x}" for c, x in zip(row, now, strict=True) if c] + [f"{float(bias)!r}"]) + ")" for row, bias in zip(w, b, strict=True)]
            now = [x.replace("+ -", "- ") for x in now]
            if k < len(self.layers) - 1:
                now = [f"greatest(0.0, {x})" for x in now]
        return now

    def predict_sql(self) -> str:
        out = self.outputs_sql()
        if not self.classes:
            return out[0]
        best = out[-1]
        text = f"{len(out) - 1}"
        for k in range(len(out) - 2, -1, -1):  # the first of equal logits wins
            text = f"CASE WHEN {out[k]} >= {best} THEN {k} ELSE {text} END"
            best = f"greatest({out[k]}, {best})"
        return text

    def column(self) -> Column:
        """Column up to COLUMN_WIDTH, an Arrow UDF beyond; null features give null."""
        if self.width <= COLUMN_WIDTH:
            return F.expr(self.predict_sql())
        return self.udf()(*[F.expr(f).cast("double") for f in self.features])

    def udf(self):
        def run(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in cols])
            out = pd.Series(self.predict(x).astype(float))
            out[~np.isfinite(x).all(axis=1)] = np.nan
            return out

        return F.pandas_udf(run, "double")

    def matches(self, lo: float | None = None, hi: float | None = None, target: int | None = None) -> Column:
        """Rows whose prediction satisfies the predicate; rows with missing or non-finite features never do."""
        from skipjack.operators.rows import valid

        if self.classes:
            if target is None:
                raise ValueError("a classifier predicate needs a class")
            return valid(self.features) & (self.column() == target)
        if lo is None or hi is None:
            raise ValueError("a regressor predicate needs both bounds")
        return valid(self.features) & self.column().between(lo, hi)

    @classmethod
    def from_state(cls, state: dict[str, np.ndarray], features: list[str], classes: int = 0) -> Mlp:
        """From a state dictionary in layer order: two-dimensional entries are weights (outputs x inputs), the others biases."""
        weights = [np.asarray(v, float) for v in state.values() if np.ndim(v) == 2]
        biases = [np.asarray(v, float).ravel() for v in state.values() if np.ndim(v) == 1]
        if len(weights) != len(biases) or any(w.shape[0] != len(b) for w, b in zip(weights, biases, strict=True)):
            raise ValueError("weights and biases do not pair up")
        return cls(list(zip(weights, biases, strict=True)), features, classes)

    def to_json(self) -> str:
        return json.dumps({"layers": [[w.tolist(), b.tolist()] for w, b in self.layers], "features": self.features, "classes": self.classes})

    @classmethod
    def from_json(cls, text: str) -> Mlp:
        d = json.loads(text)
        return cls([(np.array(w, float), np.array(b, float)) for w, b in d["layers"]], d["features"], d["classes"])


def fold(layers, mean_x, std_x, mean_y=0.0, std_y=1.0):
    """Put the normalisation of inputs and output into the first and last layer."""
    w, b = layers[0]
    first = (w / std_x, b - (w / std_x) @ mean_x)
    layers = [first, *layers[1:]]
    w, b = layers[-1]
    return [*layers[:-1], (w * std_y, b * std_y + mean_y)]


def train(x: np.ndarray, y: np.ndarray, features: list[str], classes: int = 0, hidden: tuple[int, ...] = (32,), epochs: int = 120, rate: float = 0.01, batch: int = 512, seed: int = 123) -> tuple[Mlp, dict]:
    """Adam on an 80/20 split; returns the network with its normalisation folded in, and validation metrics."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = max(1, int(0.8 * len(x)))
    tr, va = order[:cut], order[cut:] if cut < len(x) else order
    mx, sx = x[tr].mean(0), np.where(x[tr].std(0) > 0, x[tr].std(0), 1.0)
    my, sy = (0.0, 1.0) if classes else (y[tr].mean(), y[tr].std() or 1.0)
    z, t = (x - mx) / sx, y if classes else (y - my) / sy
    sizes = [x.shape[1], *hidden, classes or 1]
    layers = [[rng.normal(0, np.sqrt(2 / a), (b, a)), np.zeros(b)] for a, b in zip(sizes, sizes[1:], strict=False)]
    flat = [p for layer in layers for p in layer]
    m, v, step = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], 0
    for _ in range(epochs):
        rows = rng.permutation(tr)
        for at in range(0, len(rows), batch):
            r = rows[at : at + batch]
            acts = [z[r]]
            for k, (w, b) in enumerate(layers):
                h = acts[-1] @ w.T + b
                acts.append(np.maximum(h, 0) if k < len(layers) - 1 else h)
            if classes:
                e = np.exp(acts[-1] - acts[-1].max(1, keepdims=True))
                g = e / e.sum(1, keepdims=True)
                g[np.arange(len(r)), t[r].astype(int)] -= 1
            else:
                g = 2 * (acts[-1] - t[r][:, None])
            g /= len(r)
            grads: list[np.ndarray] = []
            for k in range(len(layers) - 1, -1, -1):
                grads = [g.T @ acts[k], g.sum(0), *grads]
                g = (g @ layers[k][0]) * (acts[k] > 0)
            step += 1
            for i, (p, d) in enumerate(zip(flat, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                p -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Mlp(fold([tuple(x) for x in layers], mx, sx, my, sy), features, classes)
    return net, metrics(y[va], net.predict(x[va]), classes, None if classes else float(y[tr].mean()))


def metrics(y: np.ndarray, p: np.ndarray, classes: int = 0, baseline: float | None = None) -> dict:
    """Of predictions p; baseline: the constant to compare with (the training mean)."""
    if classes:
        return {"accuracy": float((y == p).mean())}
    rmse = float(np.sqrt(((y - p) ** 2).mean()))
    std, span = float(y.std()), float(y.max() - y.min())
    out = {"mae": float(np.abs(y - p).mean()), "rmse": rmse, "rmse_over_std": rmse / std if std else None, "rmse_over_range": rmse / span if span else None}
    if baseline is not None:
        plain = float(np.sqrt(((y - baseline) ** 2).mean()))
        out |= {"baseline_rmse": plain, "baseline_ratio": rmse / max(plain, 1e-6)}
    return out


def prediction_metrics(rows: DataFrame, prediction: str, target: str) -> DataFrame:
    """The same over a table, in one pass for the mean and one for the rest: mae, rmse, over std, over range, over the mean's rmse."""
    p, t = F.col(prediction), F.col(target)
    out = rows.agg(F.avg(F.abs(p - t)).alias("mae"), F.sqrt(F.avg((p - t) * (p - t))).alias("rmse"), F.stddev_pop(t).alias("std"), (F.max(t) - F.min(t)).alias("span"))
    # The mean predicts with an error of one standard deviation.
    return out.select("mae", "rmse", (F.col("rmse") / F.greatest("std", F.lit(1e-6))).alias("rmse_over_std"), (F.col("rmse") / F.greatest("span", F.lit(1e-6))).alias("rmse_over_range"))


def accuracy(rows: DataFrame, prediction: str, target: str) -> DataFrame:
    return rows.agg(F.avg((F.col(prediction) == F.col(target)).cast("double")).alias("accuracy"))
