"""Support vector machines with a Gaussian kernel, and regression with an epsilon-insensitive loss.

The kernel is expanded into random Fourier features: cosines whose inner products approach it. A linear
machine on them is the kernel machine, and its training stays a sum over rows, where a kernel matrix would be the square of
the table. Features are made batch by batch with one matrix product.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from .blocks import blocks, total

COMPONENTS = 256  # cosines
SEED = 42


@dataclass
class FourierMap:
    """sqrt(2 / components) * cos(x W + b) of centred x: inner products approach exp(-gamma |x - y|^2)."""

    centre: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def rows(self, x: np.ndarray) -> np.ndarray:
        """In single precision once whole turns are taken off: cosines of doubles take several times as long."""
        turn = (x - self.centre) @ (self.weights * (0.5 / np.pi))
        turn += self.offset * (0.5 / np.pi)
        whole = np.rint(turn)
        turn -= whole
        turn *= 2.0 * np.pi
        small = turn.astype(np.float32)
        np.cos(small, out=small)
        np.multiply(small, np.sqrt(2.0 / len(self.offset)), out=turn)
        return turn

    def apply(self, df: DataFrame, column: str = "features") -> DataFrame:
        """``df`` with the vector replaced by its Fourier features."""
        own = self

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series(list(own.rows(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

        return df.withColumn(column, array_to_vector(mapped(vector_to_array(column))))


def scale_of(df: DataFrame, dims: int) -> tuple[np.ndarray, float]:
    """The means of the features, and the variance of all their values together."""
    x = vector_to_array("features")
    row = df.select(x.alias("x")).agg(*[f(F.get("x", F.lit(i))).alias(f"{t}{i}") for i in range(dims) for t, f in (("m", F.avg), ("v", F.var_pop))]).first()
    means = np.array([row[f"m{i}"] or 0.0 for i in range(dims)])
    spread = np.array([row[f"v{i}"] or 0.0 for i in range(dims)])
    return means, float((spread + means**2).mean() - means.mean() ** 2)


def fit_fourier(df: DataFrame, dims: int, gamma: Any = "scale", components: int = COMPONENTS, seed: int = SEED) -> FourierMap:
    """``gamma``: a number, ``scale`` (1 / (features * variance)) or ``auto`` (1 / features)."""
    means, variance = scale_of(df, dims)
    value = {"scale": 1.0 / (dims * variance) if variance > 0 else 1.0, "auto": 1.0 / dims}.get(gamma) if isinstance(gamma, str) else float(gamma)
    if value is None:
        raise ValueError(f"unknown gamma: {gamma!r}")
    rng = np.random.default_rng(seed)
    return FourierMap(means, rng.standard_normal((dims, components)) * np.sqrt(2.0 * value), rng.uniform(0.0, 2.0 * np.pi, components))


class KernelModel:
    """A linear model on Fourier features that reads the plain ones."""

    def __init__(self, fourier: FourierMap, inner: Any) -> None:
        self.fourier, self.inner = fourier, inner

    def transform(self, df: DataFrame) -> DataFrame:
        wide = self.fourier.apply(df.withColumn("__plain", F.col("features")))
        return self.inner.transform(wide).drop("features").withColumnRenamed("__plain", "features")


# fitting --------------------------------------------------------------------------------------------
class LinearRule:
    """prediction = x w + b."""

    def __init__(self, coefficients: np.ndarray, intercept: float) -> None:
        self.coefficients, self.intercept = Vectors.dense(coefficients), intercept

    def transform(self, df: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(float(v)) for v in self.coefficients.toArray()])
        total = F.aggregate(F.zip_with(vector_to_array("features"), w, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return df.withColumn("prediction", total + F.lit(float(self.intercept)))


def tube_loss(u: np.ndarray, epsilon: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """max(0, |u| - epsilon) with its corner rounded over ``width``, and its slope."""
    over = np.abs(u) - epsilon
    inside = np.clip(over, 0.0, width)
    loss = np.where(over > width, over - width / 2, inside * inside / (2 * width))
    return loss, np.sign(u) * inside / width


def hinge_loss(u: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """max(0, u) with its corner rounded over ``width``, and its slope."""
    inside = np.clip(u, 0.0, width)
    return np.where(u > width, u - width / 2, inside * inside / (2 * width)), inside / width


def fit_tube(df: DataFrame, dims: int, c: float = 1.0, epsilon: float = 0.1, fourier: FourierMap | None = None, max_iter: int = 300, tolerance: float = 1e-7) -> LinearRule:
    """The w and b that minimise |w|^2 / 2 + c * sum of max(0, |y - x w - b| - epsilon), on plain or Fourier features.

    Quasi-Newton steps (L-BFGS); loss and gradient are sums over the rows, made per task and added. The corner of the loss is
    rounded, first widely and then over a hundredth of epsilon (or of the spread of the labels, if smaller).
    """
    rows = blocks(df)
    moments = total(rows, dims, lambda _, x, y: np.array([len(y), y.sum()]), None, 2)
    n, mean = max(moments[0], 1), moments[1] / max(moments[0], 1)
    scale = float(np.sqrt(total(rows, dims, lambda mean, x, y: np.array([np.square(y - mean).sum()]), mean, 1)[0] / n)) or 1.0
    size = len(fourier.offset) if fourier else dims

    def look(state, x, y):
        w, width = state
        x = fourier.rows(x) if fourier else x
        loss, slope = tube_loss(y - x @ w[:-1] - w[-1], epsilon, width)
        return np.concatenate([[loss.sum()], -(slope @ x), [-slope.sum()]])

    def value(w: np.ndarray, width: float) -> tuple[float, np.ndarray]:
        found = total(rows, dims, look, (w, width), size + 2)
        own = np.concatenate([w[:-1], [0.0]])
        return float(own @ own / 2 + c * found[0]) / n, (own + c * found[1:]) / n

    w = np.zeros(size + 1)
    w[-1] = mean
    last = min(epsilon or scale, scale) / 100
    for width in dict.fromkeys([max(scale, last), max(scale / 10, last), last]):
        w = _descend(lambda v, h=width: value(v, h), w, max_iter, tolerance)
    return LinearRule(w[:-1], float(w[-1]))


def _descend(value, w: np.ndarray, max_iter: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """L-BFGS with halving steps."""
    f, g = value(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(g).max(initial=0.0) <= tolerance * max(1.0, abs(f)):
            break
        d, kept = -g, []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d = d - a * y
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(kept)):
            d = d + s * (a - (y @ d) / (s @ y))
        slope, t = g @ d, 1.0 if steps else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-300))
        if slope >= 0:
            d, slope, steps = -g, -(g @ g), []
        for _ in range(30):
            new_f, new_g = value(w + t * d)
            if new_f <= f + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = t * d, new_g - g
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            steps = [*steps[-(memory - 1) :], (s, y)]
        done = f - new_f <= 1e-10 * max(1.0, abs(f))
        w, f, g = w + t * d, new_f, new_g
        if done:
            break
    return w


HINGE_WIDTHS = (1.0, 0.1, 0.01)  # the steps are shared out among them


class MarginModel:
    """A support vector machine on Fourier features that reads the plain ones: one margin for two classes, else one per class."""

    def __init__(self, fourier: FourierMap, weights: np.ndarray) -> None:
        self.fourier, self.weights = fourier, weights  # [margins, components + 1]

    def transform(self, df: DataFrame) -> DataFrame:
        fourier, weights = self.fourier, self.weights

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            said = fourier.rows(np.stack(x.to_numpy())) @ weights[:, :-1].T + weights[:, -1] if len(x) else np.zeros((0, 1))
            return pd.Series(list(np.append(-said, said, axis=1) if len(weights) == 1 else said))

        out = df.withColumn("rawPrediction", array_to_vector(margins(vector_to_array("features"))))
        raw = vector_to_array("rawPrediction")
        chosen = (raw[1] > 0).cast("double") if len(weights) == 1 else (F.array_position(raw, F.array_max(raw)) - 1).cast("double")
        return out.withColumn("prediction", chosen)


def fit_margins(df: DataFrame, dims: int, n_classes: int, c: float, fourier: FourierMap, max_iter: int = 100) -> MarginModel:
    """Hinge loss, one class against the others. As in MLlib's machine, features are scaled
    by their spread before weights are counted. The Fourier features are made block by block and never kept: they would be as many
    numbers per row as there are cosines.
    """
    rows = blocks(df)
    size = len(fourier.offset)

    def moments(_, x, y):
        z = fourier.rows(x)
        return np.concatenate([[len(z)], z.sum(axis=0), np.square(z).sum(axis=0)])

    found = total(rows, dims, moments, None, 1 + 2 * size)
    n, mean = max(found[0], 1), found[1 : 1 + size] / max(found[0], 1)
    spread = np.sqrt(np.maximum(found[1 + size :] / n - mean * mean, 0.0) * n / max(n - 1, 1))
    scale = np.where(spread > 0, 1.0 / np.where(spread > 0, spread, 1.0), 0.0)

    def look(state, x, y):
        plain, b, own, width = state
        x, side = fourier.rows(x), np.where(y == own, 1.0, -1.0)
        loss, slope = hinge_loss(1.0 - side * (x @ plain + b), width)
        slope *= -side
        return np.concatenate([[loss.sum()], slope @ x, [slope.sum()]])

    def value(w: np.ndarray, own: float, width: float) -> tuple[float, np.ndarray]:
        plain = w[:-1] * scale
        got = total(rows, dims, look, (plain, w[-1] - plain @ mean, own, width), size + 2)
        slope, every = got[1:-1], got[-1]
        weight = np.append(w[:-1], 0.0) / (c * n)
        return float(got[0] / n + weight @ w / 2), np.append((slope - every * mean) * scale, every) / n + weight

    out = []
    for own in [1.0] if n_classes <= 2 else map(float, range(n_classes)):
        w = np.zeros(size + 1)
        for i, width in enumerate(HINGE_WIDTHS):
            w = _descend(lambda v, h=width: value(v, own, h), w, max(1, max_iter // len(HINGE_WIDTHS)), 1e-6)
        plain = w[:-1] * scale
        out.append(np.append(plain, w[-1] - plain @ mean))
    return MarginModel(fourier, np.array(out))


class TubeModel:
    """Epsilon-insensitive regression on Fourier features, reading the plain ones."""

    def __init__(self, fourier: FourierMap, rule: LinearRule) -> None:
        self.fourier, self.rule = fourier, rule

    def transform(self, df: DataFrame) -> DataFrame:
        own, w, b = self.fourier, self.rule.coefficients.toArray(), self.rule.intercept

        @F.pandas_udf("double")
        def said(x: pd.Series) -> pd.Series:
            return pd.Series(own.rows(np.stack(x.to_numpy())) @ w + b) if len(x) else pd.Series([], dtype=float)

        return df.withColumn("prediction", said(vector_to_array("features")))


KERNELS: Sequence[str] = ("linear", "rbf")


def fit_support_regression(df: DataFrame, dims: int, params: dict[str, Any]) -> LinearRule | TubeModel:
    """``kernel`` rbf (default) or linear, ``C``, ``epsilon``, ``gamma``, ``n_components``."""
    kernel = params.get("kernel", "rbf")
    if kernel not in KERNELS:
        raise ValueError(f"kernel must be one of {tuple(KERNELS)}")
    c, epsilon, most = float(params.get("C", 1.0)), float(params.get("epsilon", 0.1)), int(params.get("max_iter", 300))
    if kernel == "linear":
        return fit_tube(df, dims, c, epsilon, None, most)
    fourier = fit_fourier(df, dims, params.get("gamma", "scale"), int(params.get("n_components", COMPONENTS)), int(params.get("random_state", SEED)))
    return TubeModel(fourier, fit_tube(df, dims, c, epsilon, fourier, most))
