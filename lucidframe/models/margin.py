"""Radial margin machines on random Fourier features, with calibrated probabilities.

The features are cosines of random projections, whose products come near a radial kernel. Weights minimise half their squared length plus cost times the
loss: squared distances beyond epsilon for a standardised number, squared hinges for classes, one against the rest. Losses and gradients are summed
over blocks as in `neural`. Margins become probabilities by a sigmoid for each output, fitted on the margins of rows that were held out: each of
FOLDS machines is fitted without a part of the rows, which are dealt by numbers drawn for their block, so nothing depends on partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from lucidframe.contract import MULTICLASS, REGRESSION
from lucidframe.models.neural import Source, minimise, opened

#: Random features, inner folds of the calibration, passes at most and the gain that ends a search.
FEATURES, FOLDS, PASSES, GAIN = 200, 3, 200, 1e-8


@dataclass(frozen=True)
class Machine:
    """What a machine is but for its weights: the features' seed, and the outcome's centre and scale."""

    inputs: int
    outputs: int
    kind: str
    cost: float
    gamma: float
    epsilon: float
    seed: int
    centre: float = 0.0
    scale: float = 1.0

    @property
    def size(self) -> int:
        return (FEATURES + 1) * self.outputs

    def features(self, x: np.ndarray) -> np.ndarray:
        """1 and the random features."""
        rng = np.random.default_rng(self.seed)
        w, b = rng.standard_normal((FEATURES, self.inputs)) * np.sqrt(2 * self.gamma), rng.uniform(0, 2 * np.pi, FEATURES)
        return np.column_stack((np.ones(len(x)), np.sqrt(2 / FEATURES) * np.cos(x @ w.T + b)))

    def margins(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ w.reshape(FEATURES + 1, self.outputs)

    def signs(self, y: np.ndarray) -> np.ndarray:
        """1 for rows of an output's class, -1 for others."""
        return 2.0 * (y[:, None] == (np.arange(self.outputs)[None] if self.kind == MULTICLASS else 1)) - 1

    def loss(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Cost times the loss of some rows, and its gradient behind it."""
        z = self.features(x)
        f = z @ w.reshape(FEATURES + 1, self.outputs)
        if self.kind == REGRESSION:
            off = f - ((y - self.centre) / self.scale)[:, None]
            over = np.maximum(np.abs(off) - self.epsilon, 0.0)
            slope = 2 * over * np.sign(off)
        else:
            sign = self.signs(y)
            over = np.maximum(1 - sign * f, 0.0)
            slope = -2 * over * sign
        return self.cost * np.concatenate(([float(count @ (over**2).sum(axis=1))], (z.T @ (slope * count[:, None])).ravel()))

    def penalty(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Half the squared length of the weights but for the intercepts."""
        free = w.reshape(FEATURES + 1, self.outputs).copy()
        free[0] = 0.0
        return float((free**2).sum()) / 2, free.ravel()

    def predict(self, w: np.ndarray, sigmoid: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        f = self.margins(w, x)
        if self.kind == REGRESSION:
            return f[:, 0] * self.scale + self.centre
        p = 1 / (1 + np.exp(-np.clip(f * sigmoid[0] + sigmoid[1], -500, 500)))
        return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300) if self.kind == MULTICLASS else p[:, 0]


def _held_out(block: int, size: int, seed: int) -> np.ndarray:
    """The inner fold of each row of a block."""
    return np.random.default_rng([seed, block]).integers(0, FOLDS, size)


def _trained(source: Source, machine: Machine, without: int | None, start: np.ndarray) -> tuple[np.ndarray, int, bool]:
    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        def part(block, x, y, count):
            return machine.loss(w, x, y, count if without is None else count * (_held_out(block, len(y), machine.seed) != without))

        found, (value, slope) = source.sums(part, machine.size + 1), machine.penalty(w)
        return found[0] + value, found[1:] + slope

    w, _, passes, ended = minimise(objective, start, passes=PASSES, gain=GAIN)
    return w, passes, ended


def _sigmoids(source: Source, machine: Machine, by_fold: list[np.ndarray]) -> np.ndarray:
    """Slope and offset of each output's sigmoid, from held-out margins; outcomes are drawn in by one row of each class, so that they stay finite."""

    def counts(block, x, y, count):
        sign = machine.signs(y)
        return np.concatenate((count @ (sign > 0), count @ (sign < 0)))

    positive, negative = source.sums(counts, 2 * machine.outputs).reshape(2, -1)
    high, low = (positive + 1) / (positive + 2), 1 / (negative + 2)

    def objective(v: np.ndarray) -> tuple[float, np.ndarray]:
        a, b = v.reshape(2, -1)

        def part(block, x, y, count):
            own = _held_out(block, len(y), machine.seed)
            f = np.zeros((len(y), machine.outputs))
            for k, w in enumerate(by_fold):
                f[own == k] = machine.margins(w, x[own == k])
            t, s = np.where(machine.signs(y) > 0, high, low), f * a + b
            value = float(count @ (np.logaddexp(0, s) - t * s).sum(axis=1))
            d = (1 / (1 + np.exp(-np.clip(s, -500, 500))) - t) * count[:, None]
            return np.concatenate(([value], (d * f).sum(axis=0), d.sum(axis=0)))

        found = source.sums(part, 2 * machine.outputs + 1)
        return found[0], found[1:]

    return minimise(objective, np.concatenate((np.ones(machine.outputs), np.zeros(machine.outputs))), passes=100, gain=1e-10)[0].reshape(2, -1)


def fit(df: DataFrame, x: Column, y: Column, machine: Machine) -> tuple[np.ndarray, np.ndarray | None, dict]:
    """Weights, sigmoids of classes, and how the search went."""
    with opened(df, x, y, machine.inputs) as source:
        w, passes, ended = _trained(source, machine, None, np.zeros(machine.size))
        sigmoid = None
        if machine.kind != REGRESSION:
            parts = [_trained(source, machine, k, w) for k in range(FOLDS)]  # each starts from the machine of all rows
            sigmoid, passes = _sigmoids(source, machine, [p[0] for p in parts]), passes + sum(p[1] for p in parts)
    return w, sigmoid, {"passes": passes, "converged": ended}

