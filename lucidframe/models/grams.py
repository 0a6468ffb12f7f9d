"""Linear families on Gram matrices: one scan makes the matrix, everything else is algebra on the driver, whose size is the model's.

A Gram matrix holds the products of the columns (1, x, y) summed over rows, about a shift that keeps them small. Matrices of folds add up, so
training on all folds but one is a subtraction, and errors on the held fold are a quadratic form: no configuration needs a scan of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidframe.models.sums import matrix, summed

#: Steps of a penalty path, and the last penalty as a share of the first.
PATH, LEAST = 80, 1e-3


@dataclass
class Gram:
    """Sums of products of (1, x - shift, y - shift's last)."""

    products: np.ndarray
    shift: np.ndarray

    @property
    def n(self) -> float:
        return float(self.products[0, 0])

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.products - other.products, self.shift)

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.products + other.products, self.shift)

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """Means (of x and y), and covariances times n."""
        mean = self.products[0, 1:] / self.n
        return mean + self.shift, self.products[1:, 1:] - self.n * np.outer(mean, mean)

    def squared_error(self, intercept: float, coefficients: np.ndarray) -> float:
        """The sum of squared errors of a linear score on the rows of this matrix."""
        x, y = self.shift[:-1], self.shift[-1]
        v = np.concatenate(([intercept + float(coefficients @ x) - y], coefficients, [-1.0]))
        return max(0.0, float(v @ self.products @ v))


def grams(df: DataFrame, x: Column, y: Column, fold: Column | None = None, make: Callable[[np.ndarray], np.ndarray] | None = None, weight: Column | None = None, shifted: bool = True) -> dict[int, Gram]:
    """The Gram matrix of each fold in one scan; make turns a batch of x into the columns to be multiplied."""
    columns = [x.alias("x"), y.cast("double").alias("y"), (F.lit(0) if fold is None else fold).cast("int").alias("fold"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w")]
    rows = df.select(*columns)
    first = rows.select("x", "y").first() if shifted else None
    if shifted and first is None:
        raise ValueError("there are no rows")
    made = make or (lambda a: a)
    shift = None if first is None else np.append(made(np.array([first["x"]], np.float64).reshape(1, -1))[0], first["y"])

    def part(batch):
        a = made(matrix(batch.column(0)).astype(np.float64) if batch.num_rows and len(batch.column(0)[0]) else np.zeros((batch.num_rows, 0)))
        z = np.column_stack((np.ones(len(a)), a, batch.column(1).to_numpy()))
        if shift is not None:
            z[:, 1:] -= shift
        own, w, out = batch.column(2).to_numpy(), batch.column(3).to_numpy(), {}
        for k in np.unique(own):
            rows = z[own == k]
            total = rows.T @ (rows * w[own == k][:, None])
            out.update({(int(k), i): total[i] for i in range(len(total))})  # a name for each row of the matrix: many tasks add them up
        return out

    found = summed(rows, part)
    out = {}
    for k in sorted({k for k, _ in found}):
        products = np.stack([found[k, i] for i in range(max(i for q, i in found if q == k) + 1)])
        out[k] = Gram((products + products.T) / 2, np.zeros(len(products) - 1) if shift is None else shift)
    return out


def least_squares(gram: Gram) -> tuple[float, np.ndarray]:
    """Intercept and coefficients; columns that others already express get zero."""
    mean, c = gram.centred()
    sd = np.sqrt(np.maximum(np.diag(c)[:-1], 0.0))
    kept: list[int] = []
    for j in range(len(sd)):  # in order, by what a column adds to those before it
        if sd[j] <= 1e-12 * max(1.0, abs(mean[j])) * np.sqrt(gram.n):
            continue
        if kept:
            a = c[np.ix_(kept, kept)] / np.outer(sd[kept], sd[kept])
            b = c[kept, j] / (sd[kept] * sd[j])
            if 1 - b @ np.linalg.solve(a, b) < 1e-10:
                continue
        kept.append(j)
    beta = np.zeros(len(sd))
    if kept:
        a = c[np.ix_(kept, kept)] / np.outer(sd[kept], sd[kept])
        beta[kept] = np.linalg.solve(a, c[kept, -1] / sd[kept]) / sd[kept]
    return float(mean[-1] - beta @ mean[:-1]), beta


# Elastic net


def penalties(gram: Gram, alpha: float, length: int = PATH) -> np.ndarray:
    """From the least penalty at which all coefficients are zero, down in equal ratios."""
    _, c = gram.centred()
    sd = np.sqrt(np.maximum(np.diag(c)[:-1], 0.0) / gram.n)
    top = float(np.max(np.abs(np.divide(c[:-1, -1], sd * gram.n, out=np.zeros(len(sd)), where=sd > 0)), initial=0.0)) / max(alpha, 1e-3)
    return top * LEAST ** (np.arange(length) / max(1, length - 1))


def elastic_net_path(gram: Gram, alpha: float, at: Sequence[float] | None = None, tolerance: float = 1e-12) -> list[tuple[float, float, np.ndarray]]:
    """(penalty, intercept, coefficients) along a path, of |y - a - xb|^2 / 2n + penalty * (alpha |b|_1 + (1 - alpha) / 2 |b|^2), b on scaled columns.

    Coordinate descent on covariances: a coefficient that moves changes the covariances of all columns with the residual, and nothing
    else; each penalty starts from the solution before it.
    """
    mean, c = gram.centred()
    n, sd = gram.n, np.sqrt(np.maximum(np.diag(c)[:-1], 0.0) / gram.n)
    live = np.flatnonzero(sd > 1e-12 * np.maximum(1.0, np.abs(mean[:-1])))
    xx = c[np.ix_(live, live)] / np.outer(sd[live], sd[live]) / n
    left = c[live, -1] / sd[live] / n  # covariances with the residual
    scale = float(np.sqrt(max(c[-1, -1], 0.0) / n)) or 1.0
    b, out = np.zeros(len(live)), []
    for penalty in penalties(gram, alpha) if at is None else at:
        bound, ridge = penalty * alpha, 1.0 + penalty * (1 - alpha)
        edge = bound * (1 + 1e-12)  # rounding moves nothing off zero
        active = range(len(live))
        for sweep in range(10_000):
            moved = 0.0
            for j in active:
                own = left[j] + b[j]
                new = 0.0 if abs(own) <= edge else np.sign(own) * (abs(own) - bound) / ridge
                if new != b[j]:
                    left -= xx[:, j] * (new - b[j])
                    moved = max(moved, abs(new - b[j]))
                    b[j] = new
            if moved <= tolerance * scale:
                if len(active) == len(live):
                    break
                active = range(len(live))  # the others must agree
            elif sweep:
                active = np.flatnonzero(b).tolist() or range(len(live))
        beta = np.zeros(len(sd))
        beta[live] = b / sd[live]
        out.append((float(penalty), float(mean[-1] - beta @ mean[:-1]), beta))
    return out


# Penalised splines

# Uniform B-splines of degrees 2 and 3 in powers of the place within a segment.
SEGMENT = {2: np.array([[1, 1, 0], [-2, 2, 0], [1, -2, 1]]) / 2.0, 3: np.array([[1, 4, 1, 0], [-3, 0, 3, 0], [3, -6, 3, 0], [-1, 3, -3, 1]]) / 6.0}


@dataclass(frozen=True)
class Smooth:
    """`k` B-splines on equal segments between two ends."""

    at: int  # the column of x
    k: int
    low: float
    high: float

    @property
    def degree(self) -> int:
        return 3 if self.k >= 4 else 2

    @property
    def segments(self) -> int:
        return self.k - self.degree

    def basis(self, x: np.ndarray) -> np.ndarray:
        u = (np.clip(x, self.low, self.high) - self.low) / (self.high - self.low) * self.segments
        segment = np.minimum(u.astype(int), self.segments - 1)
        powers = (u - segment)[:, None] ** np.arange(self.degree + 1)
        out = np.zeros((len(x), self.k))
        np.put_along_axis(out, segment[:, None] + np.arange(self.degree + 1), powers @ SEGMENT[self.degree], axis=1)
        return out

    def penalty(self) -> np.ndarray:
        d = np.diff(np.eye(self.k), 2, axis=0)
        return d.T @ d

    def expression(self, x: Column, weights: np.ndarray) -> Column:
        """The curve as a polynomial of each segment, straight beyond the ends."""
        inside = F.least(F.greatest(x, F.lit(self.low)), F.lit(self.high))
        u = (inside - self.low) * (self.segments / (self.high - self.low))
        segment = F.least(F.floor(u).cast("int"), F.lit(self.segments - 1))
        pieces = [SEGMENT[self.degree] @ weights[s : s + self.degree + 1] for s in range(self.segments)]
        power = lambda p: F.get(F.array(*[F.lit(float(c[p])) for c in pieces]), segment)
        t, total = u - segment, power(self.degree)
        for p in range(self.degree - 1, -1, -1):
            total = total * t + power(p)
        width = self.segments / (self.high - self.low)
        first, last = pieces[0][1] * width, float(np.arange(self.degree + 1) @ pieces[-1]) * width  # slopes at the ends
        return total + F.when(x < self.low, (x - self.low) * float(first)).when(x > self.high, (x - self.high) * last).otherwise(0.0)


def spline_columns(smooths: Sequence[Smooth], straight: Sequence[int]) -> Callable[[np.ndarray], np.ndarray]:
    """The columns of an additive model: the splines of each smooth term, then the straight columns."""
    return lambda x: np.column_stack([*[s.basis(x[:, s.at]) for s in smooths], x[:, list(straight)]])


@dataclass
class SplineFit:
    intercept: float
    weights: list[np.ndarray]  # of each smooth term's splines
    straight: np.ndarray
    freedom: list[float]  # effective degrees of each smooth term
    penalties: np.ndarray


def fit_splines(gram: Gram, smooths: Sequence[Smooth], straight: int, gamma: float, select: bool, start: np.ndarray | None = None, variance: float | None = None) -> SplineFit:
    """Penalised least squares whose penalties maximise the restricted likelihood, by fixed-point steps on one Gram matrix.

    Every term has a penalty on second differences, and with select one on its straight part, so that it can vanish. gamma
    above 1 counts as fewer rows and gives smoother curves. variance: that of the errors if it is known, as in Fisher scoring.
    """
    _, c = gram.centred()
    size = len(c) - 1
    # Within each term, directions in which its centred curve is nothing are left out.
    maps, at, shapes = [], 0, []
    for s in smooths:
        own = gram.products[0, 1 + at : 1 + at + s.k] / gram.n + gram.shift[at : at + s.k]
        q, _ = np.linalg.qr(np.column_stack((own, np.eye(s.k)[:, : s.k - 1])))
        z = q[:, 1:]
        block = np.zeros((size, s.k - 1))
        block[at : at + s.k] = z
        maps.append(block)
        p = z.T @ s.penalty() @ z
        value, vector = np.linalg.eigh(p)
        flat = value < 1e-8 * value.max()
        shapes.append([(p, int((~flat).sum()))] + ([(vector[:, flat] @ vector[:, flat].T, int(flat.sum()))] if select else []))
        at += s.k
    maps.append(np.eye(size)[:, at:])
    t = np.column_stack(maps)
    g, b = t.T @ c[:-1, :-1] @ t, t.T @ c[:-1, -1]
    g = g + 1e-9 * np.eye(len(g)) * max(1e-12, np.trace(g) / max(1, len(g)))
    parts, ranks, offset = [], [], 0
    for s, own in zip(smooths, shapes):
        for p, rank in own:
            full = np.zeros_like(g)
            full[offset : offset + s.k - 1, offset : offset + s.k - 1] = p
            parts.append(full)
            ranks.append(rank)
        offset += s.k - 1
    scale = [np.trace(g) / max(np.trace(p), 1e-12) / len(g) for p in parts]
    free = np.array(scale) if start is None else start
    for _ in range(300):
        v = np.linalg.inv(g + sum((x * p for x, p in zip(free, parts)), np.zeros_like(g)))
        beta = v @ b
        error = max(float(c[-1, -1] - 2 * beta @ b + beta @ g @ beta), 1e-12 * max(float(c[-1, -1]), 1e-300))
        used = float(np.trace(v @ g))
        noise = variance if variance is not None else error / max(gram.n - 1 - used, 1.0)
        new = np.array([x * min(1e3, max(1e-3, gamma * noise * max(rank / x - float(np.trace(v @ p)), 1e-12 * rank / x) / max(float(beta @ p @ beta), 1e-300))) for x, p, rank in zip(free, parts, ranks)])
        new = np.clip(new, 1e-7 * np.array(scale), 1e9 * np.array(scale))
        done = np.max(np.abs(np.log(new / free)), initial=0.0) < 1e-5
        free = new
        if done:
            break
    v = np.linalg.inv(g + sum((x * p for x, p in zip(free, parts)), np.zeros_like(g)))
    beta, influence = v @ b, np.diag(v @ g)
    full = t @ beta
    mean = gram.products[0, 1:] / gram.n + gram.shift
    weights, freedom, at, offset = [], [], 0, 0
    for s in smooths:
        weights.append(full[at : at + s.k])
        freedom.append(float(influence[offset : offset + s.k - 1].sum()))
        at, offset = at + s.k, offset + s.k - 1
    return SplineFit(float(mean[-1] - full @ mean[:-1]), weights, full[at:], freedom, free)
