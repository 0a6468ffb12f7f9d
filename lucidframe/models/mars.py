"""Multivariate adaptive regression splines: products of hinges, chosen forward and pruned backward.

A forward step tries every hinge pair (x - t)+ and (t - x)+ of every column and knot, multiplied by every term there is. One scan serves a step: within the
intervals between a column's knots it sums products of terms, once plain and once times x, and running sums over the intervals turn these into the
inner products of every hinge with every term, so no column is ever made for a candidate. The arrays that the scan sends depend
on terms, columns and knots, not on rows. Pruning is algebra on the Gram matrix that these steps leave.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidframe.models.sums import matrix, summed

#: Candidate knots of a column; gain in share of the outcome's variation below which the forward pass ends.
KNOTS, LEAST_GAIN = 40, 1e-3

#: A factor of a term: column, knot, sign (1 right of the knot, -1 left of it).
Factor = tuple[int, float, int]


def columns_of(x: np.ndarray, terms: list[tuple[Factor, ...]]) -> np.ndarray:
    """The terms as columns; the empty one is 1."""
    out = np.ones((len(x), len(terms)))
    for j, term in enumerate(terms):
        for v, knot, sign in term:
            out[:, j] *= np.maximum(sign * (x[:, v] - knot), 0.0)
    return out


def expression(term: tuple[Factor, ...], columns: list[Column]) -> Column:
    out = F.lit(1.0)
    for v, knot, sign in term:
        out = out * F.greatest((columns[v] - F.lit(float(knot))) * sign, F.lit(0.0))
    return out


@dataclass
class Forward:
    """The terms of a forward pass and their Gram matrix, the outcome last; scans: passes over the rows."""

    terms: list[tuple[Factor, ...]]
    gram: np.ndarray
    scans: int = 0
    rss: list[float] = field(default_factory=list)


def _interval_sums(knots: list[np.ndarray], terms: list[tuple[Factor, ...]], pairs: list[tuple[int, int]], shift: float):
    """For each (parent, column): of each interval between knots, the sums of parent * (term, y), the same times x, and parent^2 * (1, x, x^2)."""

    def part(batch):
        x, y = matrix(batch.column(0)), batch.column(1).to_numpy() - shift
        b = columns_of(x, terms)
        every = np.column_stack((b, y))
        out, sorted_ = {}, {}
        for v in {v for _, v in pairs}:
            place = np.searchsorted(knots[v], x[:, v], side="left")  # interval i lies right of i knots
            order = np.argsort(place, kind="stable")
            starts = np.searchsorted(place[order], np.arange(len(knots[v]) + 1))
            sorted_[v] = order, starts
        for i, (m, v) in enumerate(pairs):
            order, starts = sorted_[v]
            own, at = b[order, m], x[order, v]
            a = every[order] * own[:, None]
            all_ = np.column_stack((a, a * at[:, None], own * own * at * at))
            # Running sums cut at the intervals' starts: an interval without rows gets zero.
            total = np.vstack((np.zeros(all_.shape[1]), np.cumsum(all_, axis=0)))
            out[0, i] = np.diff(total[np.append(starts, len(at))], axis=0).ravel()
        return out

    return part


def forward(rows: DataFrame, knots: list[np.ndarray], degree: int, most: int) -> Forward:
    """The forward pass over (x, y) rows, x an array on a unit scale; a column's knots are in rising order, a column with one knot is taken as it is."""
    n, mean, var = rows.agg(F.count(F.lit(1)), F.avg("y"), F.var_pop("y")).first()
    total = max(var * n, 1e-300)
    terms: list[tuple[Factor, ...]] = [()]
    gram = np.array([[n, 0.0], [0.0, total]])  # about the outcome's mean
    found = Forward(terms, gram, 1, [total])
    while len(terms) + 1 <= most:
        pairs = [(m, v) for m, t in enumerate(terms) if len(t) < degree for v in range(len(knots)) if len(knots[v]) and v not in {f[0] for f in t}]
        if not pairs:
            break
        sums = summed(rows, _interval_sums(knots, terms, pairs, mean))
        found.scans += 1
        width = len(terms) + 1
        a, b = gram[:-1, :-1], gram[:-1, -1]
        scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
        solve = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-10) / np.outer(scale, scale)
        rss = float(gram[-1, -1] - b @ solve @ b)
        best = (0.0, None)
        for i, (m, v) in enumerate(pairs):
            table = sums[0, i].reshape(len(knots[v]) + 1, 2 * width + 1)
            above = np.cumsum(table[::-1], axis=0)[::-1][1:]  # right of each knot
            below = np.cumsum(table, axis=0)[:-1]
            t = knots[v][:, None]
            right = above[:, width : 2 * width] - t * above[:, :width]  # products of (x - t)+ * parent with terms and outcome
            left = t * below[:, :width] - below[:, width : 2 * width]
            square = lambda s: s[:, -1] - 2 * t[:, 0] * s[:, width + m] + t[:, 0] ** 2 * s[:, m]  # noqa: B023, E731
            gr, gl, qr, ql = right[:, :-1], left[:, :-1], square(above), square(below)
            # What is left of the two columns when the terms have been taken out of them.
            kr, kl = qr - np.einsum("ij,jk,ik->i", gr, solve, gr), ql - np.einsum("ij,jk,ik->i", gl, solve, gl)
            krl = -np.einsum("ij,jk,ik->i", gr, solve, gl)
            cr, cl = right[:, -1] - gr @ (solve @ b), left[:, -1] - gl @ (solve @ b)
            good_r, good_l = kr > 1e-7 * np.maximum(qr, 1e-300), kl > 1e-7 * np.maximum(ql, 1e-300)
            one_r = np.where(good_r, cr * cr / np.where(good_r, kr, 1), 0.0)
            one_l = np.where(good_l, cl * cl / np.where(good_l, kl, 1), 0.0)
            det = kr * kl - krl * krl
            both_ok = good_r & good_l & (det > 1e-7 * kr * kl)
            two = np.where(both_ok, (cr * cr * kl - 2 * cr * cl * krl + cl * cl * kr) / np.where(both_ok, det, 1), 0.0)
            for gain, signs in ((one_r, (1,)), (one_l, (-1,)), (two if len(terms) + 2 <= most else np.zeros(len(t)), (1, -1))):
                k = int(np.argmax(gain))
                # A pair must beat a single hinge by more than rounding.
                if gain[k] > best[0] * (1 + 1e-9) + 1e-12 * total:
                    columns = [(gr[k], qr[k], right[k, -1]) if s == 1 else (gl[k], ql[k], left[k, -1]) for s in signs]
                    best = (float(gain[k]), (m, v, float(knots[v][k]), signs, columns))
        if best[1] is None or best[0] < LEAST_GAIN * total:
            break
        m, v, knot, signs, columns = best[1]
        for s, (products, square_, outcome) in zip(signs, columns):
            terms.append((*terms[m], (v, knot, s)))
            old = len(gram) - 1
            wide = np.zeros((old + 2, old + 2))
            wide[np.ix_([*range(old), old + 1], [*range(old), old + 1])] = gram
            wide[old, : len(products)] = wide[: len(products), old] = products
            wide[old, old] = square_
            wide[old, -1] = wide[-1, old] = outcome  # the two hinges of a pair have no rows in common: their product stays 0
            gram = wide
        found.gram = gram
        found.rss.append(max(rss - best[0], 0.0))
        if rss - best[0] <= 1e-9 * total:
            break
    return found


def error_of(gram: np.ndarray, chosen: list[int]) -> tuple[float, np.ndarray]:
    """The squared error left by some terms, and their coefficients."""
    a, b = gram[np.ix_(chosen, chosen)], gram[chosen, -1]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    beta = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-10) @ (b / scale) / scale
    return max(float(gram[-1, -1] - beta @ b), 0.0), beta


def prune(found: Forward, most: int, degree: int) -> tuple[list[int], np.ndarray]:
    """The terms that stay, at most `most`, and their coefficients: the least generalised error on the way of leaving out the least useful one."""
    n, per_knot = found.gram[0, 0], 3.0 if degree > 1 else 2.0

    def generalised(chosen: list[int]) -> float:
        used = len(chosen) + per_knot * (len(chosen) - 1) / 2
        return np.inf if used >= n else error_of(found.gram, chosen)[0] / n / (1 - used / n) ** 2

    chosen, best = list(range(len(found.terms))), None
    while True:
        if len(chosen) <= most and (best is None or generalised(chosen) <= generalised(best)):
            best = list(chosen)
        if len(chosen) == 1:
            break
        chosen = min(([c for c in chosen if c != d] for d in chosen if d), key=lambda c: error_of(found.gram, c)[0])
    return best, error_of(found.gram, best)[1]
