"""Plot-ready frames; drawing them is left to the caller, but for the small inline charts of the HTML reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.operators.explain import Effect
from lucidframe.report.html import escape


def importance_bars(summary: DataFrame, top: int = 20) -> DataFrame:
    return summary.select("feature", "importance", "conf_low", "conf_high").orderBy(F.desc_nulls_last("importance"), "feature").limit(top)


def effect_lines(effects: list[Effect]) -> DataFrame:
    """Curves of several features, long: feature, method, x (text for categories), effect, support."""
    out = None
    for e in effects:
        part = e.frame.select(F.lit(e.feature).alias("feature"), F.lit(e.method).alias("method"), F.col("value").cast("string").alias("x"), "effect", "support")
        out = part if out is None else out.unionByName(part)
    return out


def aligned_curves(curves: DataFrame) -> DataFrame:
    return curves.select("model_id", "grid_index", "value", "effect", (F.col("support") >= 0.1).alias("supported")).orderBy("model_id", "grid_index")


def agreement_cells(agreement: dict) -> list[dict]:
    """Both halves of the rank-correlation matrix with its diagonal."""
    names = list(agreement["models"])
    known = agreement["pairs"] | {(b, a): v for (a, b), v in agreement["pairs"].items()} | {(m, m): 1.0 for m in names}
    return [{"model_a": a, "model_b": b, "correlation": known[a, b]} for a in names for b in names]


def tradeoff_points(tradeoffs: list[dict], loss: str, secondary: str) -> list[dict]:
    return [{"model_id": m["model_id"], "x": m[secondary], "y": m[loss], "pareto": m["pareto"]} for m in tradeoffs]


def scatter_svg(points: list[dict], x_label: str, y_label: str, width: int = 420, height: int = 260) -> str:
    """A small scatter of models, frontier points filled."""
    if not points:
        return ""
    pad = 40

    def scale(values, low, high):
        a, b = min(values), max(values)
        return [low + (high - low) * (0.5 if b == a else (v - a) / (b - a)) for v in values]

    xs, ys = scale([p["x"] for p in points], pad, width - pad), scale([p["y"] for p in points], height - pad, pad)
    dots = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="5" fill="{"#2266aa" if p["pareto"] else "none"}" stroke="#2266aa"><title>{escape(p["model_id"])}</title></circle><text x="{x + 7:.1f}" y="{y - 6:.1f}" font-size="11">{escape(p["model_id"])}</text>' for p, x, y in zip(points, xs, ys))
    return f'<svg role="img" aria-label="{escape(y_label)} against {escape(x_label)}" viewBox="0 0 {width} {height}">{dots}<text x="{width / 2}" y="{height - 8}" font-size="12">{escape(x_label)}</text><text x="6" y="16" font-size="12">{escape(y_label)}</text></svg>'


def line_svg(points: list[tuple[float, float]], label: str, width: int = 420, height: int = 200) -> str:
    if len(points) < 2:
        return ""
    pad, xs, ys = 20, [p[0] for p in points], [p[1] for p in points]
    sx, sy = (max(xs) - min(xs)) or 1.0, (max(ys) - min(ys)) or 1.0
    path = " ".join(f"{pad + (x - min(xs)) / sx * (width - 2 * pad):.1f},{height - pad - (y - min(ys)) / sy * (height - 2 * pad):.1f}" for x, y in points)
    return f'<svg role="img" aria-label="{escape(label)}" viewBox="0 0 {width} {height}"><polyline points="{path}" fill="none" stroke="#2266aa" stroke-width="2"/><text x="6" y="14" font-size="12">{escape(label)}</text></svg>'
