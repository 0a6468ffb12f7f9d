"""Standalone HTML reports from collected aggregates."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

from lucidframe.contract import REGRESSION
from lucidframe.operators import explain
from lucidframe.operators.audit import audit_explanations
from lucidframe.sources.tables import write_text

STYLE = "body{font:16px/1.5 system-ui,sans-serif;max-width:62rem;margin:2rem auto;padding:0 1rem;color:#1b1f24}table{border-collapse:collapse;width:100%}th,td{border-bottom:1px solid #d0d7de;padding:.3rem .6rem;text-align:left}section{margin:2.5rem 0}.note{background:#f6f8fa;padding:.6rem 1rem;border-left:4px solid #2266aa}svg{max-width:100%}"
SCREEN, AUDIT_FEATURES, EFFECTS, POINTS = 5, 8, 3, 16


def escape(x) -> str:
    return html.escape(str(x), quote=True).replace("&#x27;", "&#39;")


def _cell(x) -> str:
    if x is None or isinstance(x, float) and x != x:
        return "–"
    return f"{x:.4g}" if isinstance(x, float) else escape(x)


def table(rows: Sequence[dict], columns: Sequence[str] | None = None) -> str:
    if not rows:
        return "<p>None.</p>"
    columns = list(columns or rows[0])
    head = "".join(f'<th scope="col">{escape(c)}</th>' for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(r.get(c))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def section(name: str, title: str, *parts: str) -> str:
    return f'<section id="{escape(name)}" aria-labelledby="{escape(name)}-title"><h2 id="{escape(name)}-title">{escape(title)}</h2>{"".join(parts)}</section>'


def page(title: str, *sections: str) -> str:
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{"".join(sections)}</body></html>'


def markdown(text: str) -> str:
    """The memo's small markdown: headings, lists, bold, code; everything else escaped."""
    out, inside = [], False
    for line in text.split("\n"):
        shown = re.sub(r"`([^`]+)`", r"<code>\1</code>", re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", escape(line)))
        item = line.startswith("- ")
        if inside and not item:
            out.append("</ul>")
        if item and not inside:
            out.append("<ul>")
        inside = item
        if item:
            out.append(f"<li>{shown[2:]}</li>")
        elif line.startswith("## "):
            out.append(f"<h4>{shown[3:]}</h4>")
        elif line.startswith("# "):
            out.append(f"<h3>{shown[2:]}</h3>")
        elif line.strip():
            out.append(f"<p>{shown}</p>")
    return "".join(out) + ("</ul>" if inside else "")


def findings_html(rows: Sequence[dict]) -> str:
    return "".join(f'<div class="note"><strong>{escape(f["severity"])}: {escape(f["code"])}</strong><p>{escape(f["message"])} {escape(f.get("evidence", ""))}</p><p>{escape(f["recommendation"])}</p></div>' for f in rows) or "<p>None.</p>"


def report_data(result, top: int = AUDIT_FEATURES, repeats: int = 20, max_models: int = 5) -> dict:
    """A screening of few repeats picks the features; the audit then takes the full number; effects for the first few."""
    explainers = result.explainers()[:max_models]
    main = explainers[0]
    metric = {"rmse": "rmse", "log_loss": "logloss"}[result.task.primary]
    screen = explain.permutation_importance(main.data, main.predict, main.task, metric, main.features, min(SCREEN, repeats)).collect()
    chosen = [r["feature"] for r in screen][:top]
    audit = audit_explanations(explainers, chosen, metric, repeats)
    numbers = [f for f in chosen if explain._is_number(main.data, f)][:EFFECTS]
    effects = [explain.explain_effect(main.data, main.predict, main.task, f, points=POINTS) for f in numbers]
    return {"audit": audit, "effects": [{"feature": e.feature, "method": e.method, "rows": [r.asDict() for r in e.frame.collect()]} for e in effects]}


def model_report_html(result, data: dict | None = None, memo: str | None = None) -> str:
    from lucidframe.report.narrative import DISCLOSURE, LIMITS
    from lucidframe.report.plots import line_svg, scatter_svg, tradeoff_points

    board = [r.asDict() for r in result.leaderboard.collect()]
    parts = [section("overview", "Task and target", f"<p>A {escape(result.task.kind)} task: predict <code>{escape(result.task.target)}</code> from {len(result.model().features)} features. {escape(result.role)} rows were scored once, after fitting.</p>")]
    parts.append(section("evaluation", "Scores on the held rows", table(board, [c for c in board[0] if c != "winner"]), findings_html(result.notes)))
    if result.task.kind != REGRESSION:
        parts.append(section("calibration", "Calibration by group", table([r.asDict() for r in result.calibration().collect()])))
    if result.tuning:
        rows = [{k: c[k] for k in ("configuration_id", "hyperparameters", "cv_score", "cv_se", "complexity_proxy")} for c in sorted(result.tuning.candidates, key=lambda c: (c["cv_score"] is None, c["cv_score"] or 0))]
        parts.append(section("tuning", "The search and its choice", f"<p>By {escape(result.tuning.metric)} on {result.tuning.folds} folds of the training rows; {escape(result.tuning.rule)} selected {escape(result.tuning.selected)}.</p>", table(rows)))
    try:
        trade = result.tradeoffs(include_baseline=True)
        parts.append(section("models", "Loss against complexity", scatter_svg(tradeoff_points(trade, result.task.primary, "complexity"), "complexity", result.task.primary), table(trade, ["model_id", "family", result.task.primary, "complexity", "pareto"])))
    except ValueError:
        pass
    if data:
        curves = "".join(line_svg([(r["value"], r["effect"]) for r in e["rows"]], f"{e['feature']} ({e['method']})") for e in data["effects"])
        parts.append(section("patterns", "Importance and curves", table(data["audit"].importance, ["model_id", "feature", "importance", "conf_low", "conf_high", "evidence_grade"]), curves))
        parts.append(section("reliability", "Findings of the audit", f"<p>Evidence grade <strong>{escape(data['audit'].summary['grade'])}</strong>, a heuristic.</p>", findings_html(data["audit"].findings)))
    if memo:
        parts.append(section("narrative", "Memo", f"<p>{escape(DISCLOSURE)}</p>", markdown(memo)))
    parts.append(section("limits", "Limits", *[f"<p>{escape(x)}</p>" for x in LIMITS]))
    parts.append(section("provenance", "Settings of the run", table([{"item": k, "value": v} for k, v in result.provenance.items()])))
    return page(f"Model report: {result.task.target}", *parts)


def evidence_report_html(audit, memo: str | None = None) -> str:
    s = audit.summary
    parts = [section("summary", "Grade and counts", table([s]))] + ([section("narrative", "Narrative", markdown(memo))] if memo else [])
    parts += [
        section("findings", "Findings", findings_html(audit.findings)), section("performance", "Audited models", table(audit.performance)),
        section("importance", "Importance by model and feature", table(audit.importance, ["model_id", "feature", "importance", "conf_low", "conf_high", "sign_stability", "max_association", "evidence_grade", "claim"])),
        section("dependence", "Associations between features", table(audit.dependence)), section("method", "Scope", f"<p>{escape(audit.scope)}</p>"), section("provenance", "Metric", f"<p>Metric: {escape(audit.metric)}</p>"),
    ]
    return page("Explanation evidence", *parts)


def metadata_report_html(result) -> str:
    return page("Model metadata", section("models", "Models", table([m | {"parameters": ", ".join(f"{k}={v}" for k, v in m["parameters"].items())} for m in result.metadata()])))


def model_report(result, path: str, data: dict | None = None, memo: str | None = None) -> str:
    return write_text(path, model_report_html(result, data, memo))


def evidence_report(audit, path: str, memo: str | None = None) -> str:
    return write_text(path, evidence_report_html(audit, memo))


def metadata_report(result, path: str) -> str:
    return write_text(path, metadata_report_html(result))


def dashboard(result, path: str = "dashboard.html", top: int = AUDIT_FEATURES, repeats: int = 20, max_models: int = 5, provider: str | None = None) -> str:
    """Screening, audit, effects and, if a provider is named, a memo, in one file."""
    from lucidframe.report.narrative import narrate

    return model_report(result, path, report_data(result, top, repeats, max_models), narrate(result, provider) if provider else None)


def simple_dashboard(result, path: str = "dashboard.html", top: int = AUDIT_FEATURES, repeats: int = 10) -> str:
    return dashboard(result, path, top, repeats)
