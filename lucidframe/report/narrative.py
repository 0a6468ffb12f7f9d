"""Plain-language memos from aggregates: a deterministic one made here, or one asked of a named provider.

No row ever leaves the engine: contexts hold collected aggregates only. A remote request is made only if a provider is named.
"""

from __future__ import annotations

import json
import os
import re
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from lucidframe.contract import ContractError
from lucidframe.models.registry import FAMILIES
from lucidframe.operators.metrics import DEFINITIONS

# Providers, their default models, keys and wire formats.
PROVIDERS = [
    {"provider": "local", "remote": False, "model": None, "key": None, "endpoint": None, "structured": False, "privacy": "no request is made", "reproducibility": "equal figures give equal text"},
    {"provider": "gemini", "remote": True, "model": "gemini-3.5-flash", "key": "GEMINI_API_KEY", "endpoint": "https://generativelanguage.googleapis.com/v1beta/interactions", "structured": True, "privacy": "the context of aggregates goes out; the account's terms decide on its use", "reproducibility": "one named model, sampled"},
    {"provider": "groq", "remote": True, "model": "openai/gpt-oss-120b", "key": "GROQ_API_KEY", "endpoint": "https://api.groq.com/openai/v1/chat/completions", "structured": True, "privacy": "the context of aggregates goes out", "reproducibility": "one named model, sampled"},
    {"provider": "cloudflare", "remote": True, "model": "@cf/openai/gpt-oss-120b", "key": "CLOUDFLARE_API_TOKEN", "endpoint": "https://api.cloudflare.com/client/v4/accounts/{account}/ai/v1/chat/completions", "structured": False, "privacy": "the context of aggregates goes out", "reproducibility": "one named model, sampled"},
    {"provider": "ollama", "remote": False, "model": "gemma3:4b", "key": None, "endpoint": "http://localhost:11434/v1/chat/completions", "structured": True, "privacy": "the request goes to a port of this machine", "reproducibility": "one named local model, sampled"},
    {"provider": "openrouter", "remote": True, "model": "openrouter/free", "key": "OPENROUTER_API_KEY", "endpoint": "https://openrouter.ai/api/v1/chat/completions", "structured": True, "privacy": "the context of aggregates goes to whichever host is picked", "reproducibility": "each call may meet another model"},
    {"provider": "custom", "remote": True, "model": None, "key": None, "endpoint": None, "structured": False, "privacy": "whatever the given address does", "reproducibility": "whatever the given address does"},
]
FIELDS = ("headline", "performance", "patterns", "cautions", "next_steps")
MOST_WORDS, MOST_ITEMS = 500, 3
LIMITS = (
    "Intervals of importance come from shuffles of the same rows; other rows vary more.",
    "A feature that a model relies on need not cause the outcome, and nothing here tests fairness or safety.",
    "Rows from elsewhere, and someone who knows the columns, have to confirm a use.",
)
DISCLOSURE = "Made from aggregates; it quotes no row."


@dataclass(frozen=True)
class Provider:
    name: str
    model: str | None
    endpoint: str | None
    key: str
    structured: bool
    remote: bool


def resolve(name: str = "local", model: str | None = None, endpoint: str | None = None, key: str | None = None) -> Provider:
    """A provider with its key from the caller or the environment; plain HTTP is for this machine alone."""
    row = next((p for p in PROVIDERS if p["provider"] == name), None)
    if row is None:
        raise ContractError(f"unknown provider: {name}")
    if name == "local":
        return Provider("local", None, None, "", False, False)
    endpoint = endpoint or row["endpoint"]
    if endpoint and "{account}" in endpoint:
        account = os.environ.get("CLOUDFLARE_ACCOUNT_ID", "")
        if not account:
            raise ContractError("an account id is needed")
        endpoint = endpoint.replace("{account}", account)
    model = model or row["model"]
    if not endpoint or not model:
        raise ContractError("an endpoint and a model are needed")
    parts = urlparse(endpoint)
    if parts.username or parts.password:
        raise ContractError("an endpoint must not hold credentials")
    local = parts.hostname in ("localhost", "127.0.0.1", "::1")
    if parts.scheme != "https" and not (parts.scheme == "http" and local):
        raise ContractError("endpoints must use HTTPS, unless on this machine")
    key = key or (os.environ.get(row["key"], "") if row["key"] else "")
    if row["key"] and not key:
        raise ContractError(f"a key is needed: set {row['key']}")
    return Provider(name, model, endpoint, key or "", row["structured"], not local)


def schema() -> dict:
    items = {"type": "array", "items": {"type": "string"}, "minItems": 1, "maxItems": MOST_ITEMS}
    return {"type": "object", "properties": {f: {"type": "string"} if f in ("headline", "performance") else items for f in FIELDS}, "required": list(FIELDS), "additionalProperties": False}


def build_request(prompt: str, provider: Provider, max_tokens: int = 900, temperature: float = 0.1, timeout: float = 60.0, structured: bool = True) -> dict:
    """One of two wire formats, as data."""
    use = structured and provider.structured
    headers = {"Content-Type": "application/json"}
    if provider.name == "gemini":
        headers["x-goog-api-key"] = provider.key
        body = {"model": provider.model, "input": prompt, "store": False, "generation_config": {"temperature": temperature, "max_output_tokens": max_tokens}}
        if use:
            body["response_format"] = {"type": "text", "mime_type": "application/json", "schema": schema()}
    else:
        if provider.key:
            headers["Authorization"] = f"Bearer {provider.key}"
        body = {"model": provider.model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens, "stream": False}
        if use:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "narrative", "strict": True, "schema": schema()}}
            if provider.name == "openrouter":
                body["provider"] = {"require_parameters": True}
    return {"url": provider.endpoint, "headers": headers, "body": body, "timeout": timeout, "structured": use, "format": "gemini" if provider.name == "gemini" else "openai"}


def send(request: dict) -> dict:
    """The default transport: one JSON POST from the driver."""
    call = urllib.request.Request(request["url"], json.dumps(request["body"]).encode(), request["headers"], method="POST")
    with urllib.request.urlopen(call, timeout=request["timeout"]) as answer:
        return json.loads(answer.read())


def answer_text(answer: dict, kind: str) -> str:
    if kind == "gemini":
        parts = answer.get("outputs") or []
        text = "".join(p.get("text", "") for p in parts if isinstance(p, dict))
    else:
        text = ((answer.get("choices") or [{}])[0].get("message") or {}).get("content") or ""
    if not text.strip():
        raise ContractError("the provider returned no text")
    return text


def parse(text: str) -> dict:
    """The five fields of a strict JSON object: no repeated, missing or further ones, at most 500 words."""
    cleaned = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text.strip(), flags=re.I))

    def once(pairs):
        names = [k for k, _ in pairs]
        if len(set(names)) != len(names):
            raise ContractError("a field is repeated")
        return dict(pairs)

    try:
        found = json.loads(cleaned, object_pairs_hook=once)
    except json.JSONDecodeError as e:
        raise ContractError(f"the provider returned invalid JSON: {e}") from e
    if not isinstance(found, dict) or set(found) != set(FIELDS):
        raise ContractError(f"the narrative must hold exactly {', '.join(FIELDS)}")
    for f in FIELDS:
        value = found[f]
        one = f in ("headline", "performance")
        ok = isinstance(value, str) and value.strip() if one else isinstance(value, list) and 1 <= len(value) <= MOST_ITEMS and all(isinstance(x, str) and x.strip() for x in value)
        if not ok:
            raise ContractError(f"{f} is not what it must be")
    words = sum(len(x.split()) for f in FIELDS for x in ([found[f]] if isinstance(found[f], str) else found[f]))
    if words > MOST_WORDS:
        raise ContractError(f"the narrative has more than {MOST_WORDS} words")
    return found


# Contexts


def _number(x: float | None, digits: int = 4) -> str:
    return "unavailable" if x is None or x != x else f"{x:.{digits}g}"


def _percent(x: float | None) -> str:
    return "unavailable" if x is None or x != x else f"{100 * x:.1f}%"


def result_context(result) -> dict:
    """What a memo may say about a fit: aggregates of the evaluation."""
    rows = [r.asDict() for r in result.leaderboard.collect()]
    main = next(r for r in rows if r["model_id"] == "main_model")
    base = next(r for r in rows if r["family"] == "baseline")
    primary = result.task.primary
    context = {
        "kind": "result", "task": result.task.kind, "target": result.task.target, "models": len(rows), "features": len(result.model().features), "role": result.role, "rows": main["n"], "model": result.model().label, "metric": primary,
        "score": main[primary], "baseline": base[primary], "improvement": main["improvement"], "definition": DEFINITIONS[primary], "notes": result.notes,
        "retained": [{"model_id": m.model_id, "family": m.family, "nonlinearity": FAMILIES[m.family].nonlinearity, "interactions": FAMILIES[m.family].interactions} for m in result.models if m.family in FAMILIES],
    }
    if result.task.kind != "regression":
        groups = result.calibration().collect()
        n = sum(g["n"] for g in groups)
        context["calibration"] = {"gap": sum(g["n"] * g["gap"] for g in groups) / n, "groups": len(groups), "mean": sum(g["n"] * g["mean_probability"] for g in groups) / n, "observed": sum(g["n"] * g["observed_rate"] for g in groups) / n}
    if result.tuning:
        t = result.tuning
        best = next(c for c in t.candidates if c["configuration_id"] == t.selected)
        context["tuning"] = {"configurations": len(t.plan), "families": len({c["family"] for c in t.plan}), "folds": t.folds, "metric": t.metric, "rule": t.rule, "selected": t.selected, "final": t.final, "score": best["cv_score"], "settings": best["hyperparameters"], "fallback": t.refit["fallback_used"]}
    return context


def audit_context(audit) -> dict:
    top = sorted(audit.importance, key=lambda r: -(r["importance"] or 0.0))[:3]
    return {"kind": "audit", "models": audit.summary["n_models"], "features": len({r["feature"] for r in audit.importance}), "grade": audit.summary["grade"], "stable": audit.summary["stable_claim_rate"], "findings": audit.findings, "top": list(dict.fromkeys(r["feature"] for r in top))}


def local_memo(context: dict) -> str:
    """The same aggregates give the same text."""
    audit = context["kind"] == "audit"
    out = ["# Audit of explanations" if audit else "# Fit and scores", "", "## Data"]
    out.append(f"{context['models']} models and {context['features']} features" + ("." if audit else f" for a {context['task']} task on `{context['target']}`.") + " All figures are of these rows.")
    if not audit:
        out += ["", "## Against the constant prediction", f"The {context['model']} was scored on {context['rows']} {context['role']} rows: **{context['metric']}** {_number(context['score'])}."]
        better = context["improvement"] is not None and context["improvement"] > 0
        out.append(f"That is {_percent(context['improvement'])} better than the intercept-only baseline ({_number(context['baseline'])})." if better else f"It did not improve on the intercept-only baseline ({_number(context['baseline'])}); its patterns are leads at most.")
        out += ["", "## The metric", f"**{context['metric']}:** {context['definition']}"]
    if "calibration" in context:
        c = context["calibration"]
        out += ["", "## Calibration", f"Over {c['groups']} groups the average gap between probability and frequency was {_percent(c['gap'])}; the mean probability was {_percent(c['mean'])}, the observed frequency {_percent(c['observed'])}.", "Other group counts give other gaps."]
    if context.get("notes"):
        out += ["", "## Notes", *[f"- **{n['severity']}:** {n['message']} {n['recommendation']}" for n in context["notes"]]]
    if "tuning" in context:
        t = context["tuning"]
        out += ["", "## The search", f"{t['configurations']} configurations of {t['families']} families were compared on {t['folds']} folds of the training rows by {t['metric']}.", f"The {t['rule']} rule selected `{t['selected']}` ({t['settings']}), resampled {t['metric']} {_number(t['score'], 5)}; `{t['final']}` was fitted{' as a fallback' if t['fallback'] else ''}.", "Folds chose; the held rows above measure."]
    if context.get("retained"):
        out += ["", "## Models kept", "By the learners' cards, not by these fits:", *[f"- `{m['model_id']}`: {m['family']}; curves: {m['nonlinearity']}; interactions: {m['interactions']}." for m in context["retained"]]]
    if "grade" in context:
        out += ["", "## Grade", f"The heuristic evidence grade is **{context['grade']}**, from the rules of the audit. {_percent(context['stable'])} of the claims are stable."]
    if context.get("findings"):
        out += ["", "## Findings", *[f"- **{f['severity']} - {f['code']}:** {f['message']} {f['recommendation']}" for f in context["findings"]]]
    if context.get("top"):
        out += ["", "## Leading features", f"Permutation importance is led by {', '.join(context['top'])}: what shuffling them costs the models on these rows."]
    out += ["", "## Next", "Read the largest errors row by row, then score rows from another period or place.", "", "## Limits", *LIMITS, "", DISCLOSURE]
    return "\n".join(out)


def render(narrative: dict) -> str:
    out = [f"# {narrative['headline']}", "", "## Scores", narrative["performance"]]
    for title, name in (("Patterns", "patterns"), ("Cautions", "cautions"), ("Next", "next_steps")):
        out += ["", f"## {title}", *[f"- {x}" for x in narrative[name]]]
    return "\n".join([*out, "", "## Limits", *LIMITS])


def prompt_for(context: dict) -> str:
    return (
        "Write a short, careful memo for a reader without statistical training. Use only the aggregates below; claim no cause. "
        f"Answer with one JSON object with the fields {', '.join(FIELDS)}; the last three are lists of one to three sentences.\n" + json.dumps(context, sort_keys=True, default=str)
    )


def narrate(subject, provider: str = "local", transport: Callable[[dict], dict] = send, **settings) -> str:
    """A memo on a result or an audit; local unless a provider is named. A failing provider raises."""
    context = subject if isinstance(subject, dict) else audit_context(subject) if hasattr(subject, "findings") else result_context(subject)
    chosen = resolve(provider, **{k: settings.pop(k) for k in ("model", "endpoint", "key") if k in settings})
    if chosen.name == "local":
        return local_memo(context)
    request = build_request(prompt_for(context), chosen, **settings)
    return render(parse(answer_text(transport(request), request["format"])))
