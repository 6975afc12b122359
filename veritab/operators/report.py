"""What a run says in words: cards, recommendations, summary, sections, and the checks of those words against the facts."""

from __future__ import annotations

import html
import json
import re
from dataclasses import dataclass
from pathlib import Path

from veritab.operators.verify import Claim, Evidence

#: Words of the columns that matter most to a reader.
PRIMARY = ("revenue", "sales", "amount", "total", "profit", "cost", "price", "qty", "quantity", "count", "spend", "value", "margin", "volume")
#: The report's sections in their order.
SECTIONS = (
    "executive_summary", "cleaning", "business_context", "dq_summary", "data_overview", "kpis", "stats", "charts", "insights", "recommendations", "limitations", "evidence", "run_comparison",
)


def relevance(name: str, column: str, function: str) -> float:
    has = lambda text: any(w in text.lower() for w in PRIMARY)
    return 2.0 * has(column or "") + 1.0 * has(name) + 0.5 * (function in ("sum", "count"))


def cards(kpis: list[dict], most: int = 4) -> list[dict]:
    """The ungrouped KPIs a reader should see first: by relevance, then by size; a KPI without a value is none."""
    own = [k for k in kpis if k.get("value") is not None and k.get("label") is None]
    return sorted(own, key=lambda k: (-relevance(k["name"], k.get("column") or "", k.get("function") or ""), -abs(k["value"])))[:most]


@dataclass
class Recommendation:
    recommendation_id: str
    claim_id: str
    text: str


#: What a claim of each kind implies, and what may carefully be done about it.
ADVICE = {
    "DESCRIPTIVE": ("it is the level later changes are measured by", "watch it with limits around this level and try a change on a small part first"),
    "COMPARATIVE": ("the difference between the groups is where an effort can tell", "look for what sets the weaker group apart and try the likeliest lever there"),
    "CORRELATIONAL": ("the two move together, which says nothing about cause", "treat it as a question and test it before acting on it"),
    "TREND": ("the direction may go on or not", "follow the next periods before planning on it"),
}


def recommend(claims: list[Claim], most: int = 8) -> list[Recommendation]:
    """A hedged recommendation for each of the first claims: observation, finding, implication, what to consider."""
    out = []
    for c in claims[:most]:
        implied, consider = ADVICE.get(c.kind, ("its weight is open", "review it before anything else"))
        text = f"Observation: {c.text}. Finding: supported by {', '.join(c.evidence)}. Implication: {implied}. Consider: {consider}."
        out.append(Recommendation(f"REC-{len(out) + 1:03d}", c.claim_id, text))
    return out


def surviving(recommendations: list[Recommendation], claims: list[Claim]) -> list[Recommendation]:
    """Recommendations whose claim was kept."""
    kept = {c.claim_id for c in claims}
    return [r for r in recommendations if r.claim_id in kept]


def growth_note(missing: list[str], span: tuple | None, column: str | None) -> str:
    """Why growth KPIs have no value: no time column, unreadable dates, a single month, or no baseline."""
    if not missing:
        return ""
    ids = ", ".join(missing)
    if column is None:
        return f"Growth ({ids}) can't be given: the table has no time column."
    if span is None or span[0] is None:
        return f"Growth ({ids}) can't be given: {column} holds no readable dates."
    first, last, months = span
    if months < 2:
        return f"Growth ({ids}) can't be given: {column} covers one month only ({first} to {last})."
    return f"Growth ({ids}) has no period to compare with between {first} and {last}."


def summary(shown: list[dict], failures: int, note: str) -> str:
    """A few sentences from facts alone."""
    lead = f"The headline figure is {shown[0]['name']} at {shown[0]['value']:,.2f}." if shown else "The run produced no figure."
    quality = f"{failures} data-quality rules failed; the report names them." if failures else "No data-quality rule failed."
    return " ".join(t for t in (lead, quality, note, "Read the full report for the evidence behind each statement.") if t)


#: Words that deny something within a sentence, and what they may deny.
_NO = r"\b(?:lack\w*|no|none|without|absent)\b"
_TIME = r"\b(?:time[- ‐-―]?stamp\w*|dates?|temporal (?:data|columns?))\b"


def contradictions(text: str, time_columns: list[str], removed: int) -> list[str]:
    """Statements of a text that the facts deny: that there are no dates, or that nothing was removed."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        denied = re.search(rf"{_NO}(.{{0,60}}?){_TIME}", sentence, re.I)
        if denied and time_columns and not re.search(r"\b(?:missing|gaps?)\b", denied[1], re.I):
            out.append(f"denies time data, but there is {', '.join(time_columns)}")
        if removed and re.search(r"\b(?:no|none|zero|not)\b", sentence, re.I) and re.search(r"\b(?:remov|dropp|delet|exclud)\w+", sentence, re.I) and not re.search(r"\d", sentence):
            out.append(f"says nothing was removed, but {removed} rows were")
    return out


def broken_references(evidence: Evidence, kpis: list[dict], claims: list[Claim], recommendations: list[Recommendation], charts: list[str], sections: list[str]) -> list[tuple[str, str]]:
    """(severity, what): evidence or claims that don't exist are critical, missing charts and sections are warnings."""
    out = [("critical", f"{k['kpi_id']}: no evidence {k['evidence']}") for k in kpis if k["evidence"] not in evidence.entries]
    out += [("critical", f"{c.claim_id}: no evidence {e}") for c in claims for e in c.evidence if e not in evidence.entries]
    known = {c.claim_id for c in claims}
    out += [("critical", f"{r.recommendation_id}: no claim {r.claim_id}") for r in recommendations if r.claim_id not in known]
    out += [("warning", f"no chart {p}") for p in charts if not Path(p).is_file()]
    return out + [("warning", f"no section {s}") for s in SECTIONS if s not in sections]


def page(title: str, sections: dict[str, list[str]], charts: list[str], interactive: list[dict]) -> str:
    """The report as one HTML page: all thirteen sections, those without content say so; drawings stand in the charts section."""
    body = []
    for name in SECTIONS:
        lines = sections.get(name) or ([] if name == "charts" and charts else ["nothing to report"])
        own = "".join(f"<p>{html.escape(line)}</p>" for line in lines) + ("".join(charts) if name == "charts" else "")
        body.append(f'<section id="{name}"><h2>{html.escape(name.replace("_", " ").capitalize())}</h2>{own}</section>')
    data = json.dumps(interactive, default=str).replace("<", "\\u003c")
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(body)}<script type='application/json' id='charts-data'>{data}</script>"
