"""Evidence, claims, recomputation and the verdict."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-4
KINDS = {"DESCRIPTIVE": ("kpi", "descriptive"), "CORRELATIONAL": ("correlation",), "COMPARATIVE": ("comparison",), "TREND": ("growth", "trend")}


@dataclass
class Evidence:
    """Ids in the order of registration; an id can't be registered twice."""

    entries: dict[str, dict] = field(default_factory=dict)

    def add(self, kind: str, value: float | None, evidence_id: str | None = None, **facts) -> str:
        evidence_id = evidence_id or f"EV-{len(self.entries) + 1:03d}"
        if evidence_id in self.entries:
            raise ValueError(f"{evidence_id} is registered already")
        self.entries[evidence_id] = {"kind": kind, "value": value, **facts}
        return evidence_id

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.entries, default=str))

    @classmethod
    def load(cls, path: str) -> Evidence:
        return cls(json.loads(Path(path).read_text()))


@dataclass
class Claim:
    claim_id: str
    kind: str
    text: str
    evidence: list[str]


def draft_claims(kpis: list[dict], correlations: list[dict], comparisons: list[dict], trends: list[dict], most: int = 20) -> list[Claim]:
    """Hedged claims of the results, each with its evidence; kinds take turns."""
    groups: dict[str, list[tuple[str, list[str]]]] = {"DESCRIPTIVE": [], "CORRELATIONAL": [], "COMPARATIVE": [], "TREND": []}
    for k in kpis:
        if k.get("value") is not None:
            groups["DESCRIPTIVE"].append((f"{k['name']} is {k['value']:,.2f}", [k["evidence"]]))
    for c in correlations:
        if abs(c["r"]) >= 0.3 and c["p"] < 0.05:
            how = "strongly" if abs(c["r"]) >= 0.7 else "moderately"
            groups["CORRELATIONAL"].append((f"{c['a']} and {c['b']} go together {how} (r = {c['r']:.2f})", [c["evidence"]]))
    told = set()
    for c in comparisons:
        if c["p"] < 0.05 and (c["measure"], c["dimension"]) not in told:
            told.add((c["measure"], c["dimension"]))
            groups["COMPARATIVE"].append((f"{c['measure']} differs between values of {c['dimension']} (p = {c['p']:.3g})", [c["evidence"]]))
    for t in trends:
        if t["points"] >= 3:
            groups["TREND"].append((f"{t['measure']} last changed by {t['latest']:.1%}", [t["evidence"]]))
    out: list[Claim] = []
    while any(groups.values()) and len(out) < most:
        for kind, waiting in groups.items():
            if waiting and len(out) < most:
                text, evidence = waiting.pop(0)
                out.append(Claim(f"IN-{len(out) + 1:03d}", kind, text, evidence))
    return out


def validate_claims(claims: list[Claim], evidence: Evidence) -> tuple[list[Claim], list[str]]:
    """Claims whose evidence exists and is of a fitting kind; a causal claim never passes."""
    kept, notes = [], []
    for c in claims:
        known = [e for e in c.evidence if e in evidence.entries]
        fitting = [e for e in known if evidence.entries[e]["kind"] in KINDS.get(c.kind, ())]
        if c.kind not in KINDS:
            notes.append(f"{c.claim_id}: {c.kind} claims are not made")
        elif not fitting:
            notes.append(f"{c.claim_id}: no evidence of the right kind")
        else:
            kept.append(Claim(c.claim_id, c.kind, c.text, fitting))
    return kept, notes


def compare(reported: DataFrame, recomputed: DataFrame, keys: tuple[str, ...] = ("evidence", "label")) -> DataFrame:
    """(keys, reported, recomputed, status): ok, mismatch, null or unmatched.

    The join is null-safe, since ungrouped results have no label.
    """
    a = reported.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col("value").alias("reported"), F.lit(True).alias("in_a"))
    b = recomputed.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("value").alias("recomputed"), F.lit(True).alias("in_b"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    x, y = F.col("reported"), F.col("recomputed")
    gap = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    status = (
        F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), "unmatched").when(x.isNull() & y.isNull(), "null")
        .when(x.isNull() | y.isNull() | (gap > TOLERANCE), "mismatch").otherwise("ok")
    )
    both = a.join(b, on, "full_outer")
    return both.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], "reported", "recomputed", status.alias("status"))


def dangling(references: DataFrame, ref: str, entries: DataFrame, key: str) -> DataFrame:
    """References without an entry."""
    return references.join(entries.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def compare_runs(now: DataFrame, before: DataFrame) -> DataFrame:
    """(kpi_id, label, now, before, delta) of KPIs in both runs."""
    b = before.select(F.col("kpi_id").alias("b_id"), F.col("label").alias("b_label"), F.col("value").alias("before"))
    on = (F.col("kpi_id") == F.col("b_id")) & F.col("label").eqNullSafe(F.col("b_label"))
    return now.join(b, on).select("kpi_id", "label", F.col("value").alias("now"), "before", (F.col("value") - F.col("before")).alias("delta"))


def score(critical: int, warnings: int, infos: int) -> float:
    return max(0.0, 100 - 15 * critical - 2.5 * warnings - 0.5 * infos)


def verdict(critical: int, warnings: int, reasons: tuple[str, ...] = ()) -> str:
    hard = any(r in ("fallback", "invalid_evidence", "unresolved_dq", "llm_logic_failure") or r.endswith("_limit_exceeded") for r in reasons)
    if critical or hard:
        return "NEEDS_REVISION"
    return "APPROVED_WITH_WARNINGS" if warnings else "APPROVED"
