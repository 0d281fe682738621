"""Tunables and fixed vocabularies of the audit."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the data contract, in its order.
DIMENSIONS = ("clarity", "support", "materiality", "consistency")
PROFILE = (*DIMENSIONS, "completeness")
CATEGORIES = ("supported", "misleading_by_framing", "unsubstantiated", "contradicted")
TAGS = ("vagueness", "no_proof", "hidden_trade_off", "irrelevance", "lesser_of_two_evils", "fibbing", "false_labels", "greenrinsing")
DECISIVE = ("supports", "contradicts", "contradicts_framing")
RELATIONS = ("contradicts", "contradicts_framing", "supports", "criteria", "precedent", "context")
TIER_CAP = {1: 1.0, 2: 0.95, 3: 0.85, 4: 0.75, 5: 0.65}
PLACEHOLDER = {"clarity": (0.5, 0.3), "support": (0.5, 0.2), "materiality": (0.5, 0.2), "consistency": (0.3, 0.2)}
EVALUATOR_STAGES = ("language", "substantiate", "verify", "consistency")
DIMENSION_STAGES = {"clarity": ("language",), "support": ("substantiate", "verify"), "materiality": ("verify",), "consistency": ("consistency",)}
PREREQUISITES = {
    "extract": ("ingest",), "language": ("extract",), "substantiate": ("extract",), "verify": ("extract",), "consistency": ("extract",), "omissions": ("extract",),
    "verdict": ("language", "substantiate", "verify", "consistency", "omissions"), "summary": ("verdict",),
}
EVENT_STAGES = {
    "document.ingested": ("ingest",), "claim.extracted": ("extract",), "language.signal": ("language",), "evidence.added": ("language", "substantiate", "verify", "consistency", "omissions"),
    "omission.found": ("omissions",), "argument.made": ("verdict",), "verdict.issued": ("verdict",), "summary.updated": ("summary",),
}
ROUNDING = 0.011
STEADY_MAX = 0.1
STAGES = ("ingest", "extract", "language", "substantiate", "verify", "consistency", "omissions", "verdict", "summary")


@dataclass(frozen=True)
class AuditConfig:
    power: float = 3.0
    drivers: int = 6
    top_issues: int = 5
    credit: int = 4
    company_issues: int = 6
    default_prominence: float = 0.6
    halflife_days: float = 730.0
    undated_recency: float = 0.5
    epsilon: float = 0.05
    archive_gap_days: int = 30
    points_cap: float = 0.85
    two_points: float = 0.35
    point_gain: float = 0.25
    threshold: float = 0.5
    bins: int = 5
    thresholds: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
    few_negatives: int = 5
    snapshots: int = 3
    history_limit: int = 400
    min_words: int = 60
    max_chars: int = 60_000
    round_stages: bool = True
    # matching: share of the shorter span, of the smaller word set (cards; sentences of two versions), and the line between two scores
    overlap: float = 0.5
    card_words: float = 0.25
    sentence_words: float = 0.5
    score_line: float = 0.6
    # mining: an omission's score, its factor where terms are there but no passage is near, and the bar below which it counts as addressed
    omission_score: float = 0.7
    omission_penalty: float = 0.8
    omission_bar: float = 0.2


DEFAULT = AuditConfig()
