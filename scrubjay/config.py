"""Configuration: frozen dataclasses deep-merged over the defaults.

A JSON file (or dict) may give any subset of keys; missing ones keep their defaults.
``similarity_threshold`` is accepted at the top level and under ``thresholds``.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace

from .functions.text import CHECKPOINT_PATTERNS


@dataclass(frozen=True)
class Weights:
    """Default weights of the four similarity components."""
    exact_match: float = 0.3
    sequence_similarity: float = 0.25
    levenshtein_similarity: float = 0.25
    jaccard_similarity: float = 0.2

    def __post_init__(self):
        for k in ("exact_match", "sequence_similarity", "levenshtein_similarity", "jaccard_similarity"):
            if getattr(self, k) < 0:
                raise ValueError(f"negative weight {k}")

    @property
    def total(self) -> float:
        return (self.exact_match + self.sequence_similarity
                + self.levenshtein_similarity + self.jaccard_similarity)


@dataclass(frozen=True)
class DedupConfig:
    # Fixed value: default similarity threshold.
    similarity_threshold: float = 0.85
    weights: Weights = field(default_factory=Weights)
    autojunk: bool = True


@dataclass(frozen=True)
class CheckpointConfig:
    patterns: tuple = tuple(CHECKPOINT_PATTERNS)
    consolidation_threshold: int = 5
    refetch_mode: str = "signature"     # or "prefix" (the reference's LIKE re-fetch)


@dataclass(frozen=True)
class MonitorThresholds:
    duplicate_rate_warning: float = 5.0
    checkpoint_rate_warning: float = 70.0
    processing_rate_target: float = 10.0


@dataclass(frozen=True)
class MonitorConfig:
    history_limit: int = 30
    activity_days: int = 7
    thresholds: MonitorThresholds = field(default_factory=MonitorThresholds)


@dataclass(frozen=True)
class Config:
    dedup: DedupConfig = field(default_factory=DedupConfig)
    checkpoints: CheckpointConfig = field(default_factory=CheckpointConfig)
    monitor: MonitorConfig = field(default_factory=MonitorConfig)


def from_dict(d: dict | None) -> Config:
    d = d or {}
    th = d.get("thresholds", {}) or {}
    w = d.get("algorithm_weights", {}) or {}
    dedup = DedupConfig(
        similarity_threshold=float(d.get("similarity_threshold",
                                         th.get("similarity_threshold", 0.85))),
        weights=replace(Weights(), **{k: float(v) for k, v in w.items()}),
        autojunk=bool(d.get("autojunk", True)),
    )
    ck = CheckpointConfig(
        patterns=tuple(d.get("checkpoint_patterns", CHECKPOINT_PATTERNS)),
        consolidation_threshold=int(d.get("consolidation_threshold",
                                          th.get("consolidation_threshold", 5))),
        refetch_mode=d.get("refetch_mode", "signature"),
    )
    mon = d.get("monitoring", {}) or {}
    mt = MonitorThresholds(**{k: float(th[k]) for k in
                              ("duplicate_rate_warning", "checkpoint_rate_warning",
                               "processing_rate_target") if k in th})
    monitor = MonitorConfig(history_limit=int(mon.get("history_limit", 30)), thresholds=mt)
    return Config(dedup=dedup, checkpoints=ck, monitor=monitor)


def load_config(path: str | None) -> Config:
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return from_dict(json.load(f))
    return Config()
