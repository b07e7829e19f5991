"""Rule-based recommendations, as rows ``(ord, recommendation)``.

Each rule is a ``when`` over a one-row metrics frame; the rules that fire are kept in
order and exploded, so the rules run where the metrics are, with no driver branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import MonitorThresholds
from ..functions.pyfmt import py_fixed, py_str, thousands


def _rows(frame: DataFrame, rules: list[Column], keep=()) -> DataFrame:
    arr = F.filter(F.array(*[r.cast("string") for r in rules]), lambda x: x.isNotNull())
    return frame.select(*keep, F.posexplode(arr).alias("ord", "recommendation"))


def _lit(s: str) -> Column:
    return F.lit(s)


def _fill(template: str, *values: Column) -> Column:
    """The template with each ``{}`` replaced by the next value."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, rest in zip(values, parts[1:]):
        out += [v, F.lit(rest)]
    return F.concat(*out)


# Recommendation texts, in the order the rules emit them ({} = number).
DEDUP_HIGH = "HIGH duplicate rate ({}%) - immediate action required"
DEDUP_MEDIUM = "MEDIUM duplicate rate ({}%) - schedule cleanup"
DEDUP_LOW = "LOW duplicate rate ({}%) - monitor trends"
DEDUP_EXCELLENT = "EXCELLENT data quality - maintain current practices"
DEDUP_PREVENTION = "Consider implementing real-time duplicate prevention"
DEDUP_MAINTENANCE = "Schedule regular deduplication maintenance"
DEDUP_MONITOR = "Monitor system performance after resolution"
DEDUP_THRESHOLDS = "Consider adjusting similarity thresholds based on results"
CK_HIGH_RATIO = "HIGH checkpoint ratio ({}%) - consider consolidation"
CK_MANY = "MANY redundant checkpoints ({}) - apply filtering"
CK_PATTERNS = "MULTIPLE patterns ({}) - review checkpoint configuration"
CK_SAVINGS = "SIGNIFICANT space savings: {} characters (~{}KB)"
CK_AUTOMATION = "AUTOMATION: Configure automatic filtering for future checkpoints"
CK_MONITORING = "MONITORING: Implement quality metrics post-filtering"
MON_DUPLICATES = "HIGH duplicate rate ({}%) - run deduplication more frequently"
MON_CHECKPOINTS = "MANY checkpoints ({}%) - consider automatic consolidation"
MON_PROCESSING = "LOW processing rate ({}%) - increase optimization frequency"
MON_LOW_EFFECT = "LOW effectiveness - review optimization configuration"
MON_ADJUST = "CONSIDER adjusting similarity thresholds and consolidation rules"
MON_EXCELLENT = "EXCELLENT effectiveness - maintain current configuration"
MON_ACTIVITY = "VERY LOW daily activity - verify data input systems"
MON_OPTIMAL = "SYSTEM optimal - continue regular monitoring"


def dedup_recommendations(totals: DataFrame) -> DataFrame:
    rate, groups = F.col("duplicate_rate"), F.col("duplicate_groups")
    pct = py_fixed(rate, 1)
    band = (F.when(rate > 10, _fill(DEDUP_HIGH, pct))
             .when(rate > 5, _fill(DEDUP_MEDIUM, pct))
             .when(rate > 1, _fill(DEDUP_LOW, pct))
             .otherwise(_lit(DEDUP_EXCELLENT)))
    rules = [
        band,
        F.when(groups > 0, _lit(DEDUP_PREVENTION)),
        F.when(groups > 0, _lit(DEDUP_MAINTENANCE)),
        _lit(DEDUP_MONITOR),
        _lit(DEDUP_THRESHOLDS),
    ]
    return _rows(totals, rules)


def checkpoint_recommendations(summary: DataFrame) -> DataFrame:
    """``summary`` from :func:`scrubjay.operators.checkpoints.filter_summary`."""
    t, c = F.col("total_observations"), F.col("checkpoint_observations")
    pct = F.when(t > 0, c / t * 100).otherwise(F.lit(0.0))
    red = F.col("redundant_checkpoints")
    n_groups = F.col("groups_with_duplicates")
    saved = F.col("space_saved_chars")
    rules = [
        F.when(pct > 60, _fill(CK_HIGH_RATIO, py_fixed(pct, 1))),
        F.when(red > 10, _fill(CK_MANY, red.cast("string"))),
        F.when(n_groups > 5, _fill(CK_PATTERNS, n_groups.cast("string"))),
        F.when(saved > 1000, _fill(CK_SAVINGS, thousands(saved), py_fixed(saved / 1000, 1))),
        _lit(CK_AUTOMATION),
        _lit(CK_MONITORING),
    ]
    return _rows(summary, rules)


def monitor_recommendations(metrics: DataFrame, thresholds: MonitorThresholds = MonitorThresholds(),
                            keep=("run_ts",)) -> DataFrame:
    """``metrics``: one history-style row (rates already rounded) joined with the run's
    ``effectiveness_score`` (NULL when there is no score yet)."""
    dup, ck, pr = F.col("duplicate_rate"), F.col("checkpoint_percentage"), F.col("processing_rate")
    score, act = F.col("effectiveness_score"), F.col("avg_daily_activity")
    fired = [
        F.when(dup > thresholds.duplicate_rate_warning, _fill(MON_DUPLICATES, py_str(dup))),
        F.when(ck > thresholds.checkpoint_rate_warning, _fill(MON_CHECKPOINTS, py_str(ck))),
        F.when(pr < thresholds.processing_rate_target, _fill(MON_PROCESSING, py_str(pr))),
        F.when(score < 40, _lit(MON_LOW_EFFECT)),
        F.when(score < 40, _lit(MON_ADJUST)),
        F.when(score > 80, _lit(MON_EXCELLENT)),
        F.when(act < 1, _lit(MON_ACTIVITY)),
    ]
    any_fired = F.exists(F.array(*fired), lambda x: x.isNotNull())
    rules = fired + [F.when(~any_fired, _lit(MON_OPTIMAL))]
    return _rows(metrics, rules, [k for k in keep if k in metrics.columns])
