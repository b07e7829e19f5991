import datetime as dt

from pyspark.sql import functions as F

from conftest import SF001, obs_frame
from scrubjay.operators import history as H
from scrubjay.operators import metrics as M
from scrubjay.operators import recommend as R
from scrubjay.sources.observations import obs_checkpoints


def _hist(spark, rates):
    rows = [(dt.datetime(2024, 1, 1 + i), d, c, p, 5.0) for i, (d, c, p) in enumerate(rates)]
    return spark.createDataFrame(rows, "run_ts timestamp_ntz, duplicate_rate double, "
                                       "checkpoint_percentage double, processing_rate double, avg_daily_activity double")


def test_effectiveness_rules(spark):
    h = _hist(spark, [(10.0, 50.0, 0.0), (5.0, 50.0, 0.0), (0.0, 10.0, 10.0), (0.0, 0.0, 10.0)])
    e = {r.run_ts.day: r for r in H.effectiveness(h).collect()}
    assert e[1].effectiveness_score is None and e[1].message.startswith("Insufficient")
    assert e[2].duplicate_reduction == 50.0 and e[2].effectiveness_score == 50.0 and e[2].effectiveness_grade == "Fair"
    assert e[3].effectiveness_score == 100.0 and e[3].effectiveness_grade == "Excellent"
    assert e[4].duplicate_reduction == 0.0            # previous rate 0 -> 0
    assert e[4].baseline_ts.day == 1


def test_grade_uses_unrounded_score(spark):
    # 9.98 % processing increase -> 19.96 points: shown 20.0, graded below 20
    h = _hist(spark, [(0.0, 0.0, 0.0), (0.0, 0.0, 9.98)])
    r = [x for x in H.effectiveness(h).collect() if x.effectiveness_score is not None][0]
    assert r.effectiveness_score == 20.0 and r.effectiveness_grade == "Very Poor"
    h = _hist(spark, [(0.0, 0.0, 0.0), (0.0, 0.0, 10.0)])
    r = [x for x in H.effectiveness(h).collect() if x.effectiveness_score is not None][0]
    assert r.effectiveness_grade == "Poor"


def test_backfill_equals_direct_snapshot(spark):
    obs = obs_checkpoints(spark, SF001)
    hist = {r.run_ts: r for r in H.backfill_history(obs).collect()}
    for run_ts in sorted(hist)[::7]:
        snap = M.snapshot(obs.filter(F.col("created_at") < F.lit(run_ts)), run_ts).collect()[0]
        h = hist[run_ts]
        for c in ("total_records", "total_checkpoints", "duplicate_groups", "total_duplicates",
                  "processed_records", "oldest_record", "newest_record"):
            assert snap[c] == h[c], (run_ts, c)
        for c in ("avg_text_length", "duplicate_rate", "checkpoint_percentage", "avg_daily_activity"):
            assert abs(snap[c] - h[c]) < 1e-9, (run_ts, c)


def test_monitor_recommendation_fallback(spark):
    m = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, 10.0, 50.0, 60.0, 3.0)],
                              "run_ts timestamp_ntz, duplicate_rate double, checkpoint_percentage double, "
                              "processing_rate double, effectiveness_score double, avg_daily_activity double")
    assert [r.recommendation for r in R.monitor_recommendations(m).collect()] == [
        "SYSTEM optimal - continue regular monitoring"]


def test_snapshot_counts_markers(spark):
    obs = obs_frame(spark, [(1, "a [CONSOLIDATED]", "2024-01-30 00:00:00"), (2, "b [MERGED INTO ID: 1]", "2024-01-30 00:00:00"),
                            (3, "c", "2024-01-01 00:00:00"), (4, "c", "2024-01-02 00:00:00")])
    s = M.snapshot(obs, "2024-01-31 00:00:00").collect()[0]
    assert (s.processed_records, s.duplicate_groups, s.total_duplicates, s.active_days) == (2, 1, 1, 1)
    assert s.avg_daily_activity == 2.0
