import json
import os

from pyspark.sql import functions as F

from conftest import SF001
from scrubjay import jobs
from scrubjay.config import Config, from_dict, load_config
from scrubjay.operators import history as H
from scrubjay.sources.observations import obs_checkpoints


def test_config_deep_merge(tmp_dir):
    c = from_dict({"thresholds": {"similarity_threshold": 0.7, "duplicate_rate_warning": 2},
                   "algorithm_weights": {"jaccard_similarity": 0.5}, "monitoring": {"history_limit": 5}})
    assert c.dedup.similarity_threshold == 0.7
    assert c.dedup.weights.jaccard_similarity == 0.5 and c.dedup.weights.exact_match == 0.3
    assert c.monitor.thresholds.duplicate_rate_warning == 2.0
    assert c.monitor.thresholds.checkpoint_rate_warning == 70.0
    assert c.monitor.history_limit == 5
    assert from_dict({"similarity_threshold": 0.6}).dedup.similarity_threshold == 0.6
    assert len(Config().checkpoints.patterns) == 6
    p = os.path.join(tmp_dir, "cfg.json")
    json.dump({"consolidation_threshold": 9}, open(p, "w"))
    assert load_config(p).checkpoints.consolidation_threshold == 9
    assert load_config(os.path.join(tmp_dir, "missing.json")) == Config()


def test_history_store_and_three_runs(spark, tmp_dir):
    path = os.path.join(tmp_dir, "hist")
    assert H.load_history(spark, path).count() == 0          # missing history = empty
    obs = obs_checkpoints(spark, SF001)
    reports = []
    for day in ("2024-01-10 00:00:00", "2024-01-20 00:00:00", "2024-01-31 00:00:00"):
        part = obs.filter(F.col("created_at") < F.lit(day).cast("timestamp_ntz"))
        out = jobs.run_monitor(spark, part, path, os.path.join(tmp_dir, day[:10]), as_of=day)
        rep_dir = out["report"]
        f = [x for x in os.listdir(rep_dir) if x.endswith(".json")][0]
        reports.append(json.loads(open(os.path.join(rep_dir, f)).readline()))
    assert H.load_history(spark, path).count() == 3
    assert [r["metrics_history_length"] for r in reports] == [1, 2, 3]
    assert reports[0]["effectiveness_analysis"].get("effectiveness_score") is None
    assert reports[2]["effectiveness_analysis"]["effectiveness_grade"] is not None
    assert H.retained(H.load_history(spark, path), 2).count() == 2
