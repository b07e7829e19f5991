import json
import os

from conftest import SF001
from scrubjay import jobs


def test_full_optimization_cycle(spark, tmp_dir):
    out = jobs.bench_optimize(spark, SF001, tmp_dir)
    store_root = os.path.join(tmp_dir, "observations")
    versions = sorted(d for d in os.listdir(store_root) if d.startswith("v="))
    assert versions == ["v=000001", "v=000002", "v=000003"]
    v1 = spark.read.parquet(os.path.join(store_root, "v=000001"))
    v2 = spark.read.parquet(os.path.join(store_root, "v=000002"))
    v3 = spark.read.parquet(os.path.join(store_root, "v=000003"))
    n_groups = out["filter"]["summary"].collect()[0].groups_consolidated
    assert v2.count() == v1.count() + n_groups          # one summary row per consolidated group
    assert v3.count() == v2.count()                     # resolution marks, never deletes
    assert v3.filter("content LIKE '%[DUPLICATE - KEPT ID:%'").count() > 0
    rep_dir = out["monitor"]["report"]
    rep = [f for f in os.listdir(rep_dir) if f.endswith(".json")]
    doc = json.loads(open(os.path.join(rep_dir, rep[0])).readline())
    assert doc["current_metrics"]["processed_records"] > 0
    assert doc["recommendations"]
    assert doc["current_metrics"]["daily_counts"] == sorted(doc["current_metrics"]["daily_counts"], key=lambda d: d["date"], reverse=True)
    assert {"components", "dates"} <= set(doc["effectiveness_analysis"]) and doc["thresholds"]["checkpoint_rate_warning"] == 70.0
    assert (out["filter"]["status"], out["dedup"]["status"]) == ("filtering_applied", "resolution_applied")


def test_second_cycle_and_cleanup(spark, tmp_dir):
    from scrubjay.session import ensure_checkpoint_dir
    from scrubjay.sources.observations import obs_documents
    from scrubjay.sources.storage import SnapshotStore

    def cut_folders():
        root = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "scrubjay-tables")
        return {d for d in os.listdir(root) if d.startswith("cut-")} if os.path.isdir(root) else set()

    before = cut_folders()
    store = SnapshotStore(spark, os.path.join(tmp_dir, "obs"))
    store.write(obs_documents(spark, SF001).withColumnRenamed("content", "body").withColumnRenamed("body", "content"))
    runs = [jobs.run_optimize(spark, store, os.path.join(tmp_dir, "run"), as_of=day) for day in ("2024-01-31 00:00:00", "2024-02-07 00:00:00", "2024-02-07 00:00:00")]
    assert len({r["monitor"]["report"] for r in runs}) == 3
    history = spark.read.parquet(os.path.join(tmp_dir, "run", "history"))
    assert history.count() == 3
    for r in runs:
        assert spark.read.json(r["monitor"]["report"]).count() == 1
    assert cut_folders() == before


def test_statuses_and_content_column(spark, tmp_dir):
    from conftest import obs_frame
    from scrubjay.sources.storage import SnapshotStore

    obs = obs_frame(spark, [(1, "one", "2024-01-01 00:00:00"), (2, "two", "2024-01-02 00:00:00")]).withColumnRenamed("content", "body")
    store = SnapshotStore(spark, os.path.join(tmp_dir, "obs"))
    out = jobs.run_dedup(spark, obs, tmp_dir, strategy="keep_latest", apply=True, store=store, content_col="body")
    assert out["status"] == "no_duplicates_found" and "version" not in out
    same = obs.withColumn("body", obs["id"] * 0)
    same = same.withColumn("body", same["body"].cast("string"))
    out = jobs.run_dedup(spark, same, tmp_dir, strategy="keep_latest", apply=True, store=store, content_col="body")
    assert out["status"] == "resolution_applied"
    assert sorted(r.body for r in store.read().collect()) == ["0", "0 [DUPLICATE - KEPT ID: 2]"]
    assert jobs.run_checkpoint_filter(spark, same, tmp_dir, content_col="body")["status"] == "no_action_needed"
