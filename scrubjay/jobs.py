"""User-level jobs: deduplication, checkpoint filtering, monitoring and the full
optimization cycle (filter -> dedup keep_latest -> monitor).

Each job takes an observation DataFrame and writes its outputs (groups/actions/plan
tables, a JSON report, optionally a new table snapshot).  Analyses are computed once
and shared by the report and the plan.  In the full cycle every stage reads the
snapshot the previous stage committed, so stages are coupled only through written
tables, like the reference's stages are coupled through its database table.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Config
from .functions.pyfmt import py_round
from .operators import checkpoints as C
from .operators import dedup as D
from .operators import history as H
from .operators import metrics as M
from .operators import recommend as R
from .operators import resolve as RS
from .session import scratch_scope
from .sources.storage import SnapshotStore, write_report


def _now() -> str:
    return _dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S")


def _run_folder(out_dir: str) -> str:
    """A folder of this run's own, so that jobs can run again on one ``out_dir``."""
    return os.path.join(out_dir, _dt.datetime.now().strftime("run_%Y%m%d_%H%M%S_%f"))


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def run_dedup(spark: SparkSession, obs: DataFrame, out_dir: str, cfg: Config = Config(),
              strategy: str | None = None, apply: bool = False, run_ts: str | None = None,
              entity: str | None = None, store: SnapshotStore | None = None, content_col: str = "content") -> dict:
    """Analyze -> report -> optional resolution (dry run unless ``apply``).  ``status`` is
    analysis_completed, no_duplicates_found, dry_run_completed or resolution_applied."""
    if apply and store is None:
        raise ValueError("apply=True needs a SnapshotStore to write the new version")
    run_ts = run_ts or _now()
    folder = _run_folder(out_dir)
    with scratch_scope(spark):
        groups = _saved(D.find_groups(obs, cfg.dedup, entity, content_col), os.path.join(folder, "groups"))
        totals = _saved(D.dedup_totals(obs, groups, entity), os.path.join(folder, "totals"))
        result = {"folder": folder, "groups": groups, "totals": totals, "status": "analysis_completed"}
        if strategy:
            result["actions"] = os.path.join(folder, f"actions_{strategy}")
            RS.plan(groups, strategy).write.parquet(result["actions"])
            result["resolution"] = RS.resolution_totals(groups).collect()[0].asDict()
            if not result["resolution"]["groups_processed"]:
                result["status"] = "no_duplicates_found"
            elif apply:
                result["version"] = store.write(RS.apply(obs, groups, strategy, run_ts, content_col))
                result["status"] = "resolution_applied"
            else:
                result["status"] = "dry_run_completed"
        rec_list = R.dedup_recommendations(totals).orderBy("ord").agg(F.collect_list("recommendation")).scalar()
        report = totals.select(
            F.lit(run_ts).alias("timestamp"), F.lit(result["status"]).alias("status"),
            F.struct("total_records", "duplicate_groups", "duplicate_records",
                     py_round(F.col("duplicate_rate"), 2).alias("duplicate_rate")).alias("summary"),
            F.struct(F.lit(cfg.dedup.similarity_threshold).alias("similarity_threshold"),
                     F.lit(str(cfg.dedup.weights)).alias("algorithm_weights")).alias("config_used"),
            F.lit(os.path.join(folder, "groups")).alias("groups_path"),
        ).withColumn("recommendations", rec_list)
        result["report"] = write_report(report, os.path.join(folder, "report"))
    return result


def run_checkpoint_filter(spark: SparkSession, obs: DataFrame, out_dir: str, cfg: Config = Config(),
                          apply: bool = False, store: SnapshotStore | None = None, content_col: str = "content") -> dict:
    """Analyze once -> plan -> optional consolidation -> report.  ``status`` is
    no_action_needed, dry_run_completed or filtering_applied."""
    if apply and store is None:
        raise ValueError("apply=True needs a SnapshotStore to write the new version")
    folder = _run_folder(out_dir)
    with scratch_scope(spark):
        ann = C.annotate(obs, cfg.checkpoints, content_col)
        groups = _saved(C.checkpoint_groups(ann), os.path.join(folder, "checkpoint_groups"))
        plan = _saved(C.consolidation_plan(ann, cfg.checkpoints, content_col), os.path.join(folder, "consolidation_plan"))
        result = {"folder": folder}
        acts = apply and not plan.isEmpty()
        if acts:
            result["version"] = store.write(C.consolidate_apply(obs, cfg.checkpoints, content_col, ann=ann, plan=plan))
        summary = _saved(C.filter_summary(ann, cfg.checkpoints, content_col, plan=plan, groups=groups, applied=acts),
                         os.path.join(folder, "summary"))
        result |= {"summary": summary, "status": summary.first().action}
        rec_list = R.checkpoint_recommendations(summary).orderBy("ord").agg(F.collect_list("recommendation")).scalar()
        report = summary.select(
            F.lit(_now()).alias("timestamp"),
            F.struct("total_observations", py_round(F.col("checkpoint_percentage"), 1).alias("checkpoint_percentage"),
                     py_round(F.col("redundancy_rate"), 1).alias("redundancy_rate")).alias("system_stats"),
            F.struct("total_observations", "checkpoint_observations", "regular_observations",
                     "checkpoint_groups", "redundant_checkpoints").alias("redundancy_analysis"),
            F.struct("action", "groups_consolidated", "space_saved_chars").alias("filtering_preview"),
        ).withColumn("recommendations", rec_list)
        result["report"] = write_report(report, os.path.join(folder, "report"))
    return result


def run_monitor(spark: SparkSession, obs: DataFrame, history_path: str, out_dir: str,
                cfg: Config = Config(), as_of: str | None = None, content_col: str = "content") -> dict:
    """Snapshot -> append to history -> effectiveness over the retained runs -> rules.
    One report row a run, also if two runs carry the same time."""
    as_of = as_of or _now()
    folder = _run_folder(out_dir)
    t = cfg.monitor.thresholds
    with scratch_scope(spark):
        snap = _saved(M.snapshot(obs, as_of, cfg.monitor, content_col), os.path.join(folder, "snapshot"))
        row = H.as_history_row(snap)
        H.append_history(row, history_path)
        history = H.retained(H.load_history(spark, history_path), cfg.monitor.history_limit)
        current = H.effectiveness(history, cfg.monitor).filter(
            F.col("run_ts") == F.lit(as_of).cast("timestamp_ntz")).dropDuplicates(["run_ts"])
        metrics = row.join(current.select("run_ts", "effectiveness_score"), "run_ts", "left")
        rec_list = R.monitor_recommendations(metrics, t).orderBy("ord").agg(F.collect_list("recommendation")).scalar()
        days = snap.select("run_ts", "active_days", "daily_counts")
        report = metrics.join(current.drop("effectiveness_score"), "run_ts", "left").join(days, "run_ts").select(
            F.struct(*row.columns, "active_days", "daily_counts").alias("current_metrics"),
            F.struct("effectiveness_score", "effectiveness_grade", "duplicate_reduction",
                     "checkpoint_optimization", "processing_increase",
                     F.struct("component_duplicate", "component_checkpoint", "component_processing").alias("components"),
                     F.struct(F.col("baseline_ts").alias("baseline"), F.col("previous_ts").alias("previous"),
                              F.col("run_ts").alias("current")).alias("dates"), "message").alias("effectiveness_analysis"),
            F.struct(F.lit(t.duplicate_rate_warning).alias("duplicate_rate_warning"),
                     F.lit(t.checkpoint_rate_warning).alias("checkpoint_rate_warning"),
                     F.lit(t.processing_rate_target).alias("processing_rate_target")).alias("thresholds"),
            F.lit(history.count()).alias("metrics_history_length"),
        ).withColumn("recommendations", rec_list)
        path = write_report(report, os.path.join(folder, "report"))
    return {"folder": folder, "snapshot": snap, "report": path}


def run_optimize(spark: SparkSession, store: SnapshotStore, out_dir: str, cfg: Config = Config(),
                 as_of: str | None = None, run_ts: str | None = None, apply: bool = True) -> dict:
    """Full cycle on the store's current snapshot: checkpoint filter (apply) -> dedup
    keep_latest (apply) on the filtered snapshot -> monitor on the result."""
    out = {}
    out["filter"] = run_checkpoint_filter(spark, store.read(), os.path.join(out_dir, "filter"), cfg,
                                          apply=apply, store=store)
    out["dedup"] = run_dedup(spark, store.read(), os.path.join(out_dir, "dedup"), cfg,
                             strategy="keep_latest", apply=apply, run_ts=run_ts, store=store)
    out["monitor"] = run_monitor(spark, store.read(), os.path.join(out_dir, "history"),
                                 os.path.join(out_dir, "monitor"), cfg, as_of)
    return out


def bench_optimize(spark: SparkSession, sf_dir: str, work: str, partitions: int | None = None) -> dict:
    """The full cycle over the test tables: checkpoint rows from ``events`` and documents
    (ids offset to stay unique) in one observation table of ``partitions`` files."""
    from .sources.observations import obs_checkpoints, obs_documents
    base = obs_checkpoints(spark, sf_dir).unionByName(
        obs_documents(spark, sf_dir).withColumn("id", F.col("id") + F.lit(10 ** 12)))
    store = SnapshotStore(spark, os.path.join(work, "observations"))
    store.write(base.repartition(partitions) if partitions else base)
    return run_optimize(spark, store, os.path.join(work, "run"), as_of="2024-01-31 00:00:00",
                        run_ts="2024-06-01 12:00:00")
