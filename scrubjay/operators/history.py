"""Metrics history: storage, a backfill derived from the table itself, run-over-run
trends, the 0-100 effectiveness score and its grade.

History is append-only Parquet, one row per run, ordered by ``run_ts``; the reference's
"keep the newest 30" becomes a read-time top-k.  Trends compare each run with the one
before it (``lag``), so a single query scores every run of the history at once.

``backfill_history`` reconstructs what a daily monitor run would have recorded: the
snapshot as of every midnight in the table's time span.  It is computed in one pass
(per-day counts, per-content first/second occurrence, running sums over the day table)
instead of one full snapshot per day.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..config import MonitorConfig
from ..functions.pyfmt import py_round
from ..functions.text import is_processed, monitor_checkpoint_like
from ..session import cut_lineage
from ..plans.skew import join_classes
from ..sources.storage import CommitConflict
from .metrics import content_key

HISTORY_SCHEMA = T.StructType([
    T.StructField("run_ts", T.TimestampNTZType()),
    T.StructField("total_records", T.LongType()),
    T.StructField("avg_text_length", T.DoubleType()),
    T.StructField("oldest_record", T.TimestampNTZType()),
    T.StructField("newest_record", T.TimestampNTZType()),
    T.StructField("total_checkpoints", T.LongType()),
    T.StructField("checkpoint_percentage", T.DoubleType()),
    T.StructField("duplicate_groups", T.LongType()),
    T.StructField("total_duplicates", T.LongType()),
    T.StructField("duplicate_rate", T.DoubleType()),
    T.StructField("processed_records", T.LongType()),
    T.StructField("processing_rate", T.DoubleType()),
    T.StructField("avg_daily_activity", T.DoubleType()),
])
ROUNDED = ["avg_text_length", "checkpoint_percentage", "duplicate_rate", "processing_rate",
           "avg_daily_activity"]


def as_history_row(snap: DataFrame) -> DataFrame:
    """A snapshot as the reference stores it: rates rounded (Python) to 2 decimals."""
    cols = []
    for f in HISTORY_SCHEMA.fields:
        c = F.col(f.name)
        if f.name in ROUNDED:
            c = py_round(c, 2)
        cols.append(c.cast(f.dataType).alias(f.name))
    return snap.select(*cols)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Stored runs; a history that does not exist yet is an empty one.  Other errors
    (permissions, network) are errors."""
    try:
        return spark.read.schema(HISTORY_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], HISTORY_SCHEMA)


def append_history(row: DataFrame, path: str) -> None:
    row.select(*[f.name for f in HISTORY_SCHEMA.fields]).write.mode("append").parquet(path)


def retained(history: DataFrame, limit: int = 30) -> DataFrame:
    """The newest ``limit`` runs (the reference trims its file to these)."""
    return history.orderBy(F.col("run_ts").desc()).limit(limit)


def _slim(obs: DataFrame, content_col: str) -> DataFrame:
    """What a history needs of each dated row, written once: the text is read once."""
    c = F.col(content_col)
    return cut_lineage(obs.filter(F.col("created_at").isNotNull()).select(
        F.to_date("created_at").alias("date"), "created_at", content_key(c).alias("k"), F.length(c).alias("len"),
        monitor_checkpoint_like(c).alias("ck"), is_processed(c).alias("pr")))


def _day_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("len").alias("sum_len"), F.count("len").alias("n_len"),
        F.count(F.when(F.col("ck"), 1)).alias("n_ck"), F.count(F.when(F.col("pr"), 1)).alias("n_pr"),
        F.min("created_at").alias("min_ts"), F.max("created_at").alias("max_ts"))


def _occurrences(rows: DataFrame) -> DataFrame:
    """(k, kn, f1, f2): rows, first and second occurrence of each content (the second equals the
    first where they tie, and is null where there is one row)."""
    first = cut_lineage(rows.groupBy("k").agg(F.min("created_at").alias("f1"), F.count(F.lit(1)).alias("kn")))
    total = first.agg(F.coalesce(F.sum("kn"), F.lit(0))).first()[0]
    second = (join_classes(rows.select("k", "created_at"), first.filter(F.col("kn") > 1), "k", "kn", total, null_safe=True)
                  .groupBy("k", "f1", "kn")
                  .agg(F.count(F.when(F.col("created_at") == F.col("f1"), 1)).alias("at_f1"),
                       F.min(F.when(F.col("created_at") > F.col("f1"), F.col("created_at"))).alias("after")))
    return first.filter(F.col("kn") == 1).select("k", "kn", "f1", F.lit(None).cast("timestamp_ntz").alias("f2")).unionByName(
        second.select("k", "kn", "f1", F.when(F.col("at_f1") >= 2, F.col("f1")).otherwise(F.col("after")).alias("f2")))


def backfill_history(obs: DataFrame, cfg: MonitorConfig = MonitorConfig(),
                     content_col: str = "content") -> DataFrame:
    """Daily runs at each midnight after a day with rows, through the day after the last
    row, each seeing the rows created before it.  Unrounded values."""
    rows = _slim(obs, content_col)
    return _daily_runs(_day_counts(rows), _occurrences(rows), cfg)


#: A history's state in one table, so that one commit covers it: rows of ``kind`` "day" hold
#: the counts of a day, rows of ``kind`` "content" the occurrences of a content.
DAY_COLUMNS = ["date", "n", "sum_len", "n_len", "n_ck", "n_pr", "min_ts", "max_ts"]
CONTENT_COLUMNS = ["k", "kn", "f1", "f2"]


def history_state(obs: DataFrame, content_col: str = "content") -> DataFrame:
    """The mergeable state of the dated rows of ``obs``; an empty table has an empty state."""
    rows = _slim(obs, content_col)
    days = _day_counts(rows).withColumn("kind", F.lit("day"))
    return days.unionByName(_occurrences(rows).withColumn("kind", F.lit("content")), allowMissingColumns=True)


def merge_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """The state of the rows of both.  Each state has one row per day and content, so two rows
    at most meet under a key, however often a content occurs."""
    both = old.unionByName(new)
    days = both.where("kind = 'day'").groupBy("date").agg(
        *[F.sum(c).alias(c) for c in ("n", "sum_len", "n_len", "n_ck", "n_pr")], F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
    times = F.array_sort(F.flatten(F.collect_list(F.filter(F.array("f1", "f2"), lambda t: t.isNotNull()))))
    contents = both.where("kind = 'content'").groupBy("k").agg(F.sum("kn").alias("kn"), times.alias("t")).select(
        "k", "kn", F.get("t", F.lit(0)).alias("f1"), F.get("t", F.lit(1)).alias("f2"))
    return days.withColumn("kind", F.lit("day")).unionByName(contents.withColumn("kind", F.lit("content")), allowMissingColumns=True) \
        .select(*old.columns)


def extend_history(store, new_rows: DataFrame, content_col: str = "content") -> int:
    """Add rows to the state in a :class:`SnapshotStore` without reading the earlier ones;
    returns its version.  Late rows count on their own day.  If another writer is faster,
    the merge is computed again on what that writer committed."""
    state = cut_lineage(history_state(new_rows, content_col))
    if store.current() is None:
        try:
            return store.write(state, base=0)
        except CommitConflict:
            pass
    return store.update(lambda old: merge_states(old, state))


def history_from_state(state: DataFrame, cfg: MonitorConfig = MonitorConfig()) -> DataFrame:
    """What :func:`backfill_history` gives for the rows of a state."""
    return _daily_runs(state.where("kind = 'day'").select(*DAY_COLUMNS), state.where("kind = 'content'").select(*CONTENT_COLUMNS), cfg)


def _daily_runs(per_day: DataFrame, occurrences: DataFrame, cfg: MonitorConfig) -> DataFrame:
    new_keys = occurrences.groupBy(F.to_date("f1").alias("date")).agg(F.count(F.lit(1)).alias("new_keys"))
    new_groups = occurrences.filter(F.col("f2").isNotNull()).groupBy(F.to_date("f2").alias("date")).agg(F.count(F.lit(1)).alias("new_groups"))
    # the day table is small (one row per calendar day), so ordered windows over it are cheap
    span = per_day.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    t = (days.join(per_day, "date", "left").join(new_keys, "date", "left").join(new_groups, "date", "left")
             .na.fill(0, ["n", "sum_len", "n_len", "n_ck", "n_pr", "new_keys", "new_groups"]))
    cum = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    dnum = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date"))
    recent = Window.orderBy(dnum).rangeBetween(-(cfg.activity_days - 1), 0)
    t = t.select(
        F.col("date"),
        F.sum("n").over(cum).alias("total_records"),
        F.sum("sum_len").over(cum).alias("cum_len"), F.sum("n_len").over(cum).alias("cum_n_len"),
        F.min("min_ts").over(cum).alias("oldest_record"), F.max("max_ts").over(cum).alias("newest_record"),
        F.sum("n_ck").over(cum).alias("total_checkpoints"), F.sum("n_pr").over(cum).alias("processed_records"),
        F.sum("new_keys").over(cum).alias("distinct_contents"),
        F.sum("new_groups").over(cum).alias("duplicate_groups"),
        F.sum("n").over(recent).alias("recent_rows"),
        F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(recent).alias("recent_days"),
    )
    total = F.col("total_records")

    def pct(x):
        return F.when(total > 0, x / total * 100).otherwise(F.lit(0.0))

    dup = total - F.col("distinct_contents")
    return t.select(
        F.date_add("date", 1).cast("timestamp_ntz").alias("run_ts"),
        total.alias("total_records"),
        F.when(F.col("cum_n_len") > 0, F.col("cum_len") / F.col("cum_n_len")).otherwise(F.lit(0.0)).alias("avg_text_length"),
        "oldest_record", "newest_record",
        F.col("total_checkpoints"), pct(F.col("total_checkpoints")).alias("checkpoint_percentage"),
        F.col("duplicate_groups"), dup.alias("total_duplicates"), pct(dup).alias("duplicate_rate"),
        F.col("processed_records"), pct(F.col("processed_records")).alias("processing_rate"),
        F.when(F.col("recent_days") > 0, F.col("recent_rows") / F.col("recent_days"))
         .otherwise(F.lit(0.0)).alias("avg_daily_activity"),
    )


def _clamp(x, lo, hi):
    return F.greatest(F.lit(float(lo)), F.least(x, F.lit(float(hi))))


def effectiveness(history: DataFrame, cfg: MonitorConfig = MonitorConfig()) -> DataFrame:
    """Per run: trends against the previous run, components, score and grade.  The
    first run has no score ("N/A" in the reference: NULL here, with a message)."""
    w = Window.orderBy("run_ts")
    base_w = w.rowsBetween(-(cfg.history_limit - 1), 0)
    h = history.select(
        "run_ts", "duplicate_rate", "checkpoint_percentage", "processing_rate",
        F.lag("run_ts").over(w).alias("previous_ts"),
        F.first("run_ts").over(base_w).alias("baseline_ts"),
        F.lag("duplicate_rate").over(w).alias("p_dup"),
        F.lag("checkpoint_percentage").over(w).alias("p_ck"),
        F.lag("processing_rate").over(w).alias("p_pr"),
    )

    def improvement(prev, cur):
        # the UDF's argument is evaluated on every row, so the divisor is NULL, not 0, when unused
        safe = F.when(prev > 0, prev)
        return F.when(prev > 0, py_round((prev - cur) / safe * 100, 2)).otherwise(F.lit(0.0))

    has_prev = F.col("previous_ts").isNotNull()
    dup = improvement(F.col("p_dup"), F.col("duplicate_rate"))
    ck = improvement(F.col("p_ck"), F.col("checkpoint_percentage"))
    pr = py_round(F.col("processing_rate") - F.col("p_pr"), 2)
    h = h.select("run_ts", "previous_ts", "baseline_ts", has_prev.alias("_has"),
                 dup.alias("duplicate_reduction"), ck.alias("checkpoint_optimization"),
                 pr.alias("processing_increase"))
    comp_d = _clamp(F.col("duplicate_reduction"), 0, 50)
    comp_c = _clamp(F.col("checkpoint_optimization"), 0, 30)
    comp_p = _clamp(F.col("processing_increase") * 2, 0, 20)
    score = comp_d + comp_c + comp_p
    grade = (F.when(score >= 80, "Excellent").when(score >= 60, "Good").when(score >= 40, "Fair")
              .when(score >= 20, "Poor").otherwise("Very Poor"))

    def only(x):
        return F.when(F.col("_has"), x)

    return h.select(
        "run_ts", "previous_ts", "baseline_ts",
        only(F.col("duplicate_reduction")).alias("duplicate_reduction"),
        only(F.col("checkpoint_optimization")).alias("checkpoint_optimization"),
        only(F.col("processing_increase")).alias("processing_increase"),
        only(comp_d).alias("component_duplicate"), only(comp_c).alias("component_checkpoint"),
        only(comp_p).alias("component_processing"),
        only(score).alias("score_raw"),
        only(py_round(score, 1)).alias("effectiveness_score"),
        only(grade).alias("effectiveness_grade"),
        F.when(~F.col("_has"), F.lit("Insufficient history for effectiveness analysis")).alias("message"),
    )
