"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``
over the whole test tables, with its DuckDB twin in :data:`ORACLE`.

Output columns are flat and named identically on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import sql_twins as Q
from .config import DedupConfig, Weights
from .functions import similarity as S
from .functions import text as T
from .operators import dedup as D
from .plans.skew import join_classes
from .session import cut_lineage, scratch_path
from .sources.storage import SnapshotStore
from .sources.observations import ADAPTER_EPOCH, as_observations, obs_checkpoints, obs_conversations, obs_documents, read_table

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _sql_fill(template: str, *exprs: str) -> str:
    """SQL twin of recommend._fill: the template with each ``{}`` replaced by an expression."""
    parts = template.split("{}")
    out = [Q.sql_quote(parts[0])]
    for e, rest in zip(exprs, parts[1:]):
        out += [f"({e})", Q.sql_quote(rest)]
    return " || ".join(out)


# ---------------------------------------------------------------- scans / text

@register("scan_observations", f"SELECT id, content, created_at, entity_name FROM ({Q.OBS_DOCUMENTS})")
def scan_observations(spark, sf):
    return obs_documents(spark, sf).select("id", "content", "created_at", "entity_name")


@register("scan_conversations", f"SELECT id, content, created_at, entity_name FROM ({Q.OBS_CONVERSATIONS})")
def scan_conversations(spark, sf):
    return obs_conversations(spark, sf).select("id", "content", "created_at", "entity_name")


@register("normalize_text", f"SELECT id, {Q.normalize('content')} AS norm FROM ({Q.OBS_DOCUMENTS})")
def q_normalize_text(spark, sf):
    return obs_documents(spark, sf).select("id", T.normalize_text("content").alias("norm"))


@register("normalize_conversations",
          f"SELECT id, {Q.normalize('content')} AS norm FROM ({Q.OBS_CONVERSATIONS})")
def q_normalize_conversations(spark, sf):
    return obs_conversations(spark, sf).select("id", T.normalize_text("content").alias("norm"))


# ---------------------------------------------------------------- exact dedup

def _exact_groups_sql(obs_sql: str) -> str:
    return f"""
WITH p AS (SELECT id, created_at, {Q.normalize('content')} AS norm FROM ({obs_sql}) WHERE content IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY {Q.SCAN_ORDER}) - 1 AS rank_in_group,
             count(*) OVER (PARTITION BY norm) AS n FROM p),
s AS (SELECT norm, id AS seed_id, row_number() OVER (ORDER BY {Q.SCAN_ORDER}) - 1 AS group_id
      FROM r WHERE rank_in_group = 0 AND n > 1)
SELECT group_id, seed_id, id AS member_id, CAST(rank_in_group AS INTEGER) AS rank_in_group,
       rank_in_group = 0 AS is_seed, created_at
FROM r JOIN s USING (norm)"""


GROUP_OUT = ["group_id", "seed_id", "member_id", "rank_in_group", "is_seed", "created_at"]


@register("dedup_exact_groups", _exact_groups_sql(Q.OBS_DOCUMENTS))
def dedup_exact_groups(spark, sf):
    return D.find_groups(obs_documents(spark, sf)).select(*GROUP_OUT)


def _totals_sql(obs_sql: str) -> str:
    return f"""
WITH g AS ({_exact_groups_sql(obs_sql)})
SELECT (SELECT count(*) FROM ({obs_sql})) AS total_records,
       (SELECT count(*) FROM g WHERE is_seed) AS duplicate_groups,
       (SELECT count(*) FROM g) AS duplicate_records,
       CASE WHEN (SELECT count(*) FROM ({obs_sql})) > 0
            THEN (SELECT count(*) FROM g) / (SELECT count(*) FROM ({obs_sql})) * 100 ELSE 0.0 END AS duplicate_rate"""


@register("dedup_totals", _totals_sql(Q.OBS_DOCUMENTS))
def dedup_totals(spark, sf):
    return D.summarize(obs_documents(spark, sf))


@register("dedup_totals_conversations", _totals_sql(Q.OBS_CONVERSATIONS))
def dedup_totals_conversations(spark, sf):
    return D.summarize(obs_conversations(spark, sf))


@register("entity_filter", _totals_sql(f"SELECT * FROM ({Q.OBS_DOCUMENTS}) WHERE entity_name = 'src3'"))
def entity_filter(spark, sf):
    return D.summarize(obs_documents(spark, sf), entity="src3")


# ---------------------------------------------------------------- checkpoints

from .config import CheckpointConfig  # noqa: E402
from .operators import checkpoints as C  # noqa: E402

CK_ANN = f"""SELECT *, {Q.is_checkpoint('content')} AS is_checkpoint,
  CASE WHEN {Q.is_checkpoint('content')} THEN {Q.signature('content')} END AS signature
  FROM ({Q.OBS_CHECKPOINTS})"""


def _ck_ann(spark, sf, cfg=CheckpointConfig()):
    return C.annotate(obs_checkpoints(spark, sf), cfg)


@register("checkpoint_flag", f"SELECT id, is_checkpoint FROM ({CK_ANN})")
def checkpoint_flag(spark, sf):
    return C.flagged(obs_checkpoints(spark, sf)).select("id", "is_checkpoint")


@register("checkpoint_signature", f"SELECT id, signature FROM ({CK_ANN})")
def q_checkpoint_signature(spark, sf):
    return C.flagged(obs_checkpoints(spark, sf)).select("id", "signature")


CK_TOTALS = f"""WITH a AS ({CK_ANN}), s AS (SELECT signature, count(*) AS n FROM a WHERE is_checkpoint GROUP BY signature)
SELECT (SELECT count(*) FROM a) AS total_observations,
       (SELECT count(*) FROM a WHERE is_checkpoint) AS checkpoint_observations,
       (SELECT count(*) FROM a WHERE NOT is_checkpoint) AS regular_observations,
       (SELECT count(*) FROM s) AS checkpoint_groups,
       (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM s WHERE n > 1) AS redundant_checkpoints"""


@register("checkpoint_totals", CK_TOTALS)
def q_checkpoint_totals(spark, sf):
    return C.checkpoint_totals(_ck_ann(spark, sf))


@register("checkpoint_rates", f"""WITH t AS ({CK_TOTALS})
SELECT total_observations,
  CASE WHEN total_observations > 0 THEN checkpoint_observations / total_observations * 100 ELSE 0.0 END AS checkpoint_percentage,
  CASE WHEN checkpoint_observations > 0 THEN redundant_checkpoints / checkpoint_observations * 100 ELSE 0.0 END AS redundancy_rate
FROM t""")
def q_checkpoint_rates(spark, sf):
    return C.checkpoint_rates(C.checkpoint_totals(_ck_ann(spark, sf)))


CK_STATS = f"""SELECT signature, count(*) AS count, min(created_at) AS first_occurrence,
  max(created_at) AS last_occurrence,
  first(content ORDER BY {Q.SCAN_ORDER}) AS newest_content, first(id ORDER BY {Q.SCAN_ORDER}) AS newest_id,
  CAST(sum(length(content)) AS BIGINT) AS total_chars,
  (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 60000000.0 / (count(*) - 1) AS avg_interval_min
FROM ({CK_ANN}) WHERE is_checkpoint GROUP BY signature HAVING count(*) > 1"""


@register("checkpoint_groups", f"""SELECT signature, count, first_occurrence, last_occurrence,
  substring(newest_content, 1, 100) || '...' AS sample_content, avg_interval_min,
  '~' || {Q.py_fixed('avg_interval_min', 1)} || ' min' AS frequency FROM ({CK_STATS})""")
def q_checkpoint_groups(spark, sf):
    return C.checkpoint_groups(_ck_ann(spark, sf)).drop("first_sk", "total_chars")


@register("checkpoint_frequency", f"SELECT signature, avg_interval_min FROM ({CK_STATS})")
def q_checkpoint_frequency(spark, sf):
    return C.checkpoint_groups(_ck_ann(spark, sf)).select("signature", "avg_interval_min")


@register("refetch_signature", f"SELECT signature, id FROM ({CK_ANN}) WHERE signature IN (SELECT signature FROM ({CK_STATS}))")
def q_refetch_signature(spark, sf):
    ann = _ck_ann(spark, sf)
    groups = cut_lineage(C.checkpoint_groups(ann).select("signature", "count"))
    total = groups.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return join_classes(ann.select("signature", "id"), groups, "signature", "count", total).select("signature", "id")


@register("refetch_prefix", f"""WITH g AS (SELECT signature, '%' || substring(substring(newest_content, 1, 100) || '...', 1, 50) || '%' AS pattern FROM ({CK_STATS}))
SELECT g.signature, o.id FROM ({Q.OBS_CHECKPOINTS}) o JOIN g ON o.content LIKE g.pattern ESCAPE '\\'""")
def q_refetch_prefix(spark, sf):
    cfg = CheckpointConfig(refetch_mode="prefix")
    ann = _ck_ann(spark, sf, cfg)
    return C.refetch_prefix(ann, C.checkpoint_groups(ann)).select("signature", "id")


def _summary_sql(n, first, last, avg):
    return (f"'SUMMARY: ' || CAST({n} AS VARCHAR) || ' automatic checkpoints from ' || strftime({first}, '%Y-%m-%d %H:%M')"
            f" || ' to ' || strftime({last}, '%Y-%m-%d %H:%M') || ' - ~' || {Q.py_fixed(avg, 1)} || ' min'")


CK_PLAN = f"""WITH s AS ({CK_STATS}), t AS ({CK_TOTALS}),
p AS (SELECT signature, count, total_chars, {_summary_sql('count', 'first_occurrence', 'last_occurrence', 'avg_interval_min')} AS summary,
             first_occurrence, last_occurrence FROM s)
SELECT 'consolidate_group' AS action, signature AS group_signature, count AS records_affected,
       total_chars - length(summary) AS space_saved_chars, summary AS consolidated_content,
       first_occurrence, last_occurrence
FROM p WHERE (SELECT redundant_checkpoints FROM t) >= 5"""


@register("consolidation_plan", CK_PLAN)
def q_consolidation_plan(spark, sf):
    return C.consolidation_plan(_ck_ann(spark, sf)).drop("first_sk")


@register("checkpoint_summaries", f"SELECT group_signature, consolidated_content, first_occurrence, last_occurrence FROM ({CK_PLAN})")
def q_checkpoint_summaries(spark, sf):
    return C.consolidation_plan(_ck_ann(spark, sf)).select(
        "group_signature", "consolidated_content", "first_occurrence", "last_occurrence")


CK_APPLY = f"""WITH a AS ({CK_ANN}), p AS ({CK_PLAN}), s AS ({CK_STATS}),
np AS (SELECT p.*, (SELECT max(id) FROM a) + row_number() OVER (ORDER BY s.last_occurrence DESC NULLS LAST, s.newest_id DESC) AS new_id
       FROM p JOIN s ON s.signature = p.group_signature)
SELECT a.id, CASE WHEN a.signature IN (SELECT group_signature FROM p) THEN a.content || ' [CONSOLIDATED]' ELSE a.content END AS content,
       a.created_at
FROM a
UNION ALL
SELECT new_id AS id, consolidated_content AS content, last_occurrence AS created_at FROM np"""


@register("consolidate_apply", CK_APPLY)
def q_consolidate_apply(spark, sf):
    return C.consolidate_apply(obs_checkpoints(spark, sf)).select("id", "content", "created_at")


# checkpoint texts whose first 50 characters repeat, so that the LIKE re-fetch finds many
# rows: with words between spaces, and (clicks) without any
OBS_ROUTINE = f"""SELECT id, CASE WHEN entity_name = 'click' THEN 'CollectorOfClickEventsOnTheSharedClusterWrittenEveryHour:' || content
  ELSE 'Nightly collector of ' || entity_name || ' events on the shared cluster: ' || content END AS content, created_at, entity_name, updated_at
  FROM ({Q.OBS_CHECKPOINTS})"""


def obs_routine(spark, sf):
    o, c = obs_checkpoints(spark, sf), F.col("content")
    text = F.when(F.col("entity_name") == "click", F.concat(F.lit("CollectorOfClickEventsOnTheSharedClusterWrittenEveryHour:"), c)).otherwise(
        F.concat(F.lit("Nightly collector of "), "entity_name", F.lit(" events on the shared cluster: "), c))
    return o.withColumn("content", text)


def _on_routine(sql: str) -> str:
    return sql.replace(f"({Q.OBS_CHECKPOINTS})", f"({OBS_ROUTINE})")


PREFIX = CheckpointConfig(refetch_mode="prefix")
_ROUTINE_HITS = f"""SELECT g.signature, o.id, o.content, o.created_at FROM ({OBS_ROUTINE}) o JOIN (
  SELECT signature, '%' || substring(substring(newest_content, 1, 100) || '...', 1, 50) || '%' AS pattern FROM ({_on_routine(CK_STATS)})) g
  ON o.content LIKE g.pattern ESCAPE '\\'"""
_ROUTINE_PLAN = f"""SELECT signature, count, total_chars, first_occurrence, last_occurrence,
  {_summary_sql('count', 'first_occurrence', 'last_occurrence', 'avg_interval_min')} AS summary FROM (
  SELECT signature, count(*) AS count, min(created_at) AS first_occurrence, max(created_at) AS last_occurrence, CAST(sum(length(content)) AS BIGINT) AS total_chars,
    (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 60000000.0 / (count(*) - 1) AS avg_interval_min
  FROM ({_ROUTINE_HITS}) GROUP BY signature HAVING count(*) > 1)
  WHERE (SELECT redundant_checkpoints FROM ({_on_routine(CK_TOTALS)})) >= 5"""


@register("refetch_prefix_routine", f"SELECT signature, id FROM ({_ROUTINE_HITS})")
def refetch_prefix_routine(spark, sf):
    """The LIKE re-fetch where each group's pattern matches many rows."""
    ann = C.annotate(obs_routine(spark, sf), PREFIX)
    return C.refetch_prefix(ann, C.checkpoint_groups(ann)).select("signature", "id")


@register("consolidation_plan_prefix", f"""SELECT 'consolidate_group' AS action, signature AS group_signature, count AS records_affected,
  total_chars - length(summary) AS space_saved_chars, summary AS consolidated_content, first_occurrence, last_occurrence FROM ({_ROUTINE_PLAN})""")
def consolidation_plan_prefix(spark, sf):
    return C.consolidation_plan(C.annotate(obs_routine(spark, sf), PREFIX), PREFIX).drop("first_sk")


@register("consolidate_apply_prefix", f"""WITH p AS ({_ROUTINE_PLAN}), o AS ({OBS_ROUTINE}),
t AS (SELECT id, count(*) AS times FROM ({_ROUTINE_HITS}) WHERE signature IN (SELECT signature FROM p) GROUP BY id)
SELECT o.id, o.content || repeat(' [CONSOLIDATED]', coalesce(t.times, 0)) AS content, o.created_at FROM o LEFT JOIN t USING (id)
UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY s.last_occurrence DESC NULLS LAST, s.newest_id DESC) AS id,
  p.summary AS content, p.last_occurrence AS created_at FROM p JOIN ({_on_routine(CK_STATS)}) s USING (signature)""")
def consolidate_apply_prefix(spark, sf):
    """The table after a consolidation that re-fetches by LIKE."""
    return C.consolidate_apply(obs_routine(spark, sf), PREFIX).select("id", "content", "created_at")


# ---------------------------------------------------------------- monitor

from .operators import history as H  # noqa: E402
from .operators import metrics as M  # noqa: E402
from .operators import recommend as R  # noqa: E402
from .operators import resolve as RS  # noqa: E402

AS_OF = "2024-01-31 00:00:00"


def _snapshot_sql(obs_sql: str, as_of: str = AS_OF) -> str:
    t = f"TIMESTAMP '{as_of}'"
    return f"""WITH o AS ({obs_sql}),
d AS (SELECT content, count(*) AS n FROM o GROUP BY content HAVING count(*) > 1),
a AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS c FROM o WHERE created_at >= {t} - INTERVAL 7 DAYS GROUP BY 1),
b AS (SELECT count(*) AS total_records, avg(length(content)) AS avg_text_length, min(created_at) AS oldest_record,
             max(created_at) AS newest_record,
             count(*) FILTER (WHERE {Q.monitor_checkpoint_like('content')}) AS total_checkpoints,
             count(*) FILTER (WHERE {Q.is_processed('content')}) AS processed_records FROM o)
SELECT {t} AS run_ts, total_records, avg_text_length, oldest_record, newest_record, total_checkpoints,
  CASE WHEN total_records > 0 THEN total_checkpoints / total_records * 100 ELSE 0.0 END AS checkpoint_percentage,
  (SELECT count(*) FROM d) AS duplicate_groups, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM d) AS total_duplicates,
  CASE WHEN total_records > 0 THEN (SELECT coalesce(sum(n - 1), 0) FROM d) / total_records * 100 ELSE 0.0 END AS duplicate_rate,
  processed_records,
  CASE WHEN total_records > 0 THEN processed_records / total_records * 100 ELSE 0.0 END AS processing_rate,
  (SELECT count(*) FROM a) AS active_days,
  CASE WHEN (SELECT count(*) FROM a) > 0 THEN (SELECT sum(c) FROM a) / (SELECT count(*) FROM a) ELSE 0.0 END AS avg_daily_activity,
  (SELECT coalesce(string_agg(CAST(date AS VARCHAR) || ':' || CAST(c AS VARCHAR), ',' ORDER BY date DESC), '') FROM a) AS daily_counts
FROM b"""


def _flat_days(snap):
    """The array of days as text, newest first, for comparison with SQL."""
    day = lambda d: F.concat(d["date"].cast("string"), F.lit(":"), d["count"].cast("string"))
    return snap.withColumn("daily_counts", F.array_join(F.transform("daily_counts", day), ","))


@register("monitor_snapshot", _snapshot_sql(Q.OBS_CHECKPOINTS))
def monitor_snapshot(spark, sf):
    return _flat_days(M.snapshot(obs_checkpoints(spark, sf), AS_OF))


@register("monitor_snapshot_documents", _snapshot_sql(Q.OBS_DOCUMENTS, "2024-01-08 00:00:00"))
def monitor_snapshot_documents(spark, sf):
    return _flat_days(M.snapshot(obs_documents(spark, sf), "2024-01-08 00:00:00"))


@register("monitor_general", f"SELECT total_records, avg_text_length, oldest_record, newest_record FROM ({_snapshot_sql(Q.OBS_CHECKPOINTS)})")
def monitor_general(spark, sf):
    return M.general(obs_checkpoints(spark, sf)).select(
        "total_records", "avg_text_length", "oldest_record", "newest_record")


@register("monitor_checkpoint_count", f"SELECT total_checkpoints, checkpoint_percentage FROM ({_snapshot_sql(Q.OBS_CHECKPOINTS)})")
def monitor_checkpoint_count(spark, sf):
    general = M.general(obs_checkpoints(spark, sf))
    return general.select("total_checkpoints", M.percentage(F.col("total_checkpoints"), F.col("total_records")).alias("checkpoint_percentage"))


@register("monitor_duplicates", f"SELECT duplicate_groups, total_duplicates, duplicate_rate FROM ({_snapshot_sql(Q.OBS_DOCUMENTS)})")
def monitor_duplicates(spark, sf):
    return M.snapshot(obs_documents(spark, sf), AS_OF).select("duplicate_groups", "total_duplicates", "duplicate_rate")


@register("exact_duplicate_groups", f"""SELECT md5(content) AS content_md5, count(*) AS occurrences
FROM ({Q.OBS_DOCUMENTS}) GROUP BY content HAVING count(*) > 1""")
def exact_duplicate_groups(spark, sf):
    obs = obs_documents(spark, sf)
    return (obs.groupBy(M.content_key("content").alias("k"))
               .agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1)
               .select(F.lower(F.hex("k")).alias("content_md5"), "occurrences"))


@register("daily_activity", f"""SELECT CAST(created_at AS DATE) AS date, count(*) AS daily_count FROM ({Q.OBS_CHECKPOINTS})
WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS GROUP BY 1""")
def q_daily_activity(spark, sf):
    return M.daily_activity(obs_checkpoints(spark, sf), AS_OF)


@register("avg_daily_activity", f"SELECT active_days, avg_daily_activity FROM ({_snapshot_sql(Q.OBS_CHECKPOINTS)})")
def avg_daily_activity(spark, sf):
    return M.activity(obs_checkpoints(spark, sf), AS_OF).select("active_days", "avg_daily_activity")


@register("monitor_processed", f"""SELECT total_records, processed_records, processing_rate, total_checkpoints
FROM ({_snapshot_sql(CK_APPLY)})""")
def monitor_processed(spark, sf):
    """Processed-marker counts on the table after checkpoint consolidation."""
    after = C.consolidate_apply(obs_checkpoints(spark, sf))
    return M.snapshot(after, AS_OF).select("total_records", "processed_records", "processing_rate",
                                           "total_checkpoints")


def _backfill_sql(obs_sql: str) -> str:
    return f"""WITH o AS (SELECT * FROM ({obs_sql}) WHERE created_at IS NOT NULL),
r AS (SELECT CAST(d AS TIMESTAMP) AS run_ts FROM (SELECT unnest(generate_series(CAST(min(created_at) AS DATE) + 1,
        CAST(max(created_at) AS DATE) + 1, INTERVAL 1 DAY)) AS d FROM o)),
x AS (SELECT r.run_ts, o.* FROM r JOIN o ON o.created_at < r.run_ts),
g AS (SELECT run_ts, count(*) AS total_records, sum(length(content)) / count(length(content)) AS avg_text_length,
        min(created_at) AS oldest_record, max(created_at) AS newest_record,
        count(*) FILTER (WHERE {Q.monitor_checkpoint_like('content')}) AS total_checkpoints,
        count(*) FILTER (WHERE {Q.is_processed('content')}) AS processed_records FROM x GROUP BY run_ts),
dc AS (SELECT run_ts, content, count(*) AS n FROM x GROUP BY run_ts, content),
dd AS (SELECT run_ts, count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS total_duplicates FROM dc GROUP BY run_ts),
act AS (SELECT run_ts, CAST(created_at AS DATE) AS day, count(*) AS c FROM x WHERE created_at >= run_ts - INTERVAL 7 DAYS GROUP BY 1, 2),
aa AS (SELECT run_ts, sum(c) / count(*) AS avg_daily_activity FROM act GROUP BY run_ts)
SELECT g.run_ts, total_records, avg_text_length, oldest_record, newest_record, total_checkpoints,
  total_checkpoints / total_records * 100 AS checkpoint_percentage, duplicate_groups, total_duplicates,
  total_duplicates / total_records * 100 AS duplicate_rate, processed_records,
  processed_records / total_records * 100 AS processing_rate, coalesce(avg_daily_activity, 0.0) AS avg_daily_activity
FROM g JOIN dd USING (run_ts) LEFT JOIN aa USING (run_ts)"""


@register("history_backfill", _backfill_sql(Q.OBS_CHECKPOINTS))
def history_backfill(spark, sf):
    return H.backfill_history(obs_checkpoints(spark, sf))


@register("history_incremental", _backfill_sql(Q.OBS_CHECKPOINTS))
def history_incremental(spark, sf):
    """The same history from a state that takes the rows in two parts, the later one without
    reading the earlier again."""
    obs, cut = obs_checkpoints(spark, sf), F.lit("2024-01-15").cast("timestamp_ntz")
    store = SnapshotStore(spark, scratch_path(spark, f"history-{uuid.uuid4().hex}", scoped=True))
    H.extend_history(store, obs.where(F.col("created_at") < cut))
    H.extend_history(store, obs.where(F.col("created_at") >= cut))
    return H.history_from_state(store.read())


def _rounded_history_sql(obs_sql: str) -> str:
    cols = ", ".join(f"{Q.py_round(c, 2)} AS {c}" if c in H.ROUNDED else c
                     for c in [f.name for f in H.HISTORY_SCHEMA.fields])
    return f"SELECT {cols} FROM ({_backfill_sql(obs_sql)})"


def _effectiveness_sql(obs_sql: str, limit: int = 30) -> str:
    imp = lambda p, c: f"CASE WHEN {p} > 0 THEN {Q.py_round(f'({p} - {c}) / {p} * 100', 2)} ELSE 0.0 END"
    return f"""WITH h AS ({_rounded_history_sql(obs_sql)}),
l AS (SELECT run_ts, duplicate_rate, checkpoint_percentage, processing_rate,
        lag(run_ts) OVER (ORDER BY run_ts) AS previous_ts,
        first_value(run_ts) OVER (ORDER BY run_ts ROWS BETWEEN {limit - 1} PRECEDING AND CURRENT ROW) AS baseline_ts,
        lag(duplicate_rate) OVER (ORDER BY run_ts) AS p_dup,
        lag(checkpoint_percentage) OVER (ORDER BY run_ts) AS p_ck,
        lag(processing_rate) OVER (ORDER BY run_ts) AS p_pr FROM h),
t AS (SELECT *, {imp('p_dup', 'duplicate_rate')} AS dr, {imp('p_ck', 'checkpoint_percentage')} AS co,
        {Q.py_round('processing_rate - p_pr', 2)} AS pi FROM l),
c AS (SELECT *, greatest(0.0, least(dr, 50.0)) AS cd, greatest(0.0, least(co, 30.0)) AS cc,
        greatest(0.0, least(pi * 2, 20.0)) AS cp FROM t),
s AS (SELECT *, cd + cc + cp AS score FROM c)
SELECT run_ts, previous_ts, baseline_ts,
  CASE WHEN previous_ts IS NOT NULL THEN dr END AS duplicate_reduction,
  CASE WHEN previous_ts IS NOT NULL THEN co END AS checkpoint_optimization,
  CASE WHEN previous_ts IS NOT NULL THEN pi END AS processing_increase,
  CASE WHEN previous_ts IS NOT NULL THEN cd END AS component_duplicate,
  CASE WHEN previous_ts IS NOT NULL THEN cc END AS component_checkpoint,
  CASE WHEN previous_ts IS NOT NULL THEN cp END AS component_processing,
  CASE WHEN previous_ts IS NOT NULL THEN score END AS score_raw,
  CASE WHEN previous_ts IS NOT NULL THEN {Q.py_round('score', 1)} END AS effectiveness_score,
  CASE WHEN previous_ts IS NULL THEN NULL WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good'
       WHEN score >= 40 THEN 'Fair' WHEN score >= 20 THEN 'Poor' ELSE 'Very Poor' END AS effectiveness_grade,
  CASE WHEN previous_ts IS NULL THEN 'Insufficient history for effectiveness analysis' END AS message
FROM s"""


def _eff(spark, sf):
    return H.effectiveness(H.as_history_row(H.backfill_history(obs_checkpoints(spark, sf))))


@register("history_trends", _effectiveness_sql(Q.OBS_CHECKPOINTS))
def history_trends(spark, sf):
    return _eff(spark, sf)


@register("effectiveness_score", f"SELECT run_ts, effectiveness_score, effectiveness_grade FROM ({_effectiveness_sql(Q.OBS_CHECKPOINTS)})")
def effectiveness_score(spark, sf):
    return _eff(spark, sf).select("run_ts", "effectiveness_score", "effectiveness_grade")


@register("history_topk", f"SELECT * FROM ({_rounded_history_sql(Q.OBS_CHECKPOINTS)}) ORDER BY run_ts DESC LIMIT 7")
def history_topk(spark, sf):
    return H.retained(H.as_history_row(H.backfill_history(obs_checkpoints(spark, sf))), 7)


def _monitor_recs_sql(obs_sql: str) -> str:
    h = _rounded_history_sql(obs_sql)
    e = _effectiveness_sql(obs_sql)
    s = lambda c: f"CAST({c} AS VARCHAR)"
    return f"""WITH m AS (SELECT h.*, e.effectiveness_score FROM ({h}) h JOIN ({e}) e USING (run_ts)),
a AS (SELECT run_ts, list_filter([
  CASE WHEN duplicate_rate > 5.0 THEN {_sql_fill(R.MON_DUPLICATES, s('duplicate_rate'))} END,
  CASE WHEN checkpoint_percentage > 70.0 THEN {_sql_fill(R.MON_CHECKPOINTS, s('checkpoint_percentage'))} END,
  CASE WHEN processing_rate < 10.0 THEN {_sql_fill(R.MON_PROCESSING, s('processing_rate'))} END,
  CASE WHEN effectiveness_score < 40 THEN {Q.sql_quote(R.MON_LOW_EFFECT)} END,
  CASE WHEN effectiveness_score < 40 THEN {Q.sql_quote(R.MON_ADJUST)} END,
  CASE WHEN effectiveness_score > 80 THEN {Q.sql_quote(R.MON_EXCELLENT)} END,
  CASE WHEN avg_daily_activity < 1 THEN {Q.sql_quote(R.MON_ACTIVITY)} END], lambda x: x IS NOT NULL) AS l FROM m),
b AS (SELECT run_ts, CASE WHEN len(l) = 0 THEN [{Q.sql_quote(R.MON_OPTIMAL)}] ELSE l END AS l FROM a)
SELECT run_ts, CAST(i - 1 AS INTEGER) AS ord, l[i] AS recommendation FROM b, range(1, len(l) + 1) t(i)"""


@register("monitor_recommendations", _monitor_recs_sql(Q.OBS_CHECKPOINTS))
def q_monitor_recommendations(spark, sf):
    hist = H.as_history_row(H.backfill_history(obs_checkpoints(spark, sf)))
    eff = H.effectiveness(hist).select("run_ts", "effectiveness_score")
    return R.monitor_recommendations(hist.join(eff, "run_ts"))


# ---------------------------------------------------------------- resolution

RUN_TS = "2024-06-01 12:00:00"


def _groups_docs(spark, sf):
    return D.find_groups(obs_documents(spark, sf))


EXACT_DOCS = _exact_groups_sql(Q.OBS_DOCUMENTS)
EXACT_DOCS_SIZED = f"SELECT g.*, count(*) OVER (PARTITION BY group_id) AS group_size FROM ({EXACT_DOCS}) g"


@register("keep_latest_plan", f"""SELECT 'keep_latest' AS action, group_id, seed_id AS kept_id, member_id AS affected_id,
  rank_in_group, group_size FROM ({EXACT_DOCS_SIZED}) WHERE NOT is_seed""")
def keep_latest_plan(spark, sf):
    return RS.plan(_groups_docs(spark, sf), "keep_latest")


@register("flag_only_plan", f"""SELECT 'flag_only' AS action, group_id, seed_id AS kept_id, member_id AS affected_id,
  rank_in_group, group_size FROM ({EXACT_DOCS_SIZED})""")
def flag_only_plan(spark, sf):
    return RS.plan(_groups_docs(spark, sf), "flag_only")


@register("resolution_totals", f"""SELECT count(*) FILTER (WHERE is_seed) AS groups_processed, count(*) AS records_affected
FROM ({EXACT_DOCS})""")
def resolution_totals(spark, sf):
    return RS.resolution_totals(_groups_docs(spark, sf))


@register("apply_markers_keep_latest", f"""SELECT o.id, CASE WHEN g.member_id IS NULL THEN o.content
  ELSE o.content || ' [DUPLICATE - KEPT ID: ' || CAST(g.seed_id AS VARCHAR) || ']' END AS content
FROM ({Q.OBS_DOCUMENTS}) o LEFT JOIN (SELECT * FROM ({EXACT_DOCS}) WHERE NOT is_seed) g ON g.member_id = o.id""")
def apply_markers_keep_latest(spark, sf):
    obs = obs_documents(spark, sf)
    return RS.apply(obs, D.find_groups(obs), "keep_latest").select("id", "content")


@register("apply_markers_flag_only", f"""SELECT o.id, CASE WHEN g.member_id IS NULL THEN o.content
  ELSE o.content || ' [DUPLICATE GROUP: ' || CAST(g.group_id AS VARCHAR) || ']' END AS content
FROM ({Q.OBS_DOCUMENTS}) o LEFT JOIN ({EXACT_DOCS}) g ON g.member_id = o.id""")
def apply_markers_flag_only(spark, sf):
    obs = obs_documents(spark, sf)
    return RS.apply(obs, D.find_groups(obs), "flag_only").select("id", "content")


MERGE_SQL = f"""WITH g AS ({EXACT_DOCS_SIZED}),
d AS (SELECT group_id, string_agg(strftime(created_at, '%Y-%m-%d %H:%M:%S'), ', ' ORDER BY rank_in_group) AS dates
      FROM g WHERE NOT is_seed GROUP BY group_id)
SELECT g.member_id AS id, o.content || chr(10) || '[MERGED from ' || CAST(g.group_size - 1 AS VARCHAR) || ' duplicates on {RUN_TS}]'
       || chr(10) || '[Original dates: ' || d.dates || ']' AS merged
FROM g JOIN d USING (group_id) JOIN ({Q.OBS_DOCUMENTS}) o ON o.id = g.member_id WHERE g.is_seed"""


@register("merge_plan", MERGE_SQL)
def merge_plan(spark, sf):
    obs = obs_documents(spark, sf)
    return RS.merged_texts(D.find_groups(obs), obs, RUN_TS)


@register("merge_chunks", f"""WITH g AS ({EXACT_DOCS_SIZED})
SELECT g.member_id AS id, CAST(0 AS BIGINT) AS chunk, o.content || chr(10) || '[MERGED from ' || CAST(g.group_size - 1 AS VARCHAR)
       || ' duplicates on {RUN_TS}]' || chr(10) || '[Original dates: ' AS text
FROM g JOIN ({Q.OBS_DOCUMENTS}) o ON o.id = g.member_id WHERE g.is_seed AND g.group_size > 1
UNION ALL
SELECT seed_id, CAST(1 + rank_in_group // 1024 AS BIGINT),
       CASE WHEN rank_in_group // 1024 > 0 THEN ', ' ELSE '' END
       || string_agg(strftime(created_at, '%Y-%m-%d %H:%M:%S'), ', ' ORDER BY rank_in_group)
       || CASE WHEN rank_in_group // 1024 = (max(group_size) - 1) // 1024 THEN ']' ELSE '' END
FROM g WHERE NOT is_seed GROUP BY seed_id, rank_in_group // 1024""")
def merge_chunks(spark, sf):
    """Merged texts as ordered rows of bounded size."""
    obs = obs_documents(spark, sf)
    return RS.merged_chunks(D.find_groups(obs), obs, RUN_TS)


@register("apply_markers_merge", f"""WITH m AS ({MERGE_SQL}), s AS (SELECT * FROM ({EXACT_DOCS}) WHERE NOT is_seed)
SELECT o.id, CASE WHEN m.id IS NOT NULL THEN m.merged
                  WHEN s.member_id IS NOT NULL THEN o.content || ' [MERGED INTO ID: ' || CAST(s.seed_id AS VARCHAR) || ']'
                  ELSE o.content END AS content,
       CASE WHEN m.id IS NOT NULL THEN TIMESTAMP '{RUN_TS}' ELSE o.updated_at END AS updated_at
FROM ({Q.OBS_DOCUMENTS}) o LEFT JOIN m ON m.id = o.id LEFT JOIN s ON s.member_id = o.id""")
def apply_markers_merge(spark, sf):
    obs = obs_documents(spark, sf)
    return RS.apply(obs, D.find_groups(obs), "merge", RUN_TS).select("id", "content", "updated_at")


# ---------------------------------------------------------------- recommendations


def _recs_sql(items: list[str], frm: str) -> str:
    return f"""WITH a AS (SELECT list_filter([{', '.join(items)}], lambda x: x IS NOT NULL) AS l FROM ({frm}))
SELECT CAST(i - 1 AS INTEGER) AS ord, l[i] AS recommendation FROM a, range(1, len(l) + 1) t(i)"""


@register("dedup_recommendations", _recs_sql([
    f"""CASE WHEN duplicate_rate > 10 THEN {_sql_fill(R.DEDUP_HIGH, Q.py_fixed('duplicate_rate', 1))}
        WHEN duplicate_rate > 5 THEN {_sql_fill(R.DEDUP_MEDIUM, Q.py_fixed('duplicate_rate', 1))}
        WHEN duplicate_rate > 1 THEN {_sql_fill(R.DEDUP_LOW, Q.py_fixed('duplicate_rate', 1))}
        ELSE {Q.sql_quote(R.DEDUP_EXCELLENT)} END""",
    f"CASE WHEN duplicate_groups > 0 THEN {Q.sql_quote(R.DEDUP_PREVENTION)} END",
    f"CASE WHEN duplicate_groups > 0 THEN {Q.sql_quote(R.DEDUP_MAINTENANCE)} END",
    Q.sql_quote(R.DEDUP_MONITOR),
    Q.sql_quote(R.DEDUP_THRESHOLDS)], _totals_sql(Q.OBS_DOCUMENTS)))
def q_dedup_recommendations(spark, sf):
    return R.dedup_recommendations(D.summarize(obs_documents(spark, sf)))


CK_SUMMARY = f"""WITH t AS ({CK_TOTALS}), p AS ({CK_PLAN})
SELECT t.*, (SELECT count(*) FROM ({CK_STATS})) AS groups_with_duplicates,
       (SELECT coalesce(sum(space_saved_chars), 0) FROM p) AS space_saved_chars FROM t"""


@register("checkpoint_recommendations", _recs_sql([
    f"CASE WHEN {'checkpoint_observations / total_observations * 100'} > 60 THEN {_sql_fill(R.CK_HIGH_RATIO, Q.py_fixed('checkpoint_observations / total_observations * 100', 1))} END",
    f"CASE WHEN redundant_checkpoints > 10 THEN {_sql_fill(R.CK_MANY, 'CAST(redundant_checkpoints AS VARCHAR)')} END",
    f"CASE WHEN groups_with_duplicates > 5 THEN {_sql_fill(R.CK_PATTERNS, 'CAST(groups_with_duplicates AS VARCHAR)')} END",
    f"""CASE WHEN space_saved_chars > 1000 THEN {_sql_fill(R.CK_SAVINGS, "format('{:,}', CAST(space_saved_chars AS BIGINT))",
                                                            Q.py_fixed('space_saved_chars / 1000', 1))} END""",
    Q.sql_quote(R.CK_AUTOMATION),
    Q.sql_quote(R.CK_MONITORING)], CK_SUMMARY))
def q_checkpoint_recommendations(spark, sf):
    return R.checkpoint_recommendations(C.filter_summary(_ck_ann(spark, sf)))


# ---------------------------------------------------------------- fuzzy dedup

from .plans import candidates as CA  # noqa: E402

FUZZY = DedupConfig(similarity_threshold=0.60)
FUZZY_OUT = GROUP_OUT + ["exact_match", "sequence_similarity", "levenshtein_similarity",
                         "jaccard_similarity", "composite_similarity"]


def _doc_rows(spark, sf):
    prep = D.prepare(obs_documents(spark, sf))
    return prep.filter(F.col("content").isNotNull()).select(
        "id", "created_at", "sk", "norm", D.norm_key(F.col("norm")).alias("key"))


@register("jaccard_pairs", f"""WITH p AS (SELECT id, created_at, {Q.normalize('content')} AS norm FROM ({Q.OBS_DOCUMENTS}) WHERE content IS NOT NULL),
r AS (SELECT norm, first(id ORDER BY {Q.SCAN_ORDER}) AS id, first(created_at ORDER BY {Q.SCAN_ORDER}) AS created_at,
             list_distinct(list_filter(string_split(norm, ' '), lambda w: w <> '')) AS words
      FROM p WHERE length(norm) > 0 GROUP BY norm),
x AS (SELECT a.id AS u_id, b.id AS v_id, len(list_intersect(a.words, b.words)) AS i, len(a.words) AS na, len(b.words) AS nb
      FROM r a JOIN r b ON (a.created_at > b.created_at OR (a.created_at = b.created_at AND a.id > b.id))
      WHERE least(len(a.words), len(b.words)) >= 0.5 * greatest(len(a.words), len(b.words)) - 1e-9)
SELECT u_id, v_id, i / (na + nb - i) AS jaccard FROM x WHERE i / (na + nb - i) >= 0.5""")
def q_jaccard_pairs(spark, sf):
    pairs = CA.jaccard_pairs(_doc_rows(spark, sf), 0.5)
    return pairs.select((-F.col("u")["i"]).alias("u_id"), (-F.col("v")["i"]).alias("v_id"), "jaccard")


# DuckDB's levenshtein counts bytes: letters beyond ASCII become letters that a normalized
# (lower-case) text cannot hold, one byte each
_WIDE, _NARROW = "éèêçàâîïôûùëäöüßñíóáúìòãõœ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_REPS = f"""p AS (SELECT id, created_at, {Q.normalize('content')} AS norm FROM ({Q.OBS_DOCUMENTS}) WHERE content IS NOT NULL),
r AS (SELECT norm, translate(norm, '{_WIDE}', '{_NARROW}') AS narrow, first(id ORDER BY {Q.SCAN_ORDER}) AS id,
             first(created_at ORDER BY {Q.SCAN_ORDER}) AS created_at,
             list_distinct(list_filter(string_split(norm, ' '), lambda w: w <> '')) AS words
      FROM p WHERE length(norm) > 0 GROUP BY norm)"""


def _pair_sql(floor: float) -> str:
    """u, v with word Jaccard from ``floor`` on and their Levenshtein similarity."""
    return f"""j AS MATERIALIZED (SELECT u_id, v_id, x, y, i / (na + nb - i) AS jaccard_similarity FROM (
  SELECT a.id AS u_id, b.id AS v_id, a.narrow AS x, b.narrow AS y, len(list_intersect(a.words, b.words)) AS i, len(a.words) AS na, len(b.words) AS nb
  FROM r a JOIN r b ON (a.created_at > b.created_at OR (a.created_at = b.created_at AND a.id > b.id))
  WHERE least(len(a.words), len(b.words)) >= {floor} * greatest(len(a.words), len(b.words)) - 1e-9)
  WHERE i / (na + nb - i) >= {floor} - 1e-9),
l AS (SELECT u_id, v_id, jaccard_similarity, 1.0 - levenshtein(x, y) / greatest(length(x), length(y)) AS levenshtein_similarity FROM j)"""


@register("similarity_components", f"""WITH {_REPS}, {_pair_sql(0.5)}
SELECT u_id, v_id, 0.0 AS exact_match, levenshtein_similarity, jaccard_similarity FROM l""")
def similarity_components(spark, sf):
    """The components that SQL has too, for pairs of texts with word Jaccard of 0.5 or more."""
    both = CA.jaccard_pairs(_doc_rows(spark, sf), 0.5, edits=True)
    return both.select((-F.col("u")["i"]).alias("u_id"), (-F.col("v")["i"]).alias("v_id"), F.col("exact").alias("exact_match"),
                       F.col("lev").alias("levenshtein_similarity"), F.col("jaccard").alias("jaccard_similarity"))


NO_SEQUENCE = DedupConfig(similarity_threshold=0.6, weights=Weights(0.3, 0.0, 0.35, 0.35))



def _groups_sql(reps: str, floor: float, reach: str) -> str:
    """Greedy groups of the texts ``reps``, where pairs with ``reach`` are similar."""
    return f"""WITH RECURSIVE {reps}, {_pair_sql(floor)},
e AS MATERIALIZED (SELECT * FROM l WHERE {reach}),
k AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY {Q.SCAN_ORDER}) AS k FROM r WHERE id IN (SELECT u_id FROM e UNION SELECT v_id FROM e)),
n AS MATERIALIZED (SELECT v.k, list(u.k) FILTER (WHERE u.k IS NOT NULL) AS before FROM k v LEFT JOIN e ON e.v_id = v.id LEFT JOIN k u ON u.id = e.u_id GROUP BY v.k),
s AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS seeds
      UNION ALL SELECT n.k, CASE WHEN list_has_any(s.seeds, coalesce(n.before, [])) THEN s.seeds ELSE list_append(s.seeds, n.k) END
      FROM s JOIN n ON n.k = s.k + 1),
f AS (SELECT seeds FROM s ORDER BY k DESC LIMIT 1),
o AS (SELECT n.k, CASE WHEN list_contains(f.seeds, n.k) THEN n.k ELSE list_min(list_intersect(f.seeds, n.before)) END AS seed_k FROM n, f),
c AS (SELECT r.norm, r.id AS rep_id, coalesce(t.id, r.id) AS seed_rep FROM r LEFT JOIN k ON k.id = r.id LEFT JOIN o ON o.k = k.k LEFT JOIN k t ON t.k = o.seed_k
      UNION ALL SELECT '' AS norm, first(id ORDER BY {Q.SCAN_ORDER}) AS rep_id, first(id ORDER BY {Q.SCAN_ORDER}) AS seed_rep FROM p WHERE length(norm) = 0 HAVING count(*) > 0),
m AS (SELECT p.id, p.created_at, c.rep_id, c.seed_rep, count(*) OVER (PARTITION BY c.seed_rep) AS size,
             row_number() OVER (PARTITION BY c.seed_rep ORDER BY {Q.SCAN_ORDER.replace('created_at', 'p.created_at').replace(' id', ' p.id')}) - 1 AS rank_in_group
      FROM p JOIN c USING (norm)),
g AS (SELECT seed_rep, row_number() OVER (ORDER BY {Q.SCAN_ORDER}) - 1 AS group_id FROM m WHERE size > 1 AND id = seed_rep)
SELECT group_id, m.seed_rep AS seed_id, m.id AS member_id, CAST(rank_in_group AS INTEGER) AS rank_in_group, rank_in_group = 0 AS is_seed, m.created_at,
  CASE WHEN rank_in_group = 0 THEN NULL WHEN m.rep_id = m.seed_rep THEN 1.0 ELSE e.levenshtein_similarity END AS levenshtein_similarity,
  CASE WHEN rank_in_group = 0 THEN NULL WHEN m.rep_id = m.seed_rep THEN 1.0 ELSE e.jaccard_similarity END AS jaccard_similarity
FROM m JOIN g ON g.seed_rep = m.seed_rep LEFT JOIN e ON e.u_id = m.seed_rep AND e.v_id = m.rep_id"""


@register("dedup_groups_no_sequence", _groups_sql(_REPS, (0.6 - 0.35) / 0.35, "levenshtein_similarity * 0.35 + jaccard_similarity * 0.35 >= 0.6"))
def dedup_groups_no_sequence(spark, sf):
    """Greedy seed groups at threshold 0.60 without the sequence ratio, which SQL lacks."""
    return D.find_groups(obs_documents(spark, sf), NO_SEQUENCE).select(
        *GROUP_OUT, "levenshtein_similarity", "jaccard_similarity")


@register("fuzzy_pairs")
def fuzzy_pairs(spark, sf):
    """Verified similarity edges at threshold 0.60 between distinct normalized texts."""
    texts = cut_lineage(CA.texts_of(_doc_rows(spark, sf)), "zstd")
    e = CA.scored_edges(texts, FUZZY)
    return e.select((-F.col("u")["i"]).alias("u_id"), (-F.col("v")["i"]).alias("v_id"),
                    "exact_match", "sequence_similarity", "levenshtein_similarity",
                    "jaccard_similarity", "composite_similarity")


@register("dedup_groups")
def dedup_groups(spark, sf):
    """Greedy seed groups at threshold 0.60 (fuzzy path), with seed-member scores."""
    return D.find_groups(obs_documents(spark, sf), FUZZY).select(*FUZZY_OUT)


@register("dedup_groups_conversations")
def dedup_groups_conversations(spark, sf):
    """Negative control: conversations hold no near-duplicate pair at 0.60."""
    return D.find_groups(obs_conversations(spark, sf), FUZZY).select(*FUZZY_OUT)


@register("fuzzy_totals")
def fuzzy_totals(spark, sf):
    return D.summarize(obs_documents(spark, sf), FUZZY)


# page addresses: one word each, so that no Jaccard floor exists and only edits tell
OBS_URLS = f"""SELECT page_id AS id, url AS content, {Q.EPOCH} + to_minutes(page_id) AS created_at, CAST(NULL AS VARCHAR) AS entity_name,
  CAST(NULL AS TIMESTAMP) AS updated_at FROM pages"""
EDITS = DedupConfig(similarity_threshold=0.85, weights=Weights(0.0, 0.0, 1.0, 0.0))
_URL_REPS = _REPS.replace(Q.OBS_DOCUMENTS, OBS_URLS)


def obs_urls(spark, sf):
    pages = read_table(spark, sf, "pages")
    return as_observations(pages.withColumn("_t", F.expr(f"timestampadd(MINUTE, page_id, TIMESTAMP_NTZ'{ADAPTER_EPOCH}')")),
                           id_col="page_id", content_col="url", created_at_col="_t")


@register("edit_pairs_urls", f"""WITH {_URL_REPS}, {_pair_sql(0.0)}
SELECT u_id, v_id, levenshtein_similarity FROM l WHERE levenshtein_similarity >= 0.85""")
def edit_pairs_urls(spark, sf):
    """Pairs of addresses within 15 % of edits, by the partition join."""
    prep = D.prepare(obs_urls(spark, sf)).filter(F.col("content").isNotNull())
    reps = cut_lineage(CA.representatives(prep.select("id", "sk", "norm", D.norm_key(F.col("norm")).alias("key"))))
    e = CA.scored_edges(reps, EDITS)
    return e.select((-F.col("u")["i"]).alias("u_id"), (-F.col("v")["i"]).alias("v_id"), "levenshtein_similarity")


@register("dedup_groups_urls", _groups_sql(_URL_REPS, 0.0, "levenshtein_similarity >= 0.85"))
def dedup_groups_urls(spark, sf):
    """Greedy seed groups where no Jaccard floor prunes."""
    return D.find_groups(obs_urls(spark, sf), EDITS).select(*GROUP_OUT, "levenshtein_similarity", "jaccard_similarity")


# ---------------------------------------------------------------- semantic search

from .operators import search as SE  # noqa: E402

_VECTORS = """SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, len(embedding) AS dim FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""


@register("semantic_search", f"""WITH e AS ({_VECTORS}),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, CASE WHEN q.dim = e.dim THEN list_cosine_similarity(q.v, e.v) END AS score
      FROM e q JOIN e ON q.dim = e.dim AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def semantic_search(spark, sf):
    """Ten most similar vectors of every twentieth vector, exactly."""
    vectors = spark.read.parquet(f"{sf.rstrip('/')}/embeddings.parquet")
    found = SE.nearest(vectors, vectors.where("vec_id % 20 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def _quality_sql(obs_sql: str) -> str:
    return f"""WITH o AS ({obs_sql}), d AS (SELECT id, count(*) AS n FROM o GROUP BY id HAVING count(*) > 1),
b AS (SELECT count(*) AS total_records, CAST(coalesce(sum(octet_length(encode(content))), 0) AS BIGINT) AS content_bytes,
             CAST(coalesce(sum(length(content)), 0) AS BIGINT) AS content_chars,
             count(*) FILTER (WHERE content IS NULL) AS null_content,
             count(*) FILTER (WHERE created_at IS NULL) AS null_created_at,
             count(*) FILTER (WHERE length(content) = 0) AS empty_content FROM o)
SELECT total_records, content_bytes, content_chars,
  CASE WHEN total_records > 0 THEN content_bytes / total_records ELSE 0.0 END AS avg_bytes_per_record,
  null_content, CASE WHEN total_records > 0 THEN null_content / total_records ELSE 0.0 END AS null_content_ratio,
  null_created_at, CASE WHEN total_records > 0 THEN null_created_at / total_records ELSE 0.0 END AS null_created_at_ratio,
  empty_content,
  1.0 - CASE WHEN total_records > 0 THEN (null_content + empty_content) / total_records ELSE 0.0 END AS completeness,
  (SELECT count(*) FROM d) AS duplicate_ids, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM d) AS rows_with_duplicate_id
FROM b"""


@register("quality_metrics", _quality_sql(Q.OBS_DOCUMENTS))
def quality_metrics(spark, sf):
    return M.quality_metrics(obs_documents(spark, sf))


@register("quality_metrics_checkpoints", _quality_sql(Q.OBS_CHECKPOINTS))
def quality_metrics_checkpoints(spark, sf):
    return M.quality_metrics(obs_checkpoints(spark, sf))


# ---------------------------------------------------------------- archiving

from .operators import archive as AR  # noqa: E402

ARCHIVE_DAYS = 14


@register("archive_stubbed", f"""SELECT id, CASE WHEN created_at < TIMESTAMP '{AS_OF}' - INTERVAL {ARCHIVE_DAYS} DAYS
  THEN '[ARCHIVED ' || strftime(created_at, '%Y-%m') || ']' ELSE content END AS content, created_at
FROM ({Q.OBS_CHECKPOINTS})""")
def archive_stubbed(spark, sf):
    return AR.stubbed(obs_checkpoints(spark, sf), AS_OF, ARCHIVE_DAYS).select("id", "content", "created_at")


@register("archive_manifest", f"""SELECT count(*) AS rows, CAST(coalesce(sum(octet_length(encode(content))), 0) AS BIGINT) AS content_bytes,
  min(created_at) AS oldest, max(created_at) AS newest
FROM ({Q.OBS_CHECKPOINTS}) WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL {ARCHIVE_DAYS} DAYS""")
def archive_manifest(spark, sf):
    return AR.manifest(AR.cold_rows(obs_checkpoints(spark, sf), AS_OF, ARCHIVE_DAYS)).drop("checksum")


@register("archive_months", f"""SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS rows, CAST(coalesce(sum(octet_length(encode(content))), 0) AS BIGINT) AS content_bytes,
  min(created_at) AS oldest, max(created_at) AS newest
FROM ({Q.OBS_CHECKPOINTS}) WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL {ARCHIVE_DAYS} DAYS GROUP BY month""")
def archive_months(spark, sf):
    return AR.month_manifest(AR.cold_rows(obs_checkpoints(spark, sf), AS_OF, ARCHIVE_DAYS)).drop("checksum")


@register("archive_restore", f"SELECT id, content, created_at FROM ({Q.OBS_CHECKPOINTS})")
def archive_restore(spark, sf):
    """Archive written, live table stubbed, months verified and put back: the rows as they were."""
    obs, path = obs_checkpoints(spark, sf), scratch_path(spark, f"archive-{uuid.uuid4().hex}", scoped=True)
    AR.write_archive(obs, path, AS_OF, ARCHIVE_DAYS)
    return AR.restore_months(AR.stubbed(obs, AS_OF, ARCHIVE_DAYS), path).select("id", "content", "created_at")


# ---------------------------------------------------------------- jobs

from . import jobs as J  # noqa: E402


def _job_folders(spark):
    base = scratch_path(spark, f"job-{uuid.uuid4().hex}", scoped=True)
    return SnapshotStore(spark, f"{base}/table"), f"{base}/run"


@register("job_dedup", ORACLE["apply_markers_keep_latest"])
def job_dedup(spark, sf):
    """The table version that the deduplication job commits."""
    store, out = _job_folders(spark)
    J.run_dedup(spark, obs_documents(spark, sf), out, strategy="keep_latest", apply=True, store=store)
    return store.read().select("id", "content")


@register("job_dedup_totals", ORACLE["dedup_totals"])
def job_dedup_totals(spark, sf):
    """The totals that the job's dry run writes."""
    _, out = _job_folders(spark)
    return J.run_dedup(spark, obs_documents(spark, sf), out, strategy="flag_only")["totals"]


@register("job_checkpoint_filter", CK_APPLY)
def job_checkpoint_filter(spark, sf):
    """The table version that the checkpoint job commits."""
    store, out = _job_folders(spark)
    J.run_checkpoint_filter(spark, obs_checkpoints(spark, sf), out, apply=True, store=store)
    return store.read().select("id", "content", "created_at")


@register("job_no_duplicates", f"SELECT 'no_duplicates_found' AS status, count(*) AS total_records, 0 AS duplicate_groups FROM (SELECT id FROM ({Q.OBS_DOCUMENTS}))")
def job_no_duplicates(spark, sf):
    """The job's early end: texts made unique by their id leave nothing to resolve."""
    _, out = _job_folders(spark)
    unique = obs_documents(spark, sf).withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit(" id"), F.col("id").cast("string")))
    done = J.run_dedup(spark, unique, out, strategy="keep_latest")
    return spark.read.json(done["report"]).select("status", "summary.total_records", F.col("summary.duplicate_groups").cast("int").alias("duplicate_groups"))


# ---------------------------------------------------------------- scan order

from .plans.ordering import dense_index, scan_key  # noqa: E402


@register("scan_order", f"""SELECT id, created_at, row_number() OVER (ORDER BY {Q.SCAN_ORDER}) - 1 AS scan_rank
FROM ({Q.OBS_CHECKPOINTS})""")
def scan_order(spark, sf):
    """Global newest-first rank (ties by id, NULL times last), numbered without a
    single-partition window."""
    obs = obs_checkpoints(spark, sf).select("id", "created_at", scan_key().alias("sk"))
    return dense_index(obs, [F.col("sk")], "scan_rank").select("id", "created_at", "scan_rank")
