from pyspark.sql import functions as F

from conftest import SF001, obs_frame
from scrubjay.config import CheckpointConfig
from scrubjay.operators import checkpoints as C
from scrubjay.sources.observations import obs_checkpoints


def _long_rows(n, start=1, minute0=0):
    return [(start + k, f"auto-sync - Sincronización automática del repositorio principal, vuelta {k + 1}",
             f"2024-02-01 10:{minute0 + 7 * k:02d}:00") for k in range(n)]


def test_groups_summary_and_interval(spark):
    obs = obs_frame(spark, _long_rows(5))
    ann = C.annotate(obs)
    g = C.checkpoint_groups(ann).collect()
    assert len(g) == 1 and g[0]["count"] == 5
    assert g[0].avg_interval_min == 7.0 and g[0].frequency == "~7.0 min"
    assert g[0].sample_content.endswith("vuelta 5...")
    # the telescoped mean equals the mean of consecutive gaps
    ts = sorted(r.created_at for r in obs.collect())
    gaps = [(b - a).total_seconds() / 60 for a, b in zip(ts, ts[1:])]
    assert abs(sum(gaps) / len(gaps) - g[0].avg_interval_min) < 1e-9


def test_gate_threshold(spark):
    for n, acts in ((5, 0), (6, 1), (7, 1)):   # redundant = n - 1; threshold 5
        obs = obs_frame(spark, _long_rows(n))
        plan = C.consolidation_plan(C.annotate(obs)).collect()
        assert len(plan) == acts, n
        if acts:
            p = plan[0]
            assert p.consolidated_content == (f"SUMMARY: {n} automatic checkpoints from 2024-02-01 10:00 "
                                              f"to 2024-02-01 10:{7 * (n - 1):02d} - ~7.0 min")
            total = sum(len(r.content) for r in obs.collect())
            assert p.space_saved_chars == total - len(p.consolidated_content)


def test_prefix_mode_and_apply(spark):
    rows = _long_rows(6) + [(100, "note mentioning auto-sync - Sincronización automática del repositorio principal, vuelta 9 too",
                             "2024-02-01 11:00:00")]
    obs = obs_frame(spark, rows)
    cfg = CheckpointConfig(refetch_mode="prefix")
    plan = C.consolidation_plan(C.annotate(obs, cfg), cfg).collect()
    assert len(plan) == 1 and plan[0].records_affected == 7   # the note matches the 50-char prefix too
    after = {r.id: r.content for r in C.consolidate_apply(obs, cfg).collect()}
    assert after[100].endswith(" [CONSOLIDATED]") and after[1].endswith(" [CONSOLIDATED]")
    assert after[101].startswith("SUMMARY: 7 automatic checkpoints")
    sig = {r.id: r.content for r in C.consolidate_apply(obs).collect()}
    assert not sig[100].endswith("[CONSOLIDATED]")


def test_events_fixture_totals(spark):
    ann = C.annotate(obs_checkpoints(spark, SF001))
    t = C.checkpoint_totals(ann).collect()[0]
    e = spark.read.parquet(f"{SF001}/events.parquet")
    n_ck = e.filter(F.col("event_type").isin("view", "click", "error")).count()
    assert t.total_observations == e.count()
    assert t.checkpoint_observations == n_ck
    assert t.checkpoint_groups == 3
    assert t.redundant_checkpoints == n_ck - 3


def test_prefix_like_wildcards_and_backslash(spark):
    # the 50-char prefix holds '%' and '_' (wildcards, as in the reference's unescaped
    # LIKE) and a backslash before an ordinary letter (PostgreSQL drops it; Spark would raise)
    base = "auto-sync - Sincronización automática 100% a_b c\\d, vuelta "
    rows = [(k + 1, base + str(k), f"2024-03-01 10:{k:02d}:00") for k in range(7)]
    rows.append((50, "auto-sync - Sincronización automática 100 XYZ aQb cd, vuelta 9", "2024-03-01 11:00:00"))
    rows.append((51, "auto-sync - Sincronización automática 100 XYZ aQb c, vuelta 9", "2024-03-01 11:01:00"))
    obs = obs_frame(spark, rows)
    cfg = CheckpointConfig(refetch_mode="prefix")
    ann = C.annotate(obs, cfg)
    hits = C.refetch_prefix(ann, C.checkpoint_groups(ann)).collect()
    ids = {r.id for r in hits}
    # '%' and '_' match any text and '\d' reads as a literal 'd' (PostgreSQL LIKE), so the
    # pattern needs "cd": row 50 matches, while the group's own rows ("c\d") and row 51
    # ("c,") do not, exactly as the reference's database would answer
    assert ids == {50}
