from pyspark.sql import functions as F

from conftest import SF001, obs_frame
from scrubjay.operators import dedup as D
from scrubjay.operators import resolve as RS
from scrubjay.sources.observations import obs_documents

RUN_TS = "2024-06-01 12:00:00"


def assembled(chunks):
    out = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.id, r.chunk)):
        out.setdefault(r.id, []).append(r)
    assert all([c.chunk for c in rows] == list(range(len(rows))) for rows in out.values())
    return {i: "".join(c.text for c in rows) for i, rows in out.items()}


def merged(groups, obs):
    return {r.id: r.merged for r in RS.merged_texts(groups, obs, RUN_TS).collect()}


def test_hot_group_has_no_growing_cell(spark):
    n = 9_000  # a third is one text
    df = spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot row")).otherwise(F.concat(F.lit("row "), (F.col("id") % 500).cast("string"))).alias("content"),
        F.expr("timestampadd(SECOND, id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("created_at"),
        F.lit(None).cast("string").alias("entity_name"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    groups = D.find_groups(df).cache()
    chunks = RS.merged_chunks(groups, df, RUN_TS).cache()
    assert chunks.agg(F.max(F.length("text"))).first()[0] <= 21 * 1024 + 2
    assert chunks.filter("id = 8997").count() == 1 + 3
    assert assembled(chunks) == merged(groups, df)


def test_small_groups_and_missing_times(spark):
    obs = obs_frame(spark, [(1, "a", "2024-01-01 00:00:01"), (2, "a", None), (3, "a", "2024-01-01 00:00:03"), (4, "b", None), (5, "b", None),
                            (6, "alone", "2024-01-01 00:00:01"), (7, None, None), (8, None, None)])
    groups = D.find_groups(obs)
    got = assembled(RS.merged_chunks(groups, obs, RUN_TS))
    assert got == merged(groups, obs) and set(got) == {3, 5}
    assert got[3] == f"a\n[MERGED from 2 duplicates on {RUN_TS}]\n[Original dates: 2024-01-01 00:00:01]"
    assert got[5].endswith("[Original dates: ]")
    assert RS.merged_chunks(groups.limit(0), obs, RUN_TS).collect() == []


def test_bucket_without_times_leaves_no_stray_separator(spark, monkeypatch):
    monkeypatch.setattr(RS, "_MERGE_BUCKET", 2)
    obs = obs_frame(spark, [(i, "a", f"2024-01-01 00:00:0{i}" if i > 5 else None) for i in range(1, 9)])
    groups = D.find_groups(obs)
    got = assembled(RS.merged_chunks(groups, obs, RUN_TS))
    assert got == merged(groups, obs)
    assert got[8].endswith("[Original dates: 2024-01-01 00:00:07, 2024-01-01 00:00:06]")


def test_documents(spark):
    obs = obs_documents(spark, SF001)
    groups = D.find_groups(obs)
    assert assembled(RS.merged_chunks(groups, obs, RUN_TS)) == merged(groups, obs)
