import os

from pyspark.sql import functions as F

from conftest import SF001
from scrubjay.operators import archive as AR
from scrubjay.operators import metrics as M
from scrubjay.sources.observations import obs_checkpoints


def test_archive_roundtrip(spark, tmp_dir):
    obs = obs_checkpoints(spark, SF001)
    path = os.path.join(tmp_dir, "arch")
    m = AR.write_archive(obs, path, "2024-01-31 00:00:00", 14).collect()[0]
    rows = spark.read.parquet(f"{path}/rows")
    assert m.rows == rows.count() == obs.filter(F.col("created_at") < F.lit("2024-01-17").cast("timestamp_ntz")).count()
    assert AR.verify(rows, spark.read.parquet(f"{path}/manifest")).collect()[0].intact
    live = AR.stubbed(obs, "2024-01-31 00:00:00", 14)
    snap = M.snapshot(live, "2024-01-31 00:00:00").collect()[0]
    assert snap.processed_records == m.rows           # stubs count as processed
    back = AR.restore(live, rows.drop("month"))
    assert back.exceptAll(obs).count() == 0 and obs.exceptAll(back).count() == 0
    # tampering is detected
    bad = rows.withColumn("content", F.when(F.col("id") == F.lit(m.rows // 2), F.lit("x")).otherwise(F.col("content")))
    assert not AR.verify(bad, spark.read.parquet(f"{path}/manifest")).collect()[0].intact


def test_null_texts_and_second_archive(spark):
    from conftest import obs_frame
    obs = obs_frame(spark, [(1, None, "2024-01-01 00:00:00"), (2, "old", "2024-01-02 00:00:00"), (3, "mid", "2024-02-01 00:00:00"), (4, "new", "2024-03-01 00:00:00")])
    first = AR.cold_rows(obs, "2024-02-20 00:00:00")
    live = AR.stubbed(obs, "2024-02-20 00:00:00")
    second = AR.cold_rows(live, "2024-03-20 00:00:00")
    assert [r.id for r in second.collect()] == [3] and second.first().content == "mid"
    live = AR.stubbed(live, "2024-03-20 00:00:00")
    back = AR.restore(live, first.unionByName(second).drop("month"))
    assert sorted((r.id, r.content) for r in back.collect()) == [(1, None), (2, "old"), (3, "mid"), (4, "new")]


def test_months_verified_and_restored_alone(spark, tmp_dir):
    import pytest

    from conftest import obs_frame
    rows = [(i, None if i == 3 else f"text {i}", f"2024-0{1 + i % 4}-0{1 + i % 9} 00:00:00") for i in range(40)]
    obs, path = obs_frame(spark, rows), os.path.join(tmp_dir, "arch")
    AR.write_archive(obs, path, "2024-06-01 00:00:00")
    live = AR.stubbed(obs, "2024-06-01 00:00:00")
    state = {r.month: (r.rows, r.intact) for r in AR.verify_months(spark, path).collect()}
    assert state == {f"2024-0{m}": (10, True) for m in (1, 2, 3, 4)}
    back = AR.restore_months(live, path, ["2024-02"])
    assert {r.id for r in back.exceptAll(live).collect()} == {i for i in range(40) if i % 4 == 1}
    plan = AR.verify_months(spark, path, ["2024-02"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-02" in plan
    # one month tampered with: it is named, the others can still be restored
    folder = f"{path}/rows/month=2024-03"
    spark.read.parquet(folder).withColumn("content", F.lit("x")).coalesce(1).write.parquet(os.path.join(tmp_dir, "bad"))
    spark.read.parquet(os.path.join(tmp_dir, "bad")).write.mode("overwrite").parquet(folder)
    with pytest.raises(AR.ArchiveDamaged, match="in 2024-03$"):
        AR.restore_months(live, path)
    with pytest.raises(AR.ArchiveDamaged, match="2023-01"):
        AR.restore_months(live, path, ["2023-01", "2024-01"])
    assert AR.restore_months(live, path, ["2024-01", "2024-04"]).exceptAll(obs).count() == 20
    # a month manifest that does not add up to the total
    spark.read.parquet(f"{path}/months").where("month <> '2024-03'").coalesce(1).write.parquet(os.path.join(tmp_dir, "m"))
    spark.read.parquet(os.path.join(tmp_dir, "m")).write.mode("overwrite").parquet(f"{path}/months")
    with pytest.raises(AR.ArchiveDamaged, match="sum up"):
        AR.verify_months(spark, path)
