import os

from pyspark.sql import functions as F

from conftest import SF001
from scrubjay.operators import checkpoints as C
from scrubjay.sources.observations import obs_checkpoints, obs_documents
from scrubjay.streaming.checkpoint_stream import checkpoint_counts
from scrubjay.streaming.dedup_stream import prevent_duplicates


def _run(spark, sdf, name, mode="append"):
    q = sdf.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"SELECT * FROM {name}")


def test_stream_duplicate_prevention(spark, tmp_dir):
    src = os.path.join(tmp_dir, "docs")
    obs = obs_documents(spark, SF001)
    obs.write.parquet(src)
    stream = spark.readStream.schema(obs.schema).parquet(src)
    out = _run(spark, prevent_duplicates(stream, "365 days"), "dedup_stream_out")
    n_distinct = obs.filter(F.col("content").isNotNull()).select(
        __import__("scrubjay.functions.text", fromlist=["x"]).normalize_text("content")).distinct().count()
    assert out.count() == n_distinct


def test_stream_checkpoint_counts(spark, tmp_dir):
    src = os.path.join(tmp_dir, "ck")
    obs = obs_checkpoints(spark, SF001)
    obs.write.parquet(src)
    stream = spark.readStream.schema(obs.schema).parquet(src)
    out = _run(spark, checkpoint_counts(stream, "1 day", "1 hour"), "ck_stream_out")
    got = {(r.signature, str(r.window.start)[:10]): r["count"] for r in out.collect()}
    ann = C.annotate(obs).filter("is_checkpoint").withColumn("day", F.to_date("created_at"))
    want = {(r.signature, str(r.day)): r["count"] for r in ann.groupBy("signature", "day").count().collect()}
    # windows end before the watermark (latest time less an hour) or stay open
    last = ann.agg(F.date_trunc("day", F.max(F.col("created_at").cast("timestamp")) - F.expr("INTERVAL 1 HOUR"))).first()[0]
    closed = {k: n for k, n in want.items() if k[1] < str(last)[:10]}
    assert closed and got == closed


def test_rows_without_content_are_not_repeats(spark, tmp_dir):
    from conftest import obs_frame
    obs = obs_frame(spark, [(1, None, "2024-01-01 00:00:00"), (2, None, "2024-01-01 00:00:00"), (3, "a", "2024-01-01 00:00:00"), (4, "A!", "2024-01-01 00:00:00")])
    src = os.path.join(tmp_dir, "nulls")
    obs.coalesce(1).write.parquet(src)
    out = _run(spark, prevent_duplicates(spark.readStream.schema(obs.schema).parquet(src), "1 day"), "null_stream_out")
    assert sorted(r.id for r in out.collect())[:2] == [1, 2] and out.count() == 3


def test_newest_is_kept_as_in_batch(spark, tmp_dir):
    """Several micro-batches in any order leave the survivors of batch keep_latest."""
    import random

    from conftest import obs_frame
    from scrubjay.functions.text import normalize_text
    from scrubjay.streaming.newest_stream import keep_newest
    rnd = random.Random(6)
    rows = [(i, rnd.choice([None, "Same text", "same TEXT!", "other", f"own {chr(97 + i % 26)}", "x y"]), f"2024-01-01 0{rnd.randrange(6)}:00:00") for i in range(80)]
    rows += [rows[5], rows[6]]
    src = os.path.join(tmp_dir, "arrivals")
    for k in range(0, len(rows), 30):
        obs_frame(spark, rows[k:k + 30]).coalesce(1).write.mode("append").parquet(src)
    schema = obs_frame(spark, rows).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = _run(spark, keep_newest(stream, "1 day"), "newest_stream_out").collect()
    replaced = {r.replaced_id for r in out if r.replaced_id is not None}
    want = {}
    for r in obs_frame(spark, rows).withColumn("k", normalize_text("content")).collect():
        key = r.k if r.content is not None else ("id", r.id)
        want[key] = max(want.get(key, (r.created_at, r.id)), (r.created_at, r.id))
    assert {r.id for r in out} - replaced == {i for _, i in want.values()}
    assert replaced and all(len({r.id for r in out if bytes(r.norm_key) == k} - replaced) == 1 for k in {bytes(r.norm_key) for r in out})
