import os
import threading

import pytest
from pyspark.sql import functions as F

from scrubjay.sources.storage import CommitConflict, SnapshotStore


def _store(spark, tmp_dir):
    return SnapshotStore(spark, os.path.join(tmp_dir, "table"))


def test_versions_and_reads(spark, tmp_dir):
    store = _store(spark, tmp_dir)
    assert store.current() is None and store.versions() == []
    with pytest.raises(FileNotFoundError):
        store.read()
    assert [store.write(spark.range(n)) for n in (3, 5)] == [1, 2]
    assert store.versions() == [1, 2] and store.read().count() == 5 and store.read(1).count() == 3


def test_two_writers_never_share_a_version(spark, tmp_dir):
    store, got, gate = _store(spark, tmp_dir), [], threading.Barrier(4)

    def write(n):
        gate.wait()
        got.append((SnapshotStore(spark, store.root).write(spark.range(n)), n))

    threads = [threading.Thread(target=write, args=(10 + i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(v for v, _ in got) == [1, 2, 3, 4] == store.versions()
    for version, n in got:
        assert store.read(version).count() == n


def test_a_version_that_was_read_can_be_required(spark, tmp_dir):
    store = _store(spark, tmp_dir)
    store.write(spark.range(1))
    base = store.current()
    store.write(spark.range(2), base=base)
    with pytest.raises(CommitConflict, match="version 2"):
        store.write(spark.range(99), base=base)
    assert store.versions() == [1, 2] and store.read().count() == 2
    # an update is computed again on what the other writer has left
    raced = []

    def grow(df):
        if not raced:
            raced.append(store.write(spark.range(7)))
        return df.union(df)

    assert store.update(grow) == 4
    assert store.read().count() == 14


def test_update_gives_up_after_its_attempts(spark, tmp_dir):
    store = _store(spark, tmp_dir)
    store.write(spark.range(1))

    def always_late(df):
        store.write(spark.range(1))
        return df

    with pytest.raises(CommitConflict):
        store.update(always_late, attempts=2)


def test_failed_write_leaves_the_version_and_can_be_repeated(spark, tmp_dir):
    store = _store(spark, tmp_dir)
    store.write(spark.range(4))
    broken = spark.range(8, numPartitions=4).withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        store.write(broken)
    assert store.versions() == [1] and store.read().count() == 4
    assert store.write(spark.range(6)) == 2 and store.read().count() == 6
    assert sorted(d for d in os.listdir(store.root) if d.startswith("v=")) == ["v=000001", "v=000002"]


def test_versions_without_a_record_are_read(spark, tmp_dir):
    """Tables of the layout before commit records: a folder with ``_SUCCESS`` counts."""
    store = _store(spark, tmp_dir)
    spark.range(3).write.parquet(f"{store.root}/v=000001")
    assert store.current() == 1 and store.read().count() == 3
    assert store.write(spark.range(4)) == 2 and store.versions() == [1, 2]
