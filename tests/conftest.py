import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from scrubjay.session import get_spark
    s = get_spark("local[4]", app="scrubjay-tests", shuffle_partitions=4,
                  conf={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="scrubjay-test-ckpt-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="scrubjay-test-")


def obs_frame(spark, rows):
    """rows: (id, content, created_at 'YYYY-mm-dd HH:MM:SS' or None[, entity])."""
    from pyspark.sql import functions as F
    data = [(r[0], r[1], r[2], r[3] if len(r) > 3 else None) for r in rows]
    df = spark.createDataFrame(data, "id long, content string, created_at string, entity_name string")
    return df.select("id", "content", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                     "entity_name", F.lit(None).cast("timestamp_ntz").alias("updated_at"))
