"""Spark session and lineage helpers.

Every operator in the package is a DataFrame -> DataFrame function; this module only
builds a session with the settings the operators assume (UTC session time zone, AQE
with skew-join splitting, UI off) and offers the one lineage cut the iterative jobs
need.
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  AQE re-plans joins at runtime and splits skewed
# partitions; the session time zone pins date formatting and DATE(ts) to UTC.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "scrubjay",
              shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled"):
        spark.conf.set(k, settings[k])
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in executor Python workers (the Arrow UDFs pickle
    references to its functions): zip it once per SparkContext and ``addPyFile`` it,
    which is how Spark distributes Python code to every executor of a cluster."""
    sc = spark.sparkContext
    if getattr(sc, "_scrubjay_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="scrubjay-pkg-")
    zip_path = os.path.join(out_dir, "scrubjay.zip")
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zip_path)
    sc._scrubjay_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.  Only a
    single-machine session (master ``local[...]``) may do without: it gets a scratch
    folder of its own.  On a cluster a machine-local folder would lose what other
    executors write, so a missing setting is an error there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share "
                             f"(master is {sc.master})")
        configured = tempfile.mkdtemp(prefix="scrubjay-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Used between rounds of the iterative grouping and before numbering rows by
    partition offsets: a lost executor then re-reads the written files instead of
    replaying (possibly non-deterministic) upstream stages.  One job, where
    ``DataFrame.checkpoint`` needs the input computed twice or cached first.  Inside a
    :func:`scratch_scope` the folder goes when the scope ends."""
    spark = df.sparkSession
    path = scratch_path(spark, f"cut-{uuid.uuid4().hex}", scoped=True)
    df.write.mode("errorifexists").parquet(path, compression=compression)
    return spark.read.parquet(path)


class _Scopes(threading.local):
    """Cut tables written by this thread since its outermost scope began."""

    def __init__(self):
        self.paths: list[str] = []


_scopes = _Scopes()


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Delete the cut tables that are written inside when the block ends, failed or not.
    Nothing that still reads them may leave the block; jobs return paths and small rows."""
    start = len(_scopes.paths)
    try:
        yield
    finally:
        done, _scopes.paths[start:] = _scopes.paths[start:], []
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in done:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Round-robin an input that arrives in too few partitions (a single large file)
    before CPU-heavy text expressions.  Only on request: it shuffles whole rows."""
    return df if partitions is None else df.repartition(partitions)


def scratch_path(spark: SparkSession, name: str, scoped: bool = False) -> str:
    """A sub-folder of the shared checkpoint folder for intermediate tables; ``scoped``
    ones go when the current :func:`scratch_scope` ends."""
    path = os.path.join(ensure_checkpoint_dir(spark), "scrubjay-tables", name)
    if scoped:
        _scopes.paths.append(path)
    return path
