"""Sinks: versioned table snapshots and JSON reports.

Nothing is updated in place.  Each job writes a new snapshot version of the table: first
the data, into a folder named by the writer, then a commit record ``_commits/000007``
that names this folder.  The record is put only if it is absent (``create`` without
overwriting), so of two writers one gets the version and the other takes the next, or
an error if it asked for the version it had read to be the last.  A writer that fails has
put no record, so readers never see its data.  The data folder is then also named
``v=000007`` where the file system can rename it; readers follow the record either way.
Paths go through Hadoop's FileSystem API; ``create`` without overwriting is atomic on HDFS
and local disks, and on object stores where their connector makes it so.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class CommitConflict(RuntimeError):
    """Another writer has committed since the version that a write builds on."""


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        fs, p = _fs(self.spark, folder)
        return [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []

    def _committed(self) -> dict[int, str | None]:
        """Version -> data folder; None for a version of the layout without records."""
        plain = [int(n[2:]) for n in self._names(self.root) if n.startswith("v=") and n[2:].isdigit()]
        done = {int(n): n for n in self._names(f"{self.root}/_commits") if n.isdigit()}
        out: dict[int, str | None] = {v: None for v in plain if v not in done and self._exists(f"{self.path(v)}/_SUCCESS")}
        return out | done

    def _exists(self, path: str) -> bool:
        fs, p = _fs(self.spark, path)
        return fs.exists(p)

    def versions(self) -> list[int]:
        return sorted(self._committed())

    def current(self) -> int | None:
        v = self.versions()
        return v[-1] if v else None

    def path(self, version: int) -> str:
        return f"{self.root}/v={version:06d}"

    def _record(self, version: int) -> str:
        return f"{self.root}/_commits/{version:06d}"

    def read(self, version: int | None = None) -> DataFrame:
        v = self.current() if version is None else version
        if v is None:
            raise FileNotFoundError(f"no committed snapshot under {self.root}")
        folder = self.path(v)
        if not self._exists(f"{folder}/_SUCCESS"):  # not renamed: the record names the folder
            fs, p = _fs(self.spark, self._record(v))
            with_stream = fs.open(p)
            try:
                folder = f"{self.root}/{with_stream.readUTF()}"
            finally:
                with_stream.close()
        return self.spark.read.parquet(folder)

    def _claim(self, version: int, folder: str) -> bool:
        """Put the commit record of a version, if it is absent."""
        fs, p = _fs(self.spark, self._record(version))
        try:
            out = fs.create(p, False)
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        out.writeUTF(folder)
        out.close()
        return True

    def write(self, df: DataFrame, base: int | None = None) -> int:
        """Write ``df`` as the next version and return its number.  With ``base``, the version
        that ``df`` was made from (0: no version yet), a version of another writer in between is a
        :class:`CommitConflict`; without, the write goes on top of whatever is current."""
        folder = f"_data/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.root}/{folder}")
        while True:
            last = self.current() or 0
            if base is not None and last != base:
                raise CommitConflict(f"version {last} of {self.root} was committed after version {base} was read")
            if self._claim(last + 1, folder):
                break
        fs, source = _fs(self.spark, f"{self.root}/{folder}")
        fs.rename(source, _fs(self.spark, self.path(last + 1))[1])
        return last + 1

    def update(self, change, attempts: int = 5) -> int:
        """Commit ``change(current table)``; if another writer was faster, it is computed again
        from that writer's version, at most ``attempts`` times."""
        for left in range(attempts - 1, -1, -1):
            base = self.current()
            try:
                return self.write(change(self.read(base)), base=base)
            except CommitConflict:
                if not left:
                    raise
        raise ValueError("attempts must be at least 1")


def write_report(report: DataFrame, path: str | None = None, prefix: str = "report") -> str:
    """One-row nested report as JSON; a timestamped name when none is given."""
    if path is None:
        path = f"{prefix}_{_dt.datetime.now().strftime('%Y%m%d_%H%M%S')}"
    report.coalesce(1).write.mode("errorifexists").json(path)
    return path
