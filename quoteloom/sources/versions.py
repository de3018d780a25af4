"""Tables that a run writes together: each run's files are a version, and a version counts once it is committed.

A version's files are written over whatever a run of the same number left behind, and the commit is one file that is renamed
into place after all tables are whole. So a run that dies half-way leaves nothing that is read, and one that is repeated
changes nothing. Any shared file system that Spark writes to will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """The committed versions of several tables below one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, parts)]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def committed(self) -> list[int]:
        """Their numbers, ascending: one file name a run."""
        files, folder = self._files(), self._path("_commits")
        if not files.exists(folder):
            return []
        names = [x.getPath().getName() for x in files.listStatus(folder)]
        return sorted(int(x) for x in names if x.isdigit())

    def last_before(self, version: int) -> int | None:
        return max((v for v in self.committed() if v < version), default=None)

    def write(self, name: str, version: int, df: DataFrame) -> DataFrame:
        """Writes one table of a version and returns a reader of it."""
        path = f"{self.root}/{name}/version={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/version={version}")

    def commit(self, version: int) -> None:
        files, attempt = self._files(), self._path("_commits", f"_{uuid.uuid4().hex}")
        files.create(attempt, True).close()
        if not files.rename(attempt, self._path("_commits", version)):  # another run of this number was there first
            files.delete(attempt, False)

    def expire(self, name: str, keep: int) -> None:
        """Removes all but the last ``keep`` committed versions of a table whose versions are whole snapshots."""
        for version in self.committed()[:-keep]:
            self._files().delete(self._path(name, f"version={version}"), True)
