"""Verdict store: numbered snapshots below one folder; the highest complete one counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class VerdictStore:
    """Snapshots folder/v=N. A snapshot counts once its job has committed (its success marker is there)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v=*/_SUCCESS")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(path) or []
        return sorted(int(re.search(r"/v=(\d+)/", str(s.getPath())).group(1)) for s in found)

    def version(self, below: int | None = None) -> int | None:
        """The highest committed version (below a number), none without any."""
        versions = [v for v in self._versions() if below is None or v < below]
        return versions[-1] if versions else None

    def read(self, below: int | None = None) -> DataFrame:
        """The latest snapshot (below a version); without a readable one, an empty store."""
        version = self.version(below)
        empty = self.spark.createDataFrame([], self.schema)
        if version is None:
            return empty
        # Files that are no Parquet are passed over: a broken snapshot holds no verdicts, and all are judged anew.
        return (
            self.spark.read.schema(self.schema).option("ignoreCorruptFiles", True).parquet(f"{self.folder}/v={version}")
        )

    def write(self, rows: DataFrame, version: int | None = None) -> int:
        """A new snapshot; readers of older ones are not disturbed. A version written again replaces itself."""
        if version is None:
            last = self.version()
            version = 0 if last is None else last + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/v={version}")
        return version
