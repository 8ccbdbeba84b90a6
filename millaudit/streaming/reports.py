"""Arriving reports: pages come in any order over many micro-batches, whole reports are audited and merged by report."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from millaudit.session import stored
from millaudit.sources.keyed import KeyedTable

PAGES = "report_id, version, page, text_lines, tables".split(", ")
#: The tables of an audit that are kept by report.
LISTS = ("summary", "issues", "cited", "items", "matched", "unmatched", "extra", "evidence", "verdicts")


class AuditedReports:
    """Tables below one folder, one per list and one of the pages, all keyed by report_id.

    A batch counts once all its tables are committed and its marker is written; readers read every table as of the last such batch, so
    lists of one report always belong together.
    """

    def __init__(self, spark: SparkSession, folder: str, lists: tuple[str, ...] = LISTS, buckets: int = 32):
        self.spark, self.folder, self.lists, self.buckets = spark, folder, lists, buckets
        self.done = self._table("done", "report_id string")

    def _table(self, name: str, schema: StructType | str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.folder}/{name}", ["report_id"], schema, self.buckets)

    def _schema(self, name: str) -> StructType | None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/schemas/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        rows = self.spark.read.text(f"{self.folder}/schemas/{name}", wholetext=True).first()
        return StructType.fromJson(json.loads(rows.value))

    def _keep_schema(self, name: str, schema: StructType) -> None:
        if self._schema(name) is None:
            self.spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/schemas/{name}")

    def version(self) -> int | None:
        versions = self.done.versions()
        return versions[-1] if versions else None

    def read(self, name: str) -> DataFrame | None:
        """A list as of the last complete batch; none before the first."""
        version, schema = self.version(), self._schema(name)
        return None if version is None or schema is None else self._table(name, schema).read(version + 1)

    def merge(self, arrived: DataFrame, version: int, audited: Callable[[DataFrame], dict[str, DataFrame]]) -> None:
        """Audits the reports that the arrived pages belong to, whole, and puts their lists in place of the former ones.

        arrived: (report_id, version, page, text_lines, tables). Of a report's versions the highest counts, with all its pages from this and earlier
        batches; of equal pages one. Pages of an older version than the one at hand change nothing. A batch that is committed already is skipped.
        """
        if self.done.committed(version):
            return
        arrived = stored(self.spark, arrived.select(*PAGES), "arrived")
        self._keep_schema("pages", arrived.schema)
        pages = self._table("pages", self._schema("pages"))
        changed = stored(self.spark, arrived.select("report_id").distinct(), "changed")
        both = arrived.unionByName(pages.read(version).join(changed, "report_id", "left_semi"))
        last = both.groupBy("report_id").agg(F.max("version").alias("version"))
        live = both.join(last, ["report_id", "version"]).dropDuplicates(["report_id", "page"])
        live = stored(self.spark, live.select(*PAGES), "live-pages")
        pages.write(live, version)
        result = audited(live.drop("version"))
        for name in self.lists:
            self._keep_schema(name, result[name].schema)
            self._table(name, self._schema(name)).write(result[name], version, gone=changed)
        self.done.write(changed.select(F.col("report_id").cast("string")), version)

    def compact(self, version: int) -> None:
        """Compacts every table as this version, which no batch has."""
        for name in ("pages", *self.lists, "done"):
            schema = self._schema(name) if name != "done" else self.done.schema
            if schema is not None:
                self._table(name, schema).compact(version)


def run_audits(
    pages: DataFrame, audited: Callable[[DataFrame], dict[str, DataFrame]], reports: AuditedReports, checkpoint: str, first_version: int = 0
):
    """Audits a stream of report pages; batch n is version first_version + n. Returns the running query."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        reports.merge(batch, first_version + batch_id, audited)

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
