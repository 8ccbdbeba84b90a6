"""Keyed tables as logs: writes are deltas by bucket, a manifest names what counts, compaction runs apart.

Below one folder, data/v=N/bucket=B holds what version N wrote for a bucket and manifest/N says which versions make up every bucket: one base and the deltas
after it. A version counts once its manifest is there, which is renamed into place whole, so a reader sees the table before a
write or after it. The bytes of a write follow the keys that it changes.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKET, VERSION, ALIVE = "_bucket", "_version", "_alive"


class KeyedTable:
    """Rows by key; a write gives a key its new rows in place of all it had."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: StructType | str, buckets: int = 32):
        self.spark, self.folder, self.keys, self.buckets = spark, folder, keys, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else StructType([f for f in schema])
        self.stored = StructType(list(self.schema.fields)).add(ALIVE, "boolean").add(VERSION, "long").add(BUCKET, "integer")

    # --- manifests ---------------------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions."""
        path, fs = self._path("manifest")
        found = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in found if n.isdigit())

    def committed(self, version: int) -> bool:
        path, fs = self._path(f"manifest/{version}")
        return fs.exists(path)

    def manifest(self, below: int | None = None) -> dict[int, list[int]]:
        """Bucket to the versions that hold its rows, base first, in the last committed state (below a version)."""
        able = [v for v in self.versions() if below is None or v < below]
        if not able:
            return {}
        path, fs = self._path(f"manifest/{able[-1]}")
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(path), "UTF-8")
        return {int(b): v for b, v in json.loads(text).items()}

    def _commit(self, version: int, state: dict[int, list[int]]) -> None:
        part, fs = self._path(f"manifest/.{version}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(part, self._path(f"manifest/{version}")[0]):
            raise OSError(f"manifest {version} was not committed")

    # --- rows --------------------------------------------------------------------------------

    def _data(self, version: int) -> str:
        return f"{self.folder}/data/v={version}"

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _read(self, wanted: dict[int, list[int]]) -> DataFrame | None:
        """The stored rows of versions by bucket: one scan per version, of the buckets that want it."""
        by_version: dict[int, list[int]] = {}
        for bucket, versions in wanted.items():
            for v in versions:
                by_version.setdefault(v, []).append(bucket)
        out = None
        for v, buckets in sorted(by_version.items()):
            rows = self.spark.read.schema(StructType(self.stored.fields[:-2] + self.stored.fields[-1:])).parquet(self._data(v))
            rows = rows.where(F.col(BUCKET).isin(buckets)).withColumn(VERSION, F.lit(v).cast("bigint"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _current(self, state: dict[int, list[int]]) -> DataFrame:
        """Rows that count, with their bucket. Base rows are only compared with the keys that deltas changed."""
        base, deltas = self._read({b: v[:1] for b, v in state.items()}), self._read({b: v[1:] for b, v in state.items() if v[1:]})
        if base is None:
            return self._bucketed(self.spark.createDataFrame([], self.schema))
        if deltas is not None:
            last = deltas.groupBy(BUCKET, *self.keys).agg(F.max(VERSION).alias("_last"))
            on = [BUCKET, *self.keys]
            newest = deltas.join(last, on).where(F.col(VERSION) == F.col("_last")).drop("_last")
            base = base.join(last.select(*on), on, "left_anti").unionByName(newest.select(*base.columns))
        return base.where(ALIVE).select(*self.schema.names, BUCKET)

    def read(self, below: int | None = None) -> DataFrame:
        """The table (below a version); empty before the first write. Keys are not null."""
        return self._current(self.manifest(below)).select(*self.schema.names)

    def write(self, rows: DataFrame, version: int, gone: DataFrame | None = None) -> None:
        """Gives the keys of ``rows`` these rows, and takes all rows from the keys in ``gone`` that have none here.

        A version that is committed already is left as it is, so a repeated micro-batch changes nothing.
        """
        if self.committed(version):
            return
        new = rows.select(*self.schema.names).withColumn(ALIVE, F.lit(True))
        if gone is not None:
            lost = gone.select(*self.keys).distinct().join(rows.select(*self.keys).distinct(), self.keys, "left_anti")
            rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in self.keys]
            new = new.unionByName(lost.select(*self.keys, *rest).withColumn(ALIVE, F.lit(False)))
        state = self.manifest(version)
        for bucket in self._store(self._bucketed(new), version):
            state.setdefault(bucket, []).append(version)
        self._commit(version, state)

    def _store(self, rows: DataFrame, version: int) -> list[int]:
        """Writes rows by bucket and names the buckets that got some."""
        spread = F.pmod(F.xxhash64(*self.schema.names), F.lit(4))  # a key with many rows is several tasks' work
        rows.repartition(BUCKET, spread).write.mode("overwrite").partitionBy(BUCKET).parquet(self._data(version))
        path, fs = self._path(f"data/v={version}")
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(BUCKET))

    def compact(self, version: int, deltas: int = 1) -> None:
        """A new base, as this version, for every bucket with at least so many deltas; other buckets are not touched."""
        if self.committed(version):
            return
        state = self.manifest(version)
        due = {b: v for b, v in state.items() if len(v) > deltas}
        if due:
            merged = self._current(due).withColumn(ALIVE, F.lit(True))
            written = set(self._store(merged, version))
            state = {b: v for b, v in state.items() if b not in due} | {b: [version] for b in due if b in written}
        self._commit(version, state)

    def vacuum(self, keep: int = 2) -> list[int]:
        """Deletes the data of versions that none of the last ``keep`` manifests names, and older manifests; returns those versions."""
        versions = self.versions()
        kept = versions[-keep:] if keep else []
        named = {v for k in kept for held in self.manifest(k + 1).values() for v in held}
        out = []
        for v in versions:
            if v not in kept:
                path, fs = self._path(f"manifest/{v}")
                fs.delete(path, False)
            data, fs = self._path(f"data/v={v}")
            if v not in named and fs.exists(data):
                fs.delete(data, True)
                out.append(v)
        return out
