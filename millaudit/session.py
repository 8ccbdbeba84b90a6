"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession, functions as F

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows up to which a stored table goes to every executor.
FEW_BYTES = 64_000_000


def local_session(cores: str = "8", memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("millaudit")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", memory)
        .config("spark.millaudit.deal", cores if cores.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _own_folder()
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


@functools.cache
def _own_folder() -> str:
    """One temporary folder per process, removed at its end."""
    base = tempfile.mkdtemp(prefix="millaudit-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def table(spark: SparkSession, folder: str, name: str):
    """A given table as it is stored.

    Tables of one small file give one split. A session that names a number of partitions in
    ``spark.millaudit.deal`` (local ones do) deals the rows out to them; a cluster leaves it unset.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    deal = spark.conf.get("spark.millaudit.deal", None)
    return rows.repartition(int(deal)) if deal else rows


def stored(spark: SparkSession, rows, name: str):
    """Rows written to the shared folder and read back: a result used several times is worked out once,
    and a lost executor never makes its lineage run again."""
    path = work_folder(spark, name)
    with _shuffles_removed(spark):
        rows.write.parquet(path)
    return spark.read.parquet(path)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """What runs inside leaves no shuffle files behind: its rows are written, so nobody reads those files again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored_few(spark: SparkSession, rows, name: str):
    """Rows stored like stored(); if they turn out to be few, joins send them to every executor.

    Their texts are measured after they are written, so no estimate of a plan or of a compressed file decides.
    """
    kept = stored(spark, rows, name)
    taken = kept.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 32)).first()[0] or 0
    return F.broadcast(kept) if taken <= FEW_BYTES else kept


def by_report(rows):
    """Rows dealt by report into the session's number of shuffle partitions.

    Whatever follows by report and other keys stays in that deal. For joins the session has to allow it, which is set here and stays
    set. Unions of such tables count as not dealt: an earlier form of this code gave wrong section numbers over a union that did.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "report_id")
