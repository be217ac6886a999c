"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Defaults that suit both a laptop test run and a large cluster: AQE re-plans
# shuffles at runtime (coalescing small partitions, splitting skewed join
# partitions), and a UTC session zone keeps timestamps identical to DuckDB.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "trapline", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the engine's defaults.

    ``master`` is only honoured for a fresh local session; on a cluster the
    launcher decides.  Existing sessions keep their own settings except for
    the SQL confs set below, which are runtime-changeable.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", "16g")
    conf = dict(_BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is unset
    (local tests) fall back to a fresh folder under the system temp dir."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="trapline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Make the package importable on the executors, whatever folder the driver
    was started from: a zip of its sources goes to them once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_trapline_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="trapline-pkg-"), "trapline_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("trapline", os.path.relpath(full, package)))
    sc.addPyFile(path)
    sc._trapline_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint dir for written intermediate
    tables and streaming checkpoints (never a machine-local temp dir on a
    cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


#: Spark's setting to delete a query's shuffle files when it ends, not when the driver's
#: garbage collection finds them unused.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Row groups of a written table whose rows hold thousands of numbers: a task's writer
#: holds one of them, and its reader at most one at a time, not 4,096 rows.
WIDE_ROW_GROUP = 4 << 20
WIDE_TABLES = {"text-features", "vote-vectors", "forest-rows", "svd-features"}


def materialize(df, name: str = "stage"):
    """Cut lineage: write ``df`` as a parquet table under the shared
    checkpoint dir and read it back.  Used where a plan forks so the forked
    branches read the written table instead of recomputing the lineage.
    Survives executor loss (the table lives on shared storage); the shuffle
    files of the write are of no more use and go with its end.
    Tables named in ``WIDE_TABLES`` get small row groups."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    _scratch.append(path)
    writer = df.write.mode("overwrite")
    if name in WIDE_TABLES:
        writer = writer.option("parquet.block.size", WIDE_ROW_GROUP)
    cleanup = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        if cleanup is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, cleanup)
    return spark.read.parquet(path)


#: Tables that ``materialize`` has written and nobody has discarded.
_scratch: list[str] = []


def scratch_tables() -> list[str]:
    return list(_scratch)


def discard(spark: SparkSession, paths: list[str], needed_by=None) -> None:
    """Delete scratch tables, but for those that ``needed_by`` (a DataFrame) reads."""
    files = needed_by.inputFiles() if needed_by is not None and paths else []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        if any(f"/{os.path.basename(path)}/" in f for f in files):
            continue
        where = hadoop.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in _scratch:
            _scratch.remove(path)


def dealt_by_key(table, key: str, rows_per_task: int = 1 << 16):
    """``table`` (a written one) hashed on ``key`` into partitions of about
    ``rows_per_task`` rows, so that a task's sorts do not grow with the table.  A
    small table is left to AQE, which would join the partitions of a large one up to
    its advisory size."""
    n = tasks_by_rows(table, rows_per_task)
    return table.repartition(n, key) if n else table.repartition(key)


def tasks_by_rows(table, rows_per_task: int = 1 << 16) -> int | None:
    """How many partitions ``dealt_by_key`` makes of ``table``; None: left to AQE."""
    rows = table.count()  # of the files' footers
    few = rows <= rows_per_task * table.sparkSession.sparkContext.defaultParallelism
    return None if few else -(-rows // rows_per_task)


def ensure_parallelism(df, key: str | None = None, factor: int = 2):
    """Spread a CPU-heavy narrow stage over the cluster.

    A scan of one large row group yields a single busy task; when the input
    has fewer partitions than the cluster has cores, hash the rows on ``key``
    into ``factor x cores`` partitions first.  On a large input (many files /
    row groups) the scan already has far more splits than cores and nothing
    is shuffled."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    n = max(2, cores * factor)
    return df.repartition(n, key) if key else df.repartition(n)
