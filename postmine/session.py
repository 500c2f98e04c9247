"""Session helpers: sane defaults for local runs, shared checkpoint folder on clusters."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on (set per session, harmless if already set).
LIBRARY_CONF = {
    # JSON.parse keeps the last of duplicate keys; Spark's variant parser rejects them by default.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in LIBRARY_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "postmine") -> SparkSession:
    """Session for tests and the benchmark. On a cluster, build the session yourself."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only in local mode (tests) is a scratch folder made where the setting is absent; on a cluster a
    folder of the driver's machine could not be read by the executors.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="postmine-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Rows that hold whole texts: Arrow hands Python tasks at most ``BATCH_ROWS`` of them at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ship_module(module) -> None:
    """Pickle a module's functions by value into Python tasks, so executors need no install of
    this package (the function travels with the task, like a closure)."""
    import sys

    from pyspark import cloudpickle

    for m in (sys.modules.get(__name__.split(".")[0]), module):
        try:
            if m is not None:
                cloudpickle.register_pickle_by_value(m)
        except Exception:  # noqa: BLE001 - already registered or not a module
            pass


_TABLES: list[str] = []
CODEC = "zstd"  # of tables with whole texts: a third less to write than the default


def materialize(df):
    """Cut lineage at a reuse point: a Parquet table written in ``spark.checkpoint.dir`` (shared storage
    on a cluster) and read back, so branches reading ``df`` do not recompute it, columns are pruned per
    reader, and a lost executor does not replay its upstream (or its model calls)."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/postmine-table-{uuid.uuid4().hex}"
    df.write.option("compression", CODEC).parquet(path)
    _TABLES.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop_table(df) -> None:
    """Remove a table of :func:`materialize` that nobody reads any more."""
    _delete(df.sparkSession, df._table_path)
    _TABLES.remove(df._table_path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder, removed by :func:`release_tables`."""
    import uuid

    path = f"{checkpoint_dir(spark).rstrip('/')}/postmine-{name}-{uuid.uuid4().hex[:12]}"
    _TABLES.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release_tables(spark: SparkSession) -> int:
    """Remove the tables of :func:`materialize` and the folders of :func:`scratch_folder`; call it once the
    results that read them are written."""
    n = len(_TABLES)
    while _TABLES:
        _delete(spark, _TABLES.pop())
    return n
