"""Helpers shared by the training-data operators: scratch tables, row keys, bounded broadcasts."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import postmine

from ..session import checkpoint_dir

# Functions travel with the tasks, so executors need no install of this package.
cloudpickle.register_pickle_by_value(postmine)

# The white space of every contract: space, tab, LF, VT, FF, CR (what bytes.split() splits on).
WS_CHARS = "\t\n\x0b\x0c\r "
WS_BYTES = WS_CHARS.encode()
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# A broadcast table has at most this many rows; larger ones are joined by a salted shuffle.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 32 << 20
SALTS = 32
BATCH_ROWS = 1_000

_TABLES: dict[str, list[str]] = {}


def small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts: hand Python tasks at most ``BATCH_ROWS`` of them at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and read it back: cuts
    the lineage, survives lost executors and lets several consumers share one computation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def drop_scratch(df: DataFrame) -> None:
    """Remove a scratch table that a later one has replaced."""
    path = getattr(df, "_scratch_path", None)
    if path:
        delete_path(df.sparkSession, path)
        _TABLES[df.sparkSession.sparkContext.applicationId].remove(path)


def cleanup(spark: SparkSession) -> int:
    """Remove every scratch table of this application; call it once the results are written."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        delete_path(spark, p)
    return len(paths)


KEY = ("_file_key", "_row_index")


def stored(df: DataFrame) -> DataFrame:
    """``df`` if it is read from files, else a scratch table of it: its rows then have an identity."""
    small_batches(df.sparkSession)
    try:
        df.select(df.metadataColumn("_metadata")["file_path"])  # also where a column has that name
        return df
    except AnalysisException as e:
        if e.getCondition() is None or not e.getCondition().startswith(("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND")):
            raise
        return scratch(df, "rows")


def _key_columns(d: DataFrame) -> list[Column]:
    m = d.metadataColumn("_metadata")
    return [F.xxhash64(m["file_path"]).alias(KEY[0]), m["row_index"].alias(KEY[1])]


def with_row_key(df: DataFrame) -> DataFrame:
    """Add a stable identity of each row: hash of its file and its index there (columns of those names
    are replaced)."""
    d = stored(df)
    return d.select(*[F.col(f"`{c}`") for c in d.columns if c not in KEY], *_key_columns(d))


def whole_rows(df: DataFrame) -> DataFrame:
    """Each row as a struct ``_row`` beside its identity, so no column name can clash."""
    d = stored(df)
    return d.select(F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias("_row"), *_key_columns(d))


def without_rows(df: DataFrame, drop: DataFrame) -> DataFrame:
    """The rows of a stored frame whose identity is not in ``drop``."""
    x = whole_rows(df).join(drop.select(*KEY), list(KEY), "left_anti")
    return x.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def _small(df: DataFrame, max_rows: int, row_bytes: Column | None) -> bool:
    if df.limit(max_rows + 1).count() > max_rows:
        return False
    return row_bytes is None or (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES


def small_join(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salt_by: Column | None = None,
               max_rows: int = BROADCAST_ROWS, row_bytes: Column | None = None) -> DataFrame:
    """Join a table that has one row per key: broadcast if it has at most ``max_rows`` rows (and, where rows
    differ in size, ``BROADCAST_BYTES`` by ``row_bytes``), else a shuffle join in which each key of ``df`` is
    dealt over ``SALTS`` tasks (hot keys). Null keys match."""
    cond = lambda r: [df[k].eqNullSafe(r[f"_k_{k}"]) for k in keys]
    right = small.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    if _small(small, max_rows, row_bytes):
        right = F.broadcast(right)
        on = cond(right)
    else:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by if salt_by is not None else F.monotonically_increasing_id()), F.lit(SALTS)))
        right = right.withColumn("_k_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        on = [df[k].eqNullSafe(right[f"_k_{k}"]) for k in keys] + [df["_salt"] == right["_k_salt"]]
    c = on[0]
    for x in on[1:]:
        c = c & x
    return df.join(right, c, how).drop("_salt", "_k_salt", *[f"_k_{k}" for k in keys])


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker process, over all tasks it runs."""
    m = sys.modules.get("_postmine_worker")
    if m is None:
        m = sys.modules["_postmine_worker"] = types.ModuleType("_postmine_worker")
    return m.__dict__.setdefault(name, {})


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    while name in df.columns:
        name = "_" + name
    return name


def indexed(df: DataFrame, order: list[str], name: str, partitions: int | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """Add ``_idx``: the 0-based position of each row in the global order of ``order`` (ties by ``then``, whose
    values the sampling of the ranges does not read), without a single-task window. Range-partitioned, sorted, written once (so positions never change on a
    re-run); one count per partition gives the offsets (bounded by the number of partitions)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c).asc_nulls_first() for c in order]
    ties = [F.col(c).asc_nulls_first() for c in then]
    t = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols, *ties).withColumn("_mid", F.monotonically_increasing_id())
    t = scratch(t, name)
    sizes = t.groupBy(F.shiftright("_mid", 33).alias("p")).count().collect()
    start, offsets = 0, {}
    for r in sorted(sizes, key=lambda r: r["p"]):
        offsets[r["p"]] = start
        start += r["count"]
    if not offsets:
        return t.withColumn("_idx", F.col("_mid")).drop("_mid")
    table = spark.createDataFrame([(int(p), int(o)) for p, o in offsets.items()], "_p bigint, _o bigint")
    return (
        t.withColumn("_p", F.shiftright("_mid", 33))
        .join(F.broadcast(table), "_p")
        .withColumn("_idx", F.col("_o") + F.col("_mid") - F.shiftleft(F.col("_p"), 33))
        .drop("_p", "_o", "_mid")
    )


def mix64(x):
    """Finaliser that spreads every bit of a numpy uint64 array over all others."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(a, b)``: ``(node, comp)``, comp the smallest node.
    Each round takes the smallest label of the neighbours, then follows the labels one jump."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    e = scratch(both, "edges")
    lab = scratch(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = e.join(lab.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        hooked = scratch(lab.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")), "labels")
        to = hooked.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        nxt = scratch(hooked.join(to, hooked["comp"] == to["_n"]).select("node", "old", F.least("comp", "_c").alias("comp")), "labels")
        done = nxt.filter("comp <> old").limit(1).count() == 0
        drop_scratch(lab)
        drop_scratch(hooked)
        lab_path = nxt._scratch_path
        lab = nxt.select("node", "comp")
        lab._scratch_path = lab_path
        if done:
            return lab


_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_SLICE = 1 << 20


def _powers(n: int):
    """Powers of the base and of its inverse, kept by the worker process."""
    import numpy as np

    cache = worker_cache("powers")
    have = len(cache["up"]) if "up" in cache else 0
    if have < n:
        n = max(n, 2 * have, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            cache[name] = np.multiply.accumulate(x)
    return cache["up"], cache["down"]


def hash_words(data: bytes):
    """Start offsets and 64-bit hashes of the words of a text, computed for the whole buffer at once: a
    word's polynomial is a difference of running sums, brought to a common origin by the inverse base."""
    import numpy as np

    starts, hashes, at = [], [], 0
    white = np.zeros(256, bool)
    white[list(WS_BYTES)] = True
    while at < len(data):
        end = min(len(data), at + _SLICE)
        while end < len(data) and data[end] not in WS_BYTES:  # a slice never cuts a word
            end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], white[b], [True]])))
        s, e = edge[::2], edge[1::2]
        if len(s):
            up, down = _powers(len(b))
            sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)])])
            starts.append(s + at)
            hashes.append(mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)
