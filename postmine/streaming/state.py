"""Versioned state tables of streaming operators: bucketed Parquet folders and a manifest per epoch.

A table has one folder per epoch and bucket; the manifest of an epoch says which epoch holds the current
version of each bucket, and is written last. So an epoch that failed half-way is invisible, and its replay starts from
the manifest before it. A version is removed when neither the last manifest nor the one before refers to it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import CODEC

Versions = dict[int, int]  # bucket -> epoch
Appends = dict[int, list[int]]  # bucket -> epochs


def bucket_of(key, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_epochs(spark: SparkSession, path: str, epochs: list[int], schema: str) -> DataFrame:
    """Rows written for some epochs, each into a folder of its own."""
    if not epochs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/epoch={e}" for e in epochs])


class _Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self, path: str, prefix: str) -> list[int]:
        """Numbers of the sub-folders or files ``prefix<number>``."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[len(prefix):]) for n in found if n.startswith(prefix))

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)


class Manifest(_Folder):
    """Versions of all tables at each epoch: at most tables times buckets numbers."""

    def epochs(self) -> list[int]:
        """Epochs that were committed."""
        return [e for e in self.names(self.path, "epoch=") if self.exists(f"{self.path}/epoch={e}/_SUCCESS")]

    def before(self, epoch: int | None) -> dict[str, Versions]:
        """The versions as they were before an epoch (None: the last)."""
        earlier = [e for e in self.epochs() if epoch is None or e < epoch]
        if not earlier:
            return {}
        text = self.spark.read.text(f"{self.path}/epoch={earlier[-1]}").first()["value"]
        return {name: {int(b): e for b, e in v.items()} for name, v in json.loads(text).items()}

    def commit(self, epoch: int, versions: dict) -> None:
        text = self.spark.createDataFrame([(json.dumps(versions),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{self.path}/epoch={epoch}")


class BucketTable(_Folder):
    def __init__(self, spark: SparkSession, path: str, schema: str):
        super().__init__(spark, path)
        self.schema = schema

    def read(self, versions: Versions, buckets: list[int] | None = None) -> DataFrame:
        """The current rows of all buckets, or of some."""
        wanted = versions if buckets is None else {b: versions[b] for b in buckets if b in versions}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/epoch={e}/bucket={b}" for b, e in sorted(wanted.items())])

    def write(self, df: DataFrame, epoch: int, buckets: int, touched: list[int], base: Versions, key: str = "page_url") -> Versions:
        """Write the whole content of the touched buckets as a new version; the versions after it. A large
        bucket is dealt over several files."""
        # few files a bucket: rows of a bucket meet, a large one is split again
        return self.write_buckets(df.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", F.col("bucket")), epoch, touched, base)

    def write_buckets(self, df: DataFrame, epoch: int, touched: list[int], base: Versions) -> Versions:
        """The same for rows that have a ``bucket``."""
        path = f"{self.path}/epoch={epoch}"
        df.write.mode("overwrite").partitionBy("bucket").parquet(path)
        there = set(self.names(path, "bucket="))
        return {**{b: e for b, e in base.items() if b not in set(touched)}, **{b: epoch for b in there}}

    def drop_older(self, epoch: int, *used: Versions | Appends) -> None:
        """Remove versions that none of ``used`` refers to."""
        keep = {(e, b) for v in used for b, at in v.items() for e in (at if isinstance(at, list) else [at])}
        for e in self.names(self.path, "epoch="):
            if e < epoch:
                left = [b for b in self.names(f"{self.path}/epoch={e}", "bucket=") if (e, b) not in keep]
                for b in left:
                    self.remove(f"{self.path}/epoch={e}/bucket={b}")
                if not self.names(f"{self.path}/epoch={e}", "bucket="):
                    self.remove(f"{self.path}/epoch={e}")


class AppendTable(BucketTable):
    """Rows that are written once: a bucket has a folder for each epoch that added some, until it is rewritten or
    given up. An epoch that counts has its folders in the manifest, as for the other tables."""

    def read(self, versions: Appends, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/epoch={e}/bucket={b}" for b in sorted(versions if buckets is None else set(buckets) & set(versions)) for e in versions[b]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def append(self, df: DataFrame, epoch: int, base: Appends, anew: list[int]) -> Appends:
        """Add rows that have a ``bucket``; those of the buckets ``anew`` are all that these have. A task writes at
        most one file a bucket, so the rows need not be dealt again."""
        path = f"{self.path}/epoch={epoch}"
        df.write.mode("overwrite").option("compression", CODEC).partitionBy("bucket").parquet(path)
        kept = {b: e for b, e in base.items() if b not in set(anew)}
        return {**kept, **{b: [*kept.get(b, []), epoch] for b in self.names(path, "bucket=")}}
