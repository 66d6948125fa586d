"""Parquet stores that streaming batches write to: cut into buckets, safe to write again.

Rows lie under ``bucket=.../epoch=...``. A batch that runs again replaces exactly what it wrote
before, so replays leave one result; a reader that knows its buckets lists and reads only those.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from claimgrid.plans import ordered

BUCKETS = 256


def hash_bucket(*keys: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class BucketedStore:
    """Rows of ``schema`` under ``path``; ``bucket`` is an integer column of bounded range over them.

    With ``order``, files are sorted by these columns, so a reader skips row groups, and AQE splits
    the buckets that are too large for one task and joins small ones.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, bucket: Column, order: Sequence[str] = ()
    ):
        self.spark, self.path, self.bucket, self.order = spark, path.rstrip("/"), bucket, list(order)
        self.schema = StructType(list(schema.fields))
        self.stored = StructType(
            [*schema.fields, StructField("bucket", IntegerType()), StructField("epoch", LongType())]
        )

    def write(self, rows: DataFrame, epoch: int) -> None:
        """Put a batch's rows into their buckets.

        Without an order, one task a bucket and batch, rows that hash alike aside.
        """
        placed = rows.select(*self.schema.names).withColumns(
            {"bucket": self.bucket, "epoch": F.lit(epoch).cast("long")}
        )
        if self.order:
            dealt = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "epoch", *self.order)
        else:
            dealt = placed.repartition("bucket")
        (
            dealt.write.partitionBy("bucket", "epoch")
            .mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .parquet(self.path)
        )

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows belong to: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket).distinct().collect())

    def written(self, epoch: int) -> list[int]:
        """The buckets that hold rows of an epoch, told by the names of their folders."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket=*/epoch={epoch}")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(at.getPath().getParent().getName().split("=")[1]) for at in found or [])

    def read(self, buckets: Iterable[int] | None = None, epoch: int | None = None) -> DataFrame:
        """Rows of some buckets up to an epoch, with ``epoch``; other buckets are not even listed."""
        names = [self.path] if buckets is None else [f"{self.path}/bucket={b}" for b in buckets]
        there = [name for name in names if self._exists(name)]
        if not there:
            return self.spark.createDataFrame([], self.stored).drop("bucket")
        rows = self.spark.read.schema(self.stored).option("basePath", self.path).parquet(*there)
        if epoch is not None:
            rows = rows.filter(F.col("epoch") <= epoch)
        return rows.drop("bucket")

    def current(self, keys: Sequence[str], buckets: Iterable[int] | None = None) -> DataFrame:
        """The newest row of every key."""
        return ordered.latest_per_key(self.read(buckets), keys, ["epoch"]).drop("epoch")

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


__all__ = ["BUCKETS", "BucketedStore", "hash_bucket"]
