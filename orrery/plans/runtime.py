"""Session settings, table access and materialisation shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def session(app: str = "orrery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; everything else is left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent and all executors run in this process (tests, a laptop) a
    temporary folder is used; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="orrery-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs no recomputation.

    ``put`` computes a DataFrame once, writes it and reads it back. ``drop`` removes a table that
    no later plan reads, so that iterative operators keep the disk bounded by a few rounds.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.schemas: dict[str, StructType] = {}

    def put(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        return self.read(self.write(df, partition_by))

    def write(self, df: DataFrame, partition_by: str | None = None) -> str:
        path = f"{self.root}/{self.count}"
        self.count += 1
        self.schemas[path] = df.schema
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        return path

    def read(self, path: str) -> DataFrame:
        # the schema is known, so no job has to look for it; column order of a partitioned table would differ
        return self.spark.read.schema(self.schemas[path]).parquet(path)

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def parallelism(spark: SparkSession) -> int:
    """Number of partitions for work that is bounded by CPU rather than by bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def is_small(df: DataFrame, max_bytes: int = 64 << 20) -> bool:
    """True if Catalyst's size estimate proves that a side may be broadcast."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint below the bound; beyond it the planner keeps a shuffled join."""
    return F.broadcast(df) if is_small(df, max_bytes) else df


def salt(*cols: Column, buckets: int) -> Column:
    """Deterministic bucket of a row, for spreading a hot key."""
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def running_total(df: DataFrame, group: str, order: list[str], value: str, out: str,
                  buckets: int = 64) -> DataFrame:
    """Exclusive prefix sum of ``value`` within ``group``, with any group spread over many tasks.

    Rows of a group are cut into ``buckets`` hash buckets; within the group the order is
    (bucket, *order). Bucket totals (groups x buckets rows) give each bucket's offset, so no task
    holds a whole group even if that group has a third of all rows. Null values count as 0, and a
    null group is a group of its own.
    """
    from pyspark.sql import Window

    bucket = "__bucket"
    spread = df.withColumn(bucket, salt(*[F.col(c) for c in order], buckets=buckets))
    totals = spread.groupBy(group, bucket).agg(F.sum(F.coalesce(value, F.lit(0))).alias("__total"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(group).alias("__group"), F.col(bucket).alias("__b"),
                            F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = spread.withColumn("__inside", F.coalesce(F.sum(F.coalesce(value, F.lit(0))).over(inside), F.lit(0)))
    joined = part.join(offsets, F.col(group).eqNullSafe(F.col("__group")) & (F.col(bucket) == F.col("__b")))
    return joined.withColumn(out, F.col("__inside") + F.col("__offset")).drop(
        "__group", "__b", "__offset", "__inside", bucket)
