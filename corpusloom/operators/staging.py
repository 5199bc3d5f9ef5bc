"""Tables in the shared folder, running sums over ranges, and limits of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python worker; bounds the worker's memory whatever the texts' lengths.
BATCH_BYTES = 4 << 20
#: Rows of one range of a running sum.
RANGE_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it only a local master has one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
            spark.sparkContext.setCheckpointDir(found)
    # As Hadoop resolves it: a path without a scheme is one of the default file system's.
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return whole if "://" in whole else "file://" + whole.removeprefix("file:")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Limits Arrow batches by bytes, so that a batch of very long texts doesn't fill a worker. A lower limit that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key).lower().rstrip("b")
    if not held.isdigit() or int(held) > size:
        spark.conf.set(key, str(size))


def parts_for(rows: int, per: int, least: int = 1) -> int:
    """A number of parts that grows with the rows."""
    return max(least, -(-rows // per))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def running(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, rows: int) -> DataFrame:
    """Adds the running sum of value along order within keys. df: staged, some `rows` rows; keys aren't null; order is total.

    Rows are dealt to ranges of (keys, order) by Spark's range sort, whatever a key's share of them. A range's sum per key is
    one row, so that the sums before it are those of at most as many rows as there are ranges.
    """
    part_, sum_, before_, inside_ = unused(df, "part", "sum", "before", "inside")
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts_for(rows, RANGE_ROWS))
    ranged = staged(df.repartitionByRange(n, *keys, *order).withColumn(part_, F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*keys, part_).agg(F.sum(value).alias(sum_))
    ahead = W.partitionBy(*keys).orderBy(part_).rowsBetween(W.unboundedPreceding, -1)
    before = sums.withColumn(before_, F.coalesce(F.sum(sum_).over(ahead), F.lit(0))).drop(sum_)
    inside = F.sum(value).over(W.partitionBy(*keys, part_).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn(inside_, inside).join(before, [*keys, part_]).withColumn(out, F.col(before_) + F.col(inside_)).drop(part_, before_, inside_)
