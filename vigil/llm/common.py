"""Small helpers of the training-data operators: tables, stored intermediate
results, size-checked broadcasts and Arrow batch limits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.session import scratch_path
from vigil.sources.tables import table_path

#: A side of a join is broadcast only if its measured size is below this.
BROADCAST_BYTES = 32 << 20
#: Rows of one Arrow batch handed to a Python task; texts can be long.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, so that a Python task holds some MB of text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder of ``spark.checkpoint.dir``
    and read it back: lineage ends there, a lost executor costs nothing that
    is already written.  The folder goes when the application ends."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, partitionBy=list(partition) or None)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """A bound on a row's size in a hash table, as a column."""
    size = F.lit(64)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 32 * F.coalesce(F.size(f.name), F.lit(0))
        else:
            size = size + F.lit(8)
    return size.cast("long")


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it measures less than ``limit`` bytes
    (one aggregate over a stored table), else as it is: then the join shuffles
    and adaptive execution splits skewed keys."""
    measured = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if measured < limit else df


def id_type(docs: DataFrame, name: str = "doc_id") -> T.DataType:
    return docs.schema[name].dataType


def part_count(docs: DataFrame, text: str, target: int) -> int:
    """Parts of about ``target`` bytes of text each (one small aggregate)."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long") + 16)).first()[0] or 0
    return max(1, -(-int(total) // target))


def running_offsets(counts: DataFrame, key: list[str], order: str, n: str) -> DataFrame:
    """For each (key, order) the sum of ``n`` over the earlier ``order`` of the
    key; ``counts`` is an aggregate with one row per stored part, not per row."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long")).drop(n)
