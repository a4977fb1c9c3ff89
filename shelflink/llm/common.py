"""What several operators share: reading tables, scratch tables, numbered totals, calibration."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelflink.scratch import scratch_root

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with NULL read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, also where a filter is pushed down through it.

    A column that a lambda reads would be computed again for each element if the optimizer put its
    definition in its place.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Scratch:
    """Tables written to the shared folder by one call.

    ``drop`` deletes those that nothing reads any more. Tables that the returned plan still reads stay for the
    cluster's own expiry of ``spark.checkpoint.dir``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        return self._read(df, path)

    def _read(self, like: DataFrame, path: str) -> DataFrame:
        out = self.spark.read.schema(like.schema).parquet(path)
        out.scratch_path = path
        return out

    def again(self, df: DataFrame) -> DataFrame:
        """The written table ``df`` with columns of its own, to be joined with itself."""
        return self._read(df, df.scratch_path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables that ``put`` made; nothing may read them afterwards."""
        for frame in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(frame.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def in_slices(
    df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 256
) -> DataFrame:
    """``mapInPandas`` that unpacks at most ``rows`` rows at a time.

    Spark sends thousands of rows together; unpacked at once, long texts or sets would not fit beside
    the executor's own memory.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, batch.num_rows, rows):
                    yield batch.slice(start, rows).to_pandas()

        for frame in run(slices()):
            yield pa.RecordBatch.from_pandas(frame, schema=target, preserve_index=False)

    return df.mapInArrow(wrapped, schema)


def running_total(scratch: Scratch, rows: DataFrame, value: str, order: list[str], total: str) -> DataFrame:
    """``rows`` in the order of the columns ``order`` with the sum of ``value`` up to and including each.

    A range sort deals the rows into blocks, which are written with their block number; sums per
    block give each block's start, and the rest is a running sum inside a block. No task sees more
    than one block, however many rows share a leading order column. ``order`` has to be unique.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("_block", F.spark_partition_id())
    dealt = scratch.put(dealt, "sorted")
    sums = dealt.groupBy("_block").agg(F.sum(value).alias("_sum"))
    # One row per block: a few thousand at most.
    starts = sums.withColumn(
        "_start", F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")
    ).select("_block", "_start")
    inside = F.sum(value).over(
        Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = dealt.withColumn(total, inside).join(F.broadcast(starts), "_block")
    return placed.withColumn(total, F.col(total) + F.col("_start")).drop("_block", "_start")


def isotonic(mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing step values nearest to ``mean`` by weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for m, w in zip(mean, weight, strict=True):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, n2 = blocks.pop()
            m1, w1, n1 = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, m) for m, _, n in blocks]) if blocks else np.zeros(0)
