"""Intermediate tables in the cluster's shared folder.

A written table cuts the lineage, survives lost executors, is computed once however often it is
read, and gives the planner real sizes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: HotSpot never compiles a longer method; Spark then uses shorter ones instead of one per stage.
METHOD_LIMIT, COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by the session; a temporary one only for a local master."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shelflink-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return root.rstrip("/")


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Inside, steps too long for the just-in-time compiler run as several methods, not interpreted.

    A limit that the session names itself is kept.
    """
    if spark.conf.get(METHOD_LIMIT, None) is not None:
        yield
        return
    spark.conf.set(METHOD_LIMIT, COMPILED_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(METHOD_LIMIT)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    with compiled_methods(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
