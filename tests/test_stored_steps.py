"""Steps of the derived tables: plain trimming beside the patterns, methods that stay compiled."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelflink.functions.text import blank_to_null, strip, strip_column, without_edges
from shelflink.scratch import METHOD_LIMIT, written
from shelflink.sources.library import EDGES

ODD = [
    None, "", " ", "a", " a", "a ", "\ta b\r", "a \r", "\r\n a", "a  ", "a  ", " a \u0085", " a ", "é", " é ",
    "a é", "　x", "x　", "~", "!", "\x7f a", " \t\r", " ", "a\r  ", "\x0b a \x0b", "😀 ", " 😀",
]


def test_plain_trimming_equals_the_patterns(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    found = rows.select(
        "i",
        strip(F.col("t")).alias("s"), strip_column(F.col("t")).alias("s2"),
        F.regexp_replace("t", EDGES, "").alias("e"), without_edges(F.col("t"), " \t\r", EDGES).alias("e2"),
        blank_to_null(F.col("t")).alias("b"),
    ).orderBy("i").collect()
    for row in found:
        assert (row.s, row.e) == (row.s2, row.e2), ODD[row.i]
        assert row.b == (row.s or None), ODD[row.i]


def test_written_keeps_generated_methods_short(spark):
    seen = []
    table = spark.range(3)
    save = type(table.write).parquet

    def watched(self, *args, **kwargs):
        seen.append(spark.conf.get(METHOD_LIMIT))
        return save(self, *args, **kwargs)

    type(table.write).parquet = watched
    try:
        before = spark.conf.get(METHOD_LIMIT)
        assert written(table, "short").count() == 3
        assert spark.conf.get(METHOD_LIMIT) == before
        spark.conf.set(METHOD_LIMIT, "20000")
        assert written(table, "named").count() == 3
        assert spark.conf.get(METHOD_LIMIT) == "20000"
    finally:
        type(table.write).parquet = save
        spark.conf.unset(METHOD_LIMIT)
    assert seen == ["8000", "20000"]
