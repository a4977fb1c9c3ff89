from __future__ import annotations

import random

from pyspark.sql import functions as F

from shelflink.functions import ids


def run(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_unwrap_formula(spark):
    cases = {
        '="0262046482"': "0262046482",
        '="9780262046480"': "9780262046480",
        '=""': None,
        '=" "': None,
        "0262046482": "0262046482",
        " 978-0-262-04648-0 ": "9780262046480",
        '="not an id"': "not an id",
        "043942089x": None,
        "": None,
        None: None,
    }
    assert run(spark, list(cases), ids.unwrap_formula(F.col("raw"))) == list(cases.values())


def test_normalise(spark):
    cases = {
        "0-262-04648-2": "0262046482",
        "978-0-262-04648-0": "9780262046480",
        "043942089X": "043942089X",
        "043942089x": "043942089X",
        "12345": None,
        "97802620464801": None,
        '="9780262046480"': None,
        None: None,
    }
    assert run(spark, list(cases), ids.normalize_isbn(F.col("raw"))) == list(cases.values())


def forms(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    return ids.with_isbn_forms(rows, "raw").orderBy("i").collect()


def test_forms(spark):
    got = forms(
        spark,
        ["0262046482", "043942089X", "9780262046480", "9791034567890", "0262046483", "bad", None],
    )
    assert [r.isbn13 for r in got[:3]] == ["9780262046480", "9780439420891", "9780262046480"]
    assert [r.isbn10 for r in got[:3]] == ["0262046482", "043942089X", "0262046482"]
    assert got[3].isbn10 is None
    assert [r.isbn_valid for r in got] == [True, True, True, False, False, False, False]
    assert got[0].isbn_variants == ["0262046482", "9780262046480"]
    assert got[2].isbn_variants == ["9780262046480", "0262046482"]
    assert got[3].isbn_variants == ["9791034567890"]
    assert got[5].isbn_variants == [] and got[6].isbn_variants == []


def check_character(nine: str) -> str:
    rest = sum(int(c) * (10 - i) for i, c in enumerate(nine)) % 11
    return "0123456789X"[(11 - rest) % 11]


def test_round_trip_and_checksums(spark):
    rng = random.Random(5)
    tens = []
    for _ in range(300):
        nine = f"{rng.randrange(10**9):09d}"
        tens.append(nine + check_character(nine))
    got = forms(spark, tens)
    assert all(r.isbn_valid for r in got)
    back = forms(spark, [r.isbn13 for r in got])
    assert [r.isbn10 for r in back] == tens
    assert all(r.isbn_valid for r in back)
    broken = [t[:4] + str((int(t[4]) + 1) % 10) + t[5:] for t in tens]
    assert not any(r.isbn_valid for r in forms(spark, broken))


def test_listing_id_and_prefix(spark):
    assert run(spark, ["9780593548448B", "04-3942089X B"], ids.clean_listing_id(F.col("raw"))) == [
        "9780593548448",
        "043942089X",
    ]
    pairs = spark.createDataFrame(
        [("9780262046480", "9780262049999"), ("0262046482", "9780262046480"), (None, None)],
        "a string, b string",
    )
    got = [r[0] for r in pairs.select(ids.same_prefix(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, False]
