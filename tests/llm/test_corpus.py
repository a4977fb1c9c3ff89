"""Registered corpus queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import os
import random

import corpus_brute as brute
import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelflink.llm import queries

FOLDER = "/root/testdata/sf0.001"
QUERIES = queries.registered()
on_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def value(v):
        if pd.isna(v):
            return "NULL"
        return repr(float(v)) if isinstance(v, (int, float)) else str(v)

    rows = frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)
    return sorted(tuple(map(value, r)) for r in rows)


@on_data
@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_queries_against_sql(spark, name):
    duck = duckdb.connect()
    for view in ("documents", "embeddings", "benchmark"):
        duck.execute(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{view}.parquet'")
    query, sql = QUERIES[name]
    got, want = query(spark, FOLDER).toPandas(), duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert canonical(got) == canonical(want)


@on_data
@pytest.mark.parametrize("name", ["op4_html_text", "op5_sentence_pieces", "op9_quality", "op10_toxicity"])
def test_queries_return_a_row_for_every_row(spark, name):
    table = "pages" if name == "op4_html_text" else "documents"
    assert QUERIES[name][0](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_stages(spark, docs_of, tmp_path):
    """Each stage on what the one before it kept."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if i % 6 == 0:
            text = [w.upper() + "!!" for w in text]
        rows.append((len(rows), " ".join(text), f"s{i % 4}"))
        if i % 5 == 1:
            rows.append((len(rows), rows[-1][1], "s0"))
        if i % 7 == 2 and len(text) > 40:
            rows.append((len(rows), " ".join([*text[:-1], "changed"]), "s1"))
    rows += [(1000, None, None), (1001, "", "s1")]
    folder = str(tmp_path)
    docs = docs_of(rows).withColumn("row", F.lit("clash"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(d, int(not (t or "").isupper()), 0) for d, t, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, text = docs.columns, {d: t or "" for d, t, _ in rows}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = [r.doc_id for r in docs.collect()]
        if name != "sentence pieces":
            assert docs.columns == columns
    good = kept["quality classifier"]
    # A model of few rows: nearly all shouted texts go, nearly all others stay.
    assert sum(text[d].isupper() for d in good) <= 3 < sum(t.isupper() for t in text.values())
    assert sum(t.islower() for d, t in text.items() if d not in good) <= 3
    largest = {text[d]: max(e for e in good if text[e] == text[d]) for d in good}
    assert sorted(kept["exact dedup"]) == sorted(set(largest.values()))
    near = brute.near([(d, text[d]) for d in kept["exact dedup"]], 5)
    assert sorted(kept["near dedup"]) == sorted(set(near.values()))
    assert len(kept["near dedup"]) < len(kept["exact dedup"]) < len(good)
    assert set(kept["source mix"]) <= set(kept["near dedup"])
    assert sorted(kept["sentence pieces"]) == sorted(kept["source mix"])
    assert docs.where("NOT round_trip").isEmpty()
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(kept["sentence pieces"])
