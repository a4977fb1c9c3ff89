"""Importance resampling against a plain statement, and the selection by itself."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from shelflink.llm import resampling
from shelflink.llm.common import Scratch
from shelflink.llm.resampling import KEY, cutoff, feature_buckets, resampled

AIM = "item_id long, text string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def buckets(text):
    w = words(text)
    runs = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return [crc32(f.encode()) % 10000 for f in runs]


def brute(rows, aims):
    s, t = (Counter(b for r in side for b in buckets(r[1])) for side in (rows, aims))
    every_s, every_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (every_s + 10000.0) / ((s[b] + 1.0) * (every_t + 10000.0)))) for b in s}
    out = []
    for doc, text in rows:
        mine = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in mine)
        out.append([doc, len(words(text)), len(mine), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], 1 << 63 if r[0] is None else r[0], r[2]))
    ranks = {id(r): k + 1 for k, r in enumerate(enough[: 5 * len(enough) // 100])}
    return sorted(((*r, ranks.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "naïve", "ÀB", "7", "x.y", "中文字"]

    def text(n):
        return rng.choice([" ", "-", "\n", " . "]).join(rng.choice(vocabulary) for _ in range(n))

    rows = [(i, text(rng.randint(0, 60))) for i in range(300)]
    rows += [(7, rows[7][1])] * 40 + [(7, text(30)), (7, text(25)), (None, text(30)), (None, None), (500, None), (501, ""), (502, "One")]
    rows.append((503, "Big" * 50_000 + " " + text(40_000)))
    aims = [(i, text(20)) for i in range(10)] + [(11, None), (12, "")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, score string, _row int").repartition(5)
    got = resampled(docs, spark.createDataFrame(aims, AIM))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, aims)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), [(1, "a b " * 30)]
    assert resampled(none, spark.createDataFrame([], AIM)).collect() == []
    some = spark.createDataFrame(one, "doc_id long, text string")
    assert sorted(map(tuple, resampled(some, spark.createDataFrame([], AIM)).collect())) == brute(one, [])


def test_stretches_change_nothing(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["a", "bb", "Çc", "dddddddddddd"]) for _ in range(500))
    for stretch in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(resampling, "STRETCH", stretch)
        n, found = feature_buckets(text.encode(), 3, 10000)
        assert n == 500 and sorted(found.tolist()) == sorted(buckets(text))


def test_features_of_other_lengths():
    assert len(feature_buckets(b"a b c d", 1, 10)[1]) == 4
    assert len(feature_buckets(b"a b c d", 5, 10)[1]) == 4 + 3 + 2 + 1


@pytest.mark.parametrize("wanted", [1, 2, 499, 500, 999, 1000])
def test_cutoff(spark, wanted):
    rng = random.Random(wanted)
    keys = [(rng.randint(-3, 3), rng.randint(0, 5), 0, i) for i in range(1000)]
    table = spark.createDataFrame(keys, ", ".join(f"{c} long" for c in KEY)).repartition(7)
    assert cutoff(Scratch(spark, "test"), table, wanted) == sorted(keys)[wanted - 1]
