from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelflink.llm.mixing import mix, mixed, source_targets


def _targets(sizes: dict, weights=(5, 2, 1), share=1.5, repeats=2) -> dict:
    """Reshare the excess round by round until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, target, budget = set(sizes), {}, share * sum(sizes.values())
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= repeats * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = repeats * sizes[s]
            budget -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100, "d": 100, None: 100},
        {"a": 3, "b": 900, "c": 0, "B": 40, "é": 7},
        {"a": 10},
        {"a": 0, "b": 0},
        {f"s{i:03}": (i * 37) % 101 for i in range(60)},
    ],
)
def test_targets_against_round_by_round(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    assert got == pytest.approx(_targets(sizes))


def test_mix(docs_of):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), f"s{i % 5}" if i % 11 else None) for i in range(600)]
    rows += [(1000, None, "s1"), (1001, "", "s1"), (1002, " \n ", None), (None, "a b", "s2"), (7, "w w", "s2")]
    got = mix(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    by_target: dict = {}
    for r in got:
        by_target.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by_target.items():
        assert abs(sum(taken) - target) <= 8
    assert sorted((r.doc_id or 0, r.taken) for r in mix(docs_of(rows[::-1])).collect()) == sorted(
        (r.doc_id or 0, r.taken) for r in got
    )


def test_mixed_returns_rows_as_often_as_taken(docs_of):
    rows = [(i, "w " * (i % 5), f"s{i % 3}") for i in range(60)]
    docs = docs_of(rows).withColumns({c: F.lit(1) for c in ("copies", "mark", "row", "size", "_copies")})
    out = mixed(docs)
    assert out.columns == docs.columns
    want = {r.doc_id: r.copies for r in mix(docs).collect() if r.copies}
    got: dict = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want


def test_empty_table(docs_of):
    assert mix(docs_of([])).count() == 0
    assert mixed(docs_of([])).count() == 0
