"""Scores of a pair: the three common subsequences share one Python node, whose workers hold memory per task."""

from __future__ import annotations

from shelflink.operators.scoring import with_measures


def test_common_subsequences_share_one_python_node(spark, capsys):
    columns = "q_text string, q_sorted string, l_text string, l_sorted string"
    rows = [("ab c", "ab c", "ab d", "ab d"), ("a", "a", "a", "a"), (None, None, "a", "a"), ("", "", "a", "a")]
    scored = with_measures(spark.createDataFrame(rows, columns).repartition(1))
    scored.explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") == 1
    found = [(r.ratio, r.token_sort_ratio, r.token_set_ratio) for r in scored.collect()]
    assert sorted(found) == [(0, 0, 0), (0, 0, 0), (75, 75, 75), (100, 100, 100)]
