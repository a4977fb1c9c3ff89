"""Identifier join: cells are normalised once, however many entries share them."""

from __future__ import annotations

from shelflink.operators import exact


def test_distinct_cells_are_matched_once(spark, monkeypatch):
    sizes, write = {}, exact.written

    def watched(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(exact, "written", watched)
    cells = ["0262046482", "978-0-262-04648-0", " 0262046482 ", "043942089x", "978043942089", "", None, "9999999999"]
    entries = [(i, cells[i % len(cells)]) for i in range(40)] + [(0, "043942089X"), (None, "043942089X")]
    listings = [
        (7, "9780262046480", "a"), (5, "0-262-04648-2", "b"), (3, "9780262046480", None), (9, "9780439420891", "c"),
        (8, None, "d"), (4, "978043942089", "e"),
    ]
    e = spark.createDataFrame(entries, "position long, isbn string")
    l = spark.createDataFrame(listings, "listing_pos long, isbn string, title string")
    want = {i: 5 for i in range(40) if i % 8 in (0, 1, 2)} | {i: 9 for i in range(40) if i % 8 == 3} | {None: 9}
    for skew in ({}, {"hot_rows": 1}):
        got = [tuple(r) for r in exact.exact_matches(e, l, **skew).collect()]
        assert len(got) == len(want) and dict(got) == want
        assert sizes["entry-cells"] == 8 and sizes["found-cells"] == 5
