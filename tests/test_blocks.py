"""Blocks of titles: what is written and what moves grows with the titles, not with the pairs."""

from __future__ import annotations

from test_reach import NEED, table

from shelflink.operators import candidates, reach


def test_pairs_are_not_written_on_the_way(spark, monkeypatch):
    sizes = {}
    write = reach.written

    def watched(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(reach, "written", watched)
    n = 60
    entries = [(i, f"harbour of letters {i}") for i in range(n)]
    listings = [(i, f"harbour of letterz {i}") for i in range(n)]
    q, l = table(spark, entries), table(spark, listings)
    assert reach.sharing_titles(q, l, NEED).count() == n * n
    assert reach.near_titles(q, l).count() > n * n / 2
    assert max(sizes.values()) <= 4 * n


def test_ids_of_any_kind_and_null(spark):
    q = table(spark, [(1, "dune messiah"), (None, "dune messiah"), (1 << 60, "dune messiahs")])
    l = table(spark, [(None, "dune messiah"), ((1 << 60) + 1, "dune messiah")])
    want = {(i, j) for i in (1, None, 1 << 60) for j in (None, (1 << 60) + 1)}
    got = reach.near_titles(q, l).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_blocking_writes_one_row_a_title(spark, monkeypatch):
    """Titles of the same words: neither their pairs nor a row for every word are written on the way."""
    sizes, write = {}, candidates.written

    def watched(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(candidates, "written", watched)
    n = 60
    q = table(spark, [(i, f"harbour of letters {i}") for i in range(n)])
    l = table(spark, [(i, f"letters of harbour x{i}") for i in range(n)])
    got = candidates.block_by_title(q, l, 20, cell_rows=7).collect()
    assert len(got) == len(set(got)) == n * n
    assert sizes["entry-words"] == sizes["listing-words"] == n
    assert max(sizes.values()) <= 3 * n
