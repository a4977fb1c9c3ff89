"""Blocks of titles at size: which rows move, what is written, and which words are looked up."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from test_reach import table

from shelflink.operators import blocks, candidates, reach


def names_written(monkeypatch, module):
    names, write = [], module.written

    def watched(df, name):
        names.append(name)
        return write(df, name)

    monkeypatch.setattr(module, "written", watched)
    return names


def random_titles(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("river", "harbour", "of", "night", "sorcerer") for b in ("", "s", "ing", "x", "y7")]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, words)))) for i in range(n)]


def test_near_titles_write_no_word_lists(spark, monkeypatch):
    names = names_written(monkeypatch, reach)
    q, l = table(spark, [(1, "harbour of letters")]), table(spark, [(2, "harbor of letterz")])
    assert reach.near_titles(q, l).collect() == [(1, 2)]
    assert names == ["word-counts", "spellings"]


def test_entries_visit_the_blocks_of_their_weight(spark, monkeypatch):
    """Every pair of a title is found in many blocks, of which it visits few."""
    listings = [(i, " ".join(f"word{k}" for k in range(1 + i % 40))) for i in range(400)]
    q, l = table(spark, listings[:80]), table(spark, listings)
    moved, layout = [], blocks.Layout

    def watched(*args):
        out = layout(*args)
        moved.append(out)
        return out

    monkeypatch.setattr(blocks, "Layout", watched)
    one = {tuple(r) for r in reach.near_titles(q, l).collect()}
    moved.clear()
    got = reach.near_titles(q, l, cell_rows=10).collect()
    assert {tuple(r) for r in got} == one and len(got) == len(one) > 800
    most = max(moved, key=lambda x: x.blocks)
    assert most.blocks >= 40 and most.moved < (80 + 400) * most.blocks / 2


@pytest.mark.parametrize("most", [3, 1000])
def test_layout_holds_every_step(most):
    offered, wanted = {0: 10, 5: 2, 6: 1, 40: 7}, {1: 3, 5: 4, 39: 1, 70: 2}
    for k in (1, 2, 7):
        laid = blocks.Layout(offered, wanted, lambda s: (s - 2, s + 2), k, most, 6)
        sizes = np.zeros(laid.blocks)
        for step, n in offered.items():
            parts = laid.last[step] - laid.first[step] + 1
            assert parts >= 1
            sizes[laid.first[step] : laid.last[step] + 1] += n / parts
        assert sizes.max() <= max(most, 20) and laid.cells == sum(laid.parts)
        for step in wanted:
            # Steps without listings point between their neighbours.
            for other in offered:
                if abs(other - step) <= 2:
                    low, high = laid.first[max(step - 2, 0)], laid.last[step + 2]
                    assert low <= laid.first[other] and laid.last[other] <= high


def rows(words):
    """Rows of titles as tasks read them."""
    n = len(words)
    return pa.table({
        "id": list(range(n)), "text_length": [len(t) for t in words], "sorted_length": [len(t) for t in words],
        "whole": [sum(len(w) + 1 for w in t.split()) for t in words], "words": words, "weights": pa.nulls(n, pa.binary()),
    })


def distinct(titles):
    return [" ".join(sorted(set(t.split()))) for _, t in titles]


def test_a_title_with_more_places_than_are_held_at_once(monkeypatch):
    """Pieces of any size find the pairs that plain comparison finds."""
    wanted, offered = distinct(random_titles(1, 90, 6)), distinct(random_titles(2, 120, 9))
    anything = lambda q, entry, *_: np.ones(len(entry), bool)

    def weigh(words):
        return sum(len(w) + 1 for w in words)

    shares = [[weigh(set(a.split()) & set(b.split())) * 100 for b in offered] for a in wanted]
    sizes = [[(weigh(a.split()), weigh(b.split())) for b in offered] for a in wanted]
    pairs = [(i, j) for i in range(90) for j in range(120)]
    for expanded in (1 << 20, 7):
        monkeypatch.setattr(blocks, "EXPANDED", expanded)
        for percent, holds, find in (
            (47, lambda i, j: shares[i][j] >= 47 * min(sizes[i][j]), lambda b, q: blocks.sharing(b, q, 9, 47, anything)),
            (40, lambda i, j: shares[i][j] >= 40 * max(sizes[i][j]), lambda b, q: blocks.overlapping(b, q, 9, 40)),
            (40, lambda i, j: shares[i][j] >= 40 * max(sizes[i][j]), lambda b, q: blocks.near(b, q, 9, 40, 4095)),
        ):
            block = blocks.Block(rows(offered), percent, True)
            found = [(int(e), block.of.ids[int(j)].as_py()) for es, js in find(block, block.entries(rows(wanted))) for e, j in zip(es, js)]
            assert sorted(found) == [p for p in pairs if holds(*p)] and len(found) > 15


def test_blocking_joins_no_words(spark, monkeypatch):
    """Words of several listings are passed on whole; a long list of them is joined as before, with the same pairs."""
    q, l = table(spark, random_titles(3, 90, 6)), table(spark, random_titles(4, 120, 9))
    names = names_written(monkeypatch, candidates)
    want = {tuple(r) for r in candidates.block_by_title(q, l).collect()}
    assert names == ["listing-counts", "entry-words", "listing-words"] and len(want) > 50
    monkeypatch.setattr(candidates, "KNOWN_BYTES", 0)
    got = candidates.block_by_title(q, l).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_weights_too_great_to_pack():
    """A word longer than the packed weight can say is never a reason to drop a pair."""
    long = "x" * 6000
    texts = [f"{long} a b c", f"{long} d", "a b c"]

    block = blocks.Block(rows(texts), 60, True)
    entries = block.entries(rows(texts))
    for pairs in (blocks.overlapping(block, entries, 100, 60), blocks.sharing(block, entries, 100, 60, lambda *a: np.ones(len(a[1]), bool))):
        got = {(int(e), block.of.ids[int(j)].as_py()) for es, js in pairs for e, j in zip(es, js)}
        assert got >= {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)}
