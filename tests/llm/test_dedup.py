from __future__ import annotations

import hashlib
import random

import corpus_brute as brute
import pytest
from pyspark.sql import functions as F

from shelflink.llm import near_dedup
from shelflink.llm.common import Scratch
from shelflink.llm.exact_dedup import CuckooIndex, exact_groups, update_index, without_copies
from shelflink.llm.near_dedup import near_duplicates, without_near_copies

# NULL and empty texts, repeated rows, one doc_id with two texts, NULL ids, a very long text.
LONG = "word " * 60_000
ROWS = [
    (1, "a b c"), (2, "a b c"), (3, None), (4, ""), (5, LONG), (6, LONG), (7, "A b c"), (7, "A b c"),
    (8, "x"), (8, "y"), (None, "a b c"), (9, " "), (10, "a b c"),
]


def test_cuckoo_index_inserts_verifies_deletes_and_grows():
    index = CuckooIndex(buckets=2)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    # Same fingerprint and buckets as the first, but another digest.
    digests.append(digests[0][:10] + bytes(22))
    for d in digests:
        assert index.find(d) < 0
        index.insert(d)
    assert index.resizes > 0
    assert [index.find(d) for d in digests] == list(range(5001))
    for d in digests[::2]:
        assert index.delete(d)
        assert not index.delete(d)
    assert all((index.find(d) >= 0) == (i % 2 == 1) for i, d in enumerate(digests))


def test_exact_groups(docs_of):
    got = {(r.doc_id, r.text_sha256): r for r in exact_groups(docs_of(ROWS)).collect()}
    documents = {(d, t or "") for d, t in ROWS if d is not None}
    assert len(got) == len(documents)
    for d, t in documents:
        group = [x for x, u in documents if u == t]
        r = got[d, hashlib.sha256(t.encode()).hexdigest()]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), d == max(group))


def test_exact_groups_of_an_empty_table_and_with_clashing_columns(docs_of):
    assert exact_groups(docs_of([])).count() == 0
    clashing = docs_of(ROWS).withColumns({c: F.lit(1) for c in ("salt", "digest", "n", "kept", "_sha", "_doc")})
    assert exact_groups(clashing).count() == 11
    kept = without_copies(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted(
        [(10, "a b c"), (4, ""), (6, LONG), (7, "A b c"), (8, "x"), (8, "y"), (9, " ")]
    )


def test_update_index(spark):
    live = spark.createDataFrame([(0, b"a" * 32), (0, b"b" * 32), (1, b"c" * 32)], "shard int, digest binary")
    changes = [(0, b"a" * 32, 1, False), (0, b"a" * 32, 2, True), (0, b"b" * 32, 3, False), (2, b"d" * 32, 4, True), (1, b"e" * 32, 5, False)]
    changes = spark.createDataFrame(changes, "shard int, digest binary, seq long, add boolean")
    assert sorted(bytes(r.digest)[:1] for r in update_index(live, changes).collect()) == [b"a", b"c", b"d"]


def _near_rows(n: int, seed: int) -> list[tuple[int, str]]:
    """Texts with copies at every distance, chains among them."""
    rng = random.Random(seed)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    while len(rows) < n:
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 40, 150]))
        for _ in range(rng.choice([1, 1, 2, 12])):
            rows.append((len(rows), " ".join(words).replace("w1", rng.choice(["w1", "W1"]))))
            # Each copy differs from the one before.
            words = [w if rng.random() > 0.03 else rng.choice(vocabulary) for w in words]
    return rows[:n]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_against_all_pairs(docs_of, words):
    rows = [*_near_rows(260, words), (1000, None), (1001, ""), (1002, " \n"), (1003, LONG), (1004, LONG + "x")]
    got = {r.doc_id: r for r in near_duplicates(docs_of(rows), words=words).collect()}
    want = brute.near(rows, words)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.kept == (d == want[d]) for d, r in got.items())
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(brute.shingles(t, words)) for d, t in rows}


def test_crowded_buckets_in_small_blocks(docs_of, monkeypatch):
    """A large group of near copies, split over many blocks, keeps every link."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        drop = set(rng.sample(range(60), rng.choice([1, 2, 3, 6])))
        rows.append((i, " ".join(w if k not in drop else f"v{rng.random()}" for k, w in enumerate(base))))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows), words=2).collect()}
    assert got == brute.near(rows, 2)
    assert len(set(got.values())) > 1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 105)], "a long, b long")
    got = near_dedup.components(Scratch(spark, "test"), links)
    assert {(r.node, r.component) for r in got.collect()} == {(i, 0) for i in range(1, 61)} | {(105, 100)}


def test_near_duplicates_edge_tables(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
    clashing = docs_of(ROWS).withColumns({c: F.lit(1) for c in ("key", "signature", "bucket", "kept", "_doc")})
    kept = without_near_copies(clashing, words=2)
    assert kept.columns == clashing.columns
    # 2, 7 and 10 repeat 1; 3, 4 and 9 have no words; both rows of 8 carry the same id.
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 8, 8, 9]
