"""Near-duplicate embeddings and centroid clustering against plain statements of both."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from shelflink.llm import centroids, embedding_dedup
from shelflink.llm.centroids import clustered, squared_distances
from shelflink.llm.embedding_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_links(rows, threshold=0.93):
    def usable(r):
        v = r[1]
        return r[0] is not None and r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, near = [0] * n, {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            x, y = rows[i], rows[j]
            if usable(x) and usable(y) and x[2] == y[2] and len(x[1]) == len(y[1]):
                a, b = (np.array(v[1], np.float32).astype(float) for v in (x, y))
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    near[i].add(j)
                    near[j].add(i)
            if x[0] is not None and x[0] == y[0] and usable(x) and usable(y):
                near[i].add(-j - 1)  # one node, no link
                near[j].add(-i - 1)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                k = k if k >= 0 else -k - 1
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        low = min(rows[k][0] for k in seen) if r[0] is not None else None
        out.append((r[0], sum(k >= 0 for k in near[i]), low, low is not None and r[0] == low))
    return sorted(out, key=str)


def vectors(seed=3, n=150, size=12):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((25, size))
    rows = []
    for i in range(n):
        noise = rng.choice([0.0, 0.02, 0.1, 0.25])
        v = base[rng.integers(25)] + noise * rng.standard_normal(size)
        rows.append((1000 - i, (v * rng.choice([1.0, 7.0])).tolist(), int(rng.integers(3))))
    copy = rows[5][1]
    rows += [(2000 + i, copy, rows[5][2]) for i in range(60)]
    rows += [(3000, copy, 99), (3001, copy, None), (3002, None, 1), (3003, [], 1), (3004, [0.0] * size, 1)]
    rows += [(3005, [None] + [1.0] * (size - 1), 1), (3006, [float("nan")] + [1.0] * (size - 1), 1)]
    rows += [(3007, [float("inf")] + [1.0] * (size - 1), 1), (3008, copy[:5], rows[5][2]), (None, copy, rows[5][2])]
    rows += [(3009, copy[:5], rows[5][2]), (3010, [3e38] * size, 1), (3011, [1e-40] * size, 1)]
    return rows


@pytest.mark.parametrize("block", [8192, 16])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "CHUNK", min(256, block // 2))
    rows = vectors()
    # One vec_id with two vectors joins their components.
    rows += [(5000, rows[0][1], rows[0][2]), (5000, rows[7][1], rows[7][2])]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", key string").repartition(4)
    got = near_vectors(table).collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows)


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert near_vectors(spark.createDataFrame([(1, None, 2)], SCHEMA)).collect() == [(1, 0, 1, True)]


def test_bounds_hold_for_every_pair():
    import pandas as pd

    rng = np.random.default_rng(8)
    for size in (3, 64, 1500):
        full = rng.standard_normal((40, size)) * rng.choice([1e-20, 1.0, 1e20], (40, 1))
        zeros = np.zeros(40, np.int64)
        chunk = pd.DataFrame({"n": [40], "keys": [bytes(640)], "leaders": [zeros.tobytes()], "counts": [zeros.tobytes()], "vectors": [full.tobytes()]})
        side = embedding_dedup._Side(chunk, size)
        unit = full / np.linalg.norm(full, axis=1, keepdims=True)
        product = embedding_dedup.whole_products(side.q, side.q) * side.scale[:, None] * side.scale
        error = np.abs(unit @ unit.T - product)
        assert (error <= side.kept[:, None] * side.rest + side.rest[:, None]).all()
        assert error.max() > 0


def brute_clusters(rows, clusters=16, rounds=3):
    kept = []
    for vec_id, v, _ in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            held = [max(-(1 << 27), min(1 << 27, math.floor(64 * float(np.float32(x))))) for x in v]
            kept.append((vec_id, held))
    text = lambda i: "" if i is None else str(i)
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{text(r[0])}".encode()).hexdigest(), r[0] or 0, r[1]))
    centres = [r[1] for r in order[:clusters]]

    def nearest(p):
        d = [sum((a - b) ** 2 for a, b in zip(p, c)) for c in centres]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [nearest(p)[0] for _, p in kept]
        for k in range(len(centres)):
            mine = [p for (_, p), c in zip(kept, own) if c == k]
            if mine:
                centres[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *nearest(p)) for i, p in kept]
    total = sum(d for _, _, d in found)
    own = {k: sum(d for _, c, d in found if c == k) for k in range(len(centres))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, own[c], total, name[c]) for i, c, d in found), key=str)


@pytest.mark.parametrize("kind", ["spread", "clumps", "few", "ties"])
def test_clusters(spark, kind):
    rng = np.random.default_rng(5)
    if kind == "spread":
        points = rng.standard_normal((400, 64)) * 0.2
    elif kind == "clumps":
        points = rng.standard_normal((20, 64))[rng.integers(20, size=400)] + 0.1 * rng.standard_normal((400, 64))
    elif kind == "few":
        points = rng.standard_normal((7, 64))
    else:
        points = rng.integers(0, 2, (300, 64)) * (np.arange(64) < 3) / 64.0
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)]
    rows += [(3, points[3].tolist(), 0), (None, points[1].tolist(), None), (900, None, 1), (901, [1.0] * 63, 1), (902, [None] * 64, 1)]
    rows += [(903, [float("nan")] * 64, 1), (904, [float("-inf")] * 64, 1)]
    if kind == "spread":
        rows += [(905, [3e38] * 64, 1), (906, [1e6] * 64, 1)]
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", cluster int").repartition(3)
    assert sorted(map(tuple, clustered(table).collect()), key=str) == brute_clusters(rows)


def test_only_expired_vectors_are_scanned(spark, monkeypatch):
    """Settled clumps keep their gaps: later rounds scan less than all vectors."""
    rng = np.random.default_rng(6)
    # 16 far clumps; the first centroids may share one, so clumps only settle round by round.
    points = 3 * rng.standard_normal((16, 64))[np.arange(800) % 16] + 0.02 * rng.standard_normal((800, 64))
    sizes = []
    put = centroids.Scratch.put

    def counted(self, df, name):
        out = put(self, df, name)
        if name == "run":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(centroids.Scratch, "put", counted)
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)]
    got = clustered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(rows)
    assert sizes[0] == 800 and sizes[-1] < 800


def test_squared_distances_beyond_doubles():
    x = np.array([[1 << 27, -(1 << 27)] * 32, [(1 << 27) - 1, 5] * 32], np.int64)
    want = [[sum((a - b) ** 2 for a, b in zip(p, c)) for c in x.tolist()] for p in x.tolist()]
    assert squared_distances(x, x).tolist() == want


def test_no_clusters(spark):
    empty = clustered(spark.createDataFrame([(1, None, 2)], SCHEMA))
    assert empty.collect() == [] and "cluster_inertia" in empty.columns
