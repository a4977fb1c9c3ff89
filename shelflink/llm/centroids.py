"""Centroid clustering with heap-ordered bounds.

Every vector of a cluster has a gap: the distance to its second nearest centroid (lower bound of all
others) less the distance to its own (upper bound). When centroids move, the gap of a vector of
cluster c shrinks by at most the drift of c plus the greatest drift of another centroid. So its
place in the heap of c is ``gap + drift accumulated by c when it was scanned``; it is certain to
stay while that exceeds the drift accumulated by now, whatever happened in between. A round pops
the expired vectors of each heap, scans just these against all centroids, exactly and in integers,
and pushes them again; sums of the clusters change by the moved vectors only.

On Spark a heap is a set of runs: tables whose files are sorted by (cluster, place). A pop is a
range of places per cluster, which the scan skips to by the statistics of the files; a push writes
one more run. Popped entries stay in the older runs below the threshold recorded for the run, so
nothing is rewritten. Only centroids, drifts and sums (clusters x dimensions) pass the driver.

Rows that are not kept (NULL, wrong length, NULL or non-finite components) are absent from the
result; repeated rows count as often as they come; a vec_id of NULL is hashed as empty text; extra
columns are ignored; no kept row gives an empty result, fewer rows than clusters fewer centroids. A component beyond +-2**27 after scaling is held there, so
that a squared distance fits a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflink.llm.common import Scratch

GREATEST = 1 << 27
#: Up to this component squared distances of 64 components are whole numbers in doubles.
IN_DOUBLES = 1 << 22
RUN = "vec_id long, point array<int>, was int, cluster int, place double"


def whole_points(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """vec_id and ``floor(scale * x)`` of each component of the vectors that are kept."""
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    held = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(GREATEST)), F.lit(-GREATEST)).cast("int")
    return vectors.where((F.size("embedding") == dimensions) & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", held).alias("point")
    )


def first_centroids(points: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The points with the smallest hashes; ``clusters`` rows reach the driver."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = points.withColumn("_hash", F.sha2(named, 256)).orderBy("_hash", "vec_id", "point").limit(clusters).collect()
    return np.array([r["point"] for r in rows], np.int64)


def _points(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x centroids) as whole numbers."""
    small = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= IN_DOUBLES
    x, c = (points.astype(float), centroids.astype(float)) if small and points.shape[1] <= 64 else (points, centroids)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def _scan(centroids: np.ndarray, drift: np.ndarray, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assign each vector to its nearest centroid and give it a place in that cluster's heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            distance = squared_distances(_points(batch.column("point"), centroids.shape[1]), centroids)
            nearest = distance.argmin(axis=1) if n else np.zeros(0, np.int64)  # the smaller number wins ties
            own = distance[np.arange(n), nearest].astype(float)
            distance[np.arange(n), nearest] = np.iinfo(np.int64).max
            second = distance.min(axis=1, initial=np.iinfo(np.int64).max).astype(float)
            place = np.sqrt(second) - np.sqrt(own) + drift[nearest]
            was = pa.nulls(n, pa.int32()) if first else batch.column("cluster")
            columns = [batch.column("vec_id"), batch.column("point"), was, pa.array(nearest, pa.int32()), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "point", "was", "cluster", "place"])

    return run


def _changes(clusters: int, dimensions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the vectors of a run add to the sums of their cluster and take from that they left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((clusters, dimensions + 1), np.int64)
        for batch in batches:
            points = _points(batch.column("point"), dimensions)
            rows = np.column_stack([points, np.ones(len(points), np.int64)])
            to = batch.column("cluster").to_numpy(zero_copy_only=False)
            left = batch.column("was").fill_null(-1).to_numpy(zero_copy_only=False)
            moved = to != left
            np.add.at(sums, to[moved], rows[moved])
            np.subtract.at(sums, left[moved & (left >= 0)], rows[moved & (left >= 0)])
        cluster, place = np.nonzero(sums)
        columns = [pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(sums[cluster, place])]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "component", "value"])

    return run


def _totals(run: DataFrame, clusters: int, dimensions: int) -> np.ndarray:
    """Changes of all sums as Python integers; the last column is the number of vectors."""
    parts = run.select("point", "was", "cluster").mapInArrow(
        _changes(clusters, dimensions), "cluster int, component int, value long"
    )
    total = F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    out = np.zeros((clusters, dimensions + 1), object)
    for row in parts.groupBy("cluster", "component").agg(total).collect():
        out[row["cluster"], row["component"]] = int(row["value"])
    return out


def _moved(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Floor of the mean for clusters with vectors, the old centroid for others."""
    moved = [
        [int(s) // int(row[-1]) for s in row[:-1]] if row[-1] else old.tolist()
        for old, row in zip(centroids, sums, strict=True)
    ]
    return np.array(moved, np.int64).reshape(centroids.shape)


def _drift(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How much a round can shrink the gaps of each cluster: own drift and the greatest other one."""
    way = np.sqrt(((after - before).astype(float) ** 2).sum(axis=1))
    others = [np.delete(way, c).max(initial=0.0) for c in range(len(way))]
    return way + np.array(others)


def _due(drift: np.ndarray) -> list[float]:
    """Places up to these have expired; the margin covers the rounding of roots and sums."""
    return [float(d) * (1 + 1e-9) + 1e-6 for d in drift]


def _between(low: list[float], high: list[float] | None) -> Column:
    """Entries above ``low`` of their cluster and, with ``high``, not above that."""
    chosen = F.lit(False)
    for c, place in enumerate(low):
        mine = (F.col("cluster") == c) & (F.col("place") > place)
        if high is not None:
            mine = mine & (F.col("place") <= high[c])
        chosen = chosen | mine
    return chosen


def _to_centroid(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = centroids[batch.column("cluster").to_numpy(zero_copy_only=False)]
            gap = _points(batch.column("point"), centroids.shape[1]) - own
            columns = [batch.column("vec_id"), batch.column("cluster"), pa.array((gap * gap).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return run


def clustered(
    vectors: DataFrame, clusters: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    ``vectors`` (vec_id, embedding). The result reads written tables.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    points = scratch.put(whole_points(vectors, dimensions, scale), "points")
    centroids = first_centroids(points, clusters, seed)
    count = len(centroids)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not count:
        return spark.createDataFrame([], schema)

    drift = np.zeros(count)
    never = [float("-inf")] * count

    def push(rows: DataFrame, first: bool) -> DataFrame:
        scanned = rows.mapInArrow(_scan(centroids, drift, first), RUN)
        return scratch.put(scanned.sortWithinPartitions("cluster", "place"), "run")

    runs = [push(points, True)]
    popped = [never]
    sums = _totals(runs[0], count, dimensions)
    for turn in range(rounds):
        after = _moved(centroids, sums)
        drift = drift + _drift(centroids, after)
        centroids = after
        due = _due(drift)
        expired = [r.where(_between(low, due)).select("vec_id", "point", "cluster") for r, low in zip(runs, popped, strict=True)]
        rows = expired[0]
        for more in expired[1:]:
            rows = rows.union(more)
        runs.append(push(rows, False))
        popped = [due] * (len(runs) - 1) + [never]
        if turn + 1 < rounds:
            sums = sums + _totals(runs[-1], count, dimensions)

    alive = [r.where(_between(low, None)).select("vec_id", "point", "cluster") for r, low in zip(runs, popped, strict=True)]
    rows = alive[0]
    for more in alive[1:]:
        rows = rows.union(more)
    assigned = scratch.put(rows.mapInArrow(_to_centroid(centroids), "vec_id long, cluster int, distance long"), "assigned")
    scratch.drop(points, *runs)
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(exact).collect()}
    whole, longest = sum(inertia.values()), (1 << 63) - 1
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(c, min(t, longest), min(whole, longest), names[c]) for c, t in inertia.items()]
    fact_schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    # One row per cluster.
    return assigned.join(F.broadcast(spark.createDataFrame(facts, fact_schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
