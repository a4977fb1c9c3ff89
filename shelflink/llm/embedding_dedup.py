"""Near-duplicate embeddings by tiles of int8 products with certain error bounds.

A unit vector ``u`` is kept as ``scale * q + rest`` with ``q`` of whole numbers from -127 to 127. For
two of them ``u.v = scale_u scale_v q_u.q_v + (u - rest_u).rest_v + rest_u.v``, so the cosine lies
within ``|u - rest_u| |rest_v| + |rest_u|`` of the product of the whole numbers, for every vector by its own
measured ``|rest|``. Pairs whose product plus bound stays below the threshold are certainly none;
only the others are computed again from the full components in doubles.

Copies (equal label and components) collapse to one row with a count first. The rest is sorted by
label, number of components and the signs of a few projections, and cut into chunks of one label and
blocks of chunks. Two blocks that share a label meet in one task; chunks whose mean directions are too
far apart for their radii are skipped, which loses nothing. A task returns for each of its vectors
the number of partners and one representative of the partners' local component: never pairs, so a
group of near copies of any size stays linear in every task. Sums of the numbers are the links, and
the local components are joined by large-star and small-star.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite components, vectors without label, and
rows without vec_id link with nothing (component_id is their vec_id); vectors of different length
do not link; rows that repeat a vec_id are vectors of their own in the number of links and one node in
components; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflink.llm.common import Scratch
from shelflink.llm.near_dedup import components
from shelflink.operators.lookup import lookup_join

THRESHOLD = 0.93
#: Vectors of a chunk (one label) and of a block (one side of a task).
CHUNK, BLOCK = 256, 8192
PLANES = 24
#: More than the rounding of products, norms and square roots in doubles.
SLACK = 1e-9
CHUNK_ROWS = "label string, size int, block long, n int, keys binary, leaders binary, counts binary, vectors binary"


def linkable() -> Column:
    """Rows that can have partners."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return known & F.coalesce(finite & nonzero, F.lit(False))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``key``, 16 bytes of label and components, and ``signs`` of the projections."""
    for batch in batches:
        label, vectors = batch.column("label").to_pylist(), batch.column("embedding")
        values, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *vectors.value_lengths().to_pylist()])
        keys, signs = [], []
        for name, start, stop in zip(label, ends[:-1], ends[1:], strict=True):
            row = values[start:stop] + 0.0  # no negative zeros
            named = b"%d:%b%b" % (len(row), row.tobytes(), name.encode())
            keys.append(hashlib.blake2b(named, digest_size=16).digest())
            signs.append(_signs(row))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(ends[1:] - ends[:-1], pa.int32()), vectors,
             pa.array(keys, pa.binary()), pa.array(signs, pa.int64())],
            ["vec_id", "label", "size", "embedding", "key", "signs"],
        )


_planes: dict[int, np.ndarray] = {}


def _signs(row: np.ndarray) -> int:
    size = len(row)
    if size not in _planes:
        _planes.clear()
        _planes[size] = np.random.default_rng(size).standard_normal((PLANES, size))
    scaled = row.astype(float) / np.abs(row).max()
    return int("".join("1" if s else "0" for s in _planes[size] @ scaled > 0), 2)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of consecutive rows with one label and size, numbered into blocks of the partition."""
    first = TaskContext.get().partitionId() << 32
    block, filled, rows, kind = first, 0, [], None

    def chunk() -> pa.RecordBatch:
        keys, leaders, counts, vectors = zip(*rows, strict=True)
        columns = [
            [kind[0]], [kind[1]], [block], [len(rows)], [b"".join(keys)],
            [np.array(leaders, np.int64).tobytes()], [np.array(counts, np.int64).tobytes()],
            [np.array(vectors, np.float64).tobytes()],
        ]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        names = ["label", "size", "block", "n", "keys", "leaders", "counts", "vectors"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("label", "size", "key", "leader", "n")]
        vectors = batch.column("embedding")
        for k, (label, size, key, leader, n) in enumerate(zip(*columns, strict=True)):
            if rows and ((label, size) != kind or len(rows) == CHUNK):
                yield chunk()
                filled, rows = filled + len(rows), []
                if filled + CHUNK > BLOCK:
                    block, filled = block + 1, 0
            kind = (label, size)
            rows.append((key, leader, n, vectors[k].values.to_numpy(zero_copy_only=False)))
    if rows:
        yield chunk()


class _Side:
    """Chunks of one label and size inside a block, as arrays."""

    def __init__(self, chunks: pd.DataFrame, size: int):
        self.lengths = chunks["n"].tolist()
        self.starts = np.cumsum([0, *self.lengths])
        self.keys = np.frombuffer(b"".join(chunks["keys"]), "V16")
        self.leaders = np.frombuffer(b"".join(chunks["leaders"]), np.int64)
        self.counts = np.frombuffer(b"".join(chunks["counts"]), np.int64)
        self.full = np.frombuffer(b"".join(chunks["vectors"]), np.float64).reshape(-1, size)
        greatest = np.abs(self.full).max(axis=1, keepdims=True)
        scaled = self.full / greatest
        self.norm = np.sqrt((scaled * scaled).sum(axis=1)) * greatest[:, 0]
        unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        self.scale = np.abs(unit).max(axis=1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        rest = unit - self.scale[:, None] * self.q
        self.rest = np.sqrt((rest * rest).sum(axis=1)) + SLACK
        self.kept = 1 + self.rest  # |u - rest| is at most that
        means, self.radius = [], []
        for start, stop in zip(self.starts[:-1], self.starts[1:]):
            mean = unit[start:stop].sum(axis=0)
            mean = mean / (np.sqrt(mean @ mean) or 1.0)
            means.append(mean)
            self.radius.append(math.acos(max(-1.0, min(1.0, float((unit[start:stop] @ mean).min())))) + 1e-7)
        self.means = np.array(means)


def whole_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of int8 rows; whole numbers below 2**24 are exact in single precision, 1,000 components at a time."""
    out = left[:, :1000].astype(np.float32) @ right[:, :1000].astype(np.float32).T
    if left.shape[1] > 1000:
        out = out.astype(np.float64)
        for start in range(1000, left.shape[1], 1000):
            part = slice(start, start + 1000)
            out += left[:, part].astype(np.float32) @ right[:, part].astype(np.float32).T
    return out


def _possible(a: _Side, rows: slice, b: _Side, columns: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile whose cosine can reach the threshold by their own bounds."""
    product = whole_products(a.q[rows], b.q[columns])
    # First against one bound a row, then the bound of each pair.
    slack = a.kept[rows] * b.rest[columns].max() + a.rest[rows]
    least = (threshold - SLACK - slack) / (a.scale[rows] * b.scale[columns].max())
    x, y = np.nonzero(product >= np.minimum(least, least * (1 - 1e-6))[:, None])
    i, j = x + rows.start, columns[y]
    bound = a.kept[i] * b.rest[j] + a.rest[i] + SLACK
    near = product[x, y].astype(float) * a.scale[i] * b.scale[j] + bound >= threshold
    return i[near], j[near]


def _cosines(a: _Side, i: np.ndarray, b: _Side, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for start in range(0, len(i), 1 << 15):
        part = slice(start, start + (1 << 15))
        x, y = a.full[i[part]], b.full[j[part]]
        # By greatest components first, so that no product over- or underflows.
        sx, sy = np.abs(x).max(axis=1), np.abs(y).max(axis=1)
        x, y = x / sx[:, None], y / sy[:, None]
        out[part] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    return out


def _join(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Let ``group`` (smallest member of each node's component) join the nodes of the pairs."""
    while True:
        a, b = group[x], group[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        parent = np.arange(len(group))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        group[:] = parent[group]


def _meet(a: _Side, b: _Side | None, threshold: float) -> pd.DataFrame:
    """Partners and local components of the vectors of one side with itself or of two sides."""
    other = a if b is None else b
    shift = 0 if b is None else len(a.leaders)
    nodes = len(a.leaders) + (0 if b is None else len(b.leaders))
    links, group = np.zeros(nodes, np.int64), np.arange(nodes)
    widest = math.acos(threshold) + 1e-7
    for k, (start, stop) in enumerate(zip(a.starts[:-1], a.starts[1:])):
        angle = np.arccos(np.clip(other.means @ a.means[k], -1.0, 1.0))
        close = angle <= widest + a.radius[k] + np.array(other.radius) + 1e-7
        if b is None:
            close[:k] = False
        spans = [np.arange(other.starts[m], other.starts[m + 1]) for m in np.flatnonzero(close)]
        if not spans:
            continue
        i, j = _possible(a, slice(int(start), int(stop)), other, np.concatenate(spans), threshold)
        if b is None:
            i, j = i[i < j], j[i < j]
        linked = _cosines(a, i, other, j) >= threshold
        i, j = i[linked], j[linked]
        np.add.at(links, i, other.counts[j])
        np.add.at(links, j + shift, a.counts[i])
        _join(group, i, j + shift)
    sides = [a] if b is None else [a, b]
    leaders, keys = np.concatenate([s.leaders for s in sides]), np.concatenate([s.keys for s in sides])
    low = np.full(nodes, np.iinfo(np.int64).max)
    np.minimum.at(low, group, leaders)
    has = np.flatnonzero(links)
    return pd.DataFrame(
        {"key": [k.tobytes() for k in keys[has]], "leader": leaders[has], "links": links[has], "low": low[group[has]]}
    )


def _cells(threshold: float):
    """Compares the chunks of two blocks, or of one with itself, label by label."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"key": [], "leader": [], "links": [], "low": []})]
        theirs = dict(list(right.groupby(["label", "size"]))) if len(right) else {}
        for kind, chunks in left.groupby(["label", "size"]):
            a = _Side(chunks, int(kind[1]))
            if left["mate"].iat[0] == left["block"].iat[0]:
                found.append(_meet(a, None, threshold))
            elif kind in theirs:
                found.append(_meet(a, _Side(theirs[kind], int(kind[1])), threshold))
        return pd.concat(found[1:] or found, ignore_index=True).astype({"leader": "int64", "links": "int64", "low": "int64"})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    usable = rows.where(linkable()).withColumn("label", F.col("label").cast("string"))
    element = rows.schema["embedding"].dataType.elementType.simpleString()
    digested = usable.select("vec_id", "label", "embedding").mapInArrow(
        _digests, f"vec_id long, label string, size int, embedding array<{element}>, key binary, signs long"
    )
    digested = scratch.put(digested, "digests")
    copies = digested.groupBy("key").agg(F.min("vec_id").alias("leader"), F.count("*").alias("n"))
    copies = scratch.put(copies, "copies")
    # One row per set of copies: the row of its smallest vec_id, whichever where that is repeated.
    owners = digested.withColumn("leader", F.col("vec_id")).join(copies, ["key", "leader"])
    first = owners.dropDuplicates(["key"])
    order = ["label", "size", "signs", "key"]
    ordered = first.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    chunks = scratch.put(
        ordered.select("label", "size", "key", "leader", "n", "embedding").mapInArrow(_packed, CHUNK_ROWS), "chunks"
    )

    # Blocks that share a label and size meet; a block also meets itself. One row per block and label.
    kinds = scratch.put(chunks.groupBy("label", "size", "block").agg(F.count("*").alias("chunks")).drop("chunks"), "blocks")
    mates = scratch.again(kinds).withColumnRenamed("block", "mate")
    cells = kinds.join(mates, ["label", "size"]).where("block <= mate").select("block", "mate").distinct()
    cells = scratch.put(cells, "cells")
    left = chunks.join(cells, "block")
    right = scratch.again(chunks).withColumnRenamed("block", "mate").join(scratch.again(cells).where("block < mate"), "mate")
    by_cell = ["block", "mate"]
    met = left.groupBy(by_cell).cogroup(right.groupBy(by_cell)).applyInPandas(
        _cells(threshold), "key binary, leader long, links long, low long"
    )
    met = scratch.put(met, "met")
    narrow = digested.select("vec_id", "key", F.monotonically_increasing_id().alias("_spread"))
    narrow = lookup_join(narrow, copies, "key", F.col("_spread"), counts=copies.select("key", "n"))
    narrow = scratch.put(narrow, "narrow")
    # A vec_id of several sets of copies joins them.
    ids = narrow.groupBy("vec_id").agg(F.min("leader").alias("least"), F.max("leader").alias("most"))
    several = narrow.join(ids.where("least < most").select("vec_id"), "vec_id", "left_semi").where("leader < vec_id")
    edges = met.where("low < leader").select(F.col("low").alias("a"), F.col("leader").alias("b")).union(
        several.select("leader", "vec_id")
    )
    reached = scratch.put(components(scratch, edges), "components")

    linked = met.groupBy("key").agg(F.sum("links").alias("links"))
    # Copies are partners of each other.
    facts = copies.join(linked, "key", "left").join(reached, copies["leader"] == reached["node"], "left")
    facts = facts.select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "leader").alias("component_id")
    )
    facts = scratch.put(facts, "facts")
    known = lookup_join(narrow.drop("leader", "n"), facts, "key", F.col("_spread"), counts=copies.select("key", "n"))
    scratch.drop(digested, chunks, kinds, cells, met)
    alone = rows.where(~linkable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
