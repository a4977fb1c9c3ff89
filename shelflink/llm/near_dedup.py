"""Near-duplicate documents by MinHash, banding, verification and connected components.

A document's set holds the hashes of its distinct word shingles. ``BANDS * ROWS`` universal hash
functions give its signature; documents that agree on all rows of a band share a bucket. Two
documents of similarity 0.8 share no bucket with probability (1 - 0.8^ROWS)^BANDS, 3 in a million.

Bounded work in crowded buckets, without losing a link:

1. Documents with the same set collapse to the smallest doc_id.
2. The bucket rows of all bands are range-sorted, which splits a bucket of any size over tasks. Each
   row is paired with its predecessor and with the first row of its bucket in that task: two pairs
   a row, never all pairs. Verified pairs are links; alternating large-star and small-star turns
   links into components.
3. A bucket may still hold members of several components. Only there, members outside the bucket's
   largest component meet all members of other components, in blocks of ``BLOCK`` x ``BLOCK``
   inside a task; a pair is tried in the first bucket it shares and leaves the task only when it
   passes the tests below. Those pairs are verified too, and the components taken again.

Before the full sets of a pair are compared, its parity sketches are: a sketch has ``SKETCH`` bits,
each the parity of the number of shingles hashed to it, so sketches of two sets differ in at most as
many bits as the sets differ in shingles. Pairs that differ in more bits than the threshold allows
go; no pair at the threshold does. Signatures that agree in more than 4.5 standard deviations less
than the threshold's share of places go as well.

NULL and empty texts have an empty set and are linked with nothing. Rows without ``doc_id`` are
no documents and are left out. Rows that repeat a ``doc_id`` are returned as often as they come;
their ``doc_id`` is one node. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelflink.llm.common import Scratch, in_slices, text_of

BANDS, ROWS = 32, 5
BLOCK = 500
SKETCH = 2048
#: Rows of small buckets that one call of a task takes together.
TOGETHER = 2000
SEED = 20240607


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words; A-Z lower-cased."""
    # bytes.split() splits at exactly the six ASCII white-space characters.
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    k = min(words, len(hashes))
    mixed = hashes[: len(hashes) - k + 1].copy()
    for i in range(1, k):
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += hashes[i : len(hashes) - k + 1 + i]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature_of(members: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash (factor * x + offset mod 2^32) over the set."""
    x = (members ^ (members >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 2048):
        hashed = np.multiply.outer(factors, x[start : start + 2048])
        hashed += offsets[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
    return low


def sketch_of(members: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((members >> np.uint64(20)).astype(np.int64) & (SKETCH - 1), minlength=SKETCH).astype(np.uint8) & 1)


def _rows(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _near_enough(bits: np.ndarray, shingles: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of together ``shingles`` members may differ in ``bits`` and reach the threshold."""
    return (100 + percent) * bits.astype(np.int64) <= (100 - percent) * shingles


def _universal(seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    factors = random.integers(0, 2**31, BANDS * ROWS, dtype=np.int64) * 2 + 1
    return factors.astype(np.uint32), random.integers(0, 2**32, BANDS * ROWS, dtype=np.int64).astype(np.uint32)


def _signatures(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors, offsets = _universal(SEED)
        for batch in batches:
            n, keys, signatures, sketches = [], [], [], []
            for text in batch["text"]:
                members = shingle_set(text, words)
                n.append(len(members))
                keys.append(xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None)
                signatures.append(signature_of(members, factors, offsets).tobytes() if len(members) else None)
                sketches.append(sketch_of(members).tobytes() if len(members) else None)
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "n_shingles": n, "key": keys, "signature": signatures, "sketch": sketches}
            )

    return run


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, signature) to one row per band: a hash of the band's rows and of the band."""
    for batch in batches:
        if not len(batch):
            continue
        rows = np.frombuffer(b"".join(batch["signature"]), np.uint32).reshape(len(batch), BANDS, ROWS)
        bucket = np.full((len(batch), BANDS), 0x51_7C_C1_B7, np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            bucket ^= bucket >> np.uint64(31)
            bucket *= np.uint64(0xD6E8FEB86659FD93)
            bucket += rows[:, :, r]
        bucket ^= bucket >> np.uint64(32)
        bucket *= np.uint64(0x9E3779B97F4A7C15)
        # The low bits say which band a bucket belongs to.
        bucket = (bucket & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)
        yield pd.DataFrame(
            {"bucket": bucket.view(np.int64).ravel(), "doc_id": np.repeat(batch["doc_id"].to_numpy(), BANDS)}
        )


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (bucket, doc_id) rows to rows of shared buckets, with predecessor and first row in this task.

    The first and last bucket of a task may go on in another one and are always passed on. A bucket
    whose rows fill many batches is streamed: only its first row and the row at hand are held.
    """
    bucket = first = before = None
    pending = False  # the row at hand is not yet known to share its bucket
    first_bucket = True
    for batch in batches:
        buckets, docs, heads, lasts = [], [], [], []

        def emit(b, d, h, p):
            buckets.append(b), docs.append(d), heads.append(h), lasts.append(p)

        for b, d in zip(batch["bucket"].tolist(), batch["doc_id"].tolist(), strict=True):
            if b == bucket:
                if pending:
                    emit(b, first, first, first)
                    pending = False
                emit(b, d, first, before)
            else:
                if bucket is not None:
                    if pending and first_bucket:
                        emit(bucket, first, first, first)
                    first_bucket = False
                bucket, first, pending = b, d, True
            before = d
        yield pd.DataFrame({"bucket": buckets, "doc_id": docs, "head": heads, "before": lasts}, dtype="int64")
    if pending:
        yield pd.DataFrame({"bucket": [bucket], "doc_id": [first], "head": [first], "before": [first]})


def _cross(cut: int, percent: int):
    """Alike pairs of minor members and members of other components in the same bucket, for one cell."""

    def run(minor: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(minor) and len(members):
            members = members.sort_values(["bucket", "doc_id"])
            bucket, docs = members["bucket"].to_numpy(), members["doc_id"].to_numpy()
            components, n = members["component"].to_numpy(), members["n_shingles"].to_numpy()
            sketches, signatures = _rows(members["sketch"], np.uint64), _rows(members["signature"], np.uint32)
            low = np.searchsorted(bucket, minor["bucket"].to_numpy(), "left")
            high = np.searchsorted(bucket, minor["bucket"].to_numpy(), "right")
            own_sketch, own_signature = _rows(minor["sketch"], np.uint64), _rows(minor["signature"], np.uint32)
            rows = zip(minor["bucket"], minor["doc_id"], minor["component"], minor["n_shingles"], strict=True)
            for i, (b, doc, component, size) in enumerate(rows):
                part = slice(low[i], high[i])
                bits = np.bitwise_count(sketches[part] ^ own_sketch[i]).sum(axis=1)
                good = _near_enough(bits, n[part] + size, percent) & (components[part] != component)
                other = np.flatnonzero(good) + low[i]
                if len(other):
                    agree = signatures[other] == own_signature[i]
                    # Tried in the first bucket that the two share.
                    first = agree.reshape(len(other), BANDS, ROWS).all(axis=2).argmax(axis=1) == b & (BANDS - 1)
                    other = other[first & (agree.sum(axis=1) >= cut)]
                    found += [(min(doc, d), max(doc, d)) for d in docs[other].tolist()]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for left, right in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    return run


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            members = [shingle_set(t, words).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "members": members})

    return run


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of ``links`` (a, b), a < b.

    Alternating large-star and small-star; each step is an aggregation with partial sums and a join
    on the node. Every step is a written table.
    """
    edges = scratch.put(links.distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # Large-star: greater neighbours of u point to the smallest of u and its neighbours.
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = scratch.put(large.where("a < b").distinct(), "large")
        # Small-star: u and its smaller neighbours point to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        pairs = large.join(low, "b")
        small = pairs.select(F.col("m").alias("a"), F.col("a").alias("b")).union(pairs.select("m", "b"))
        small = scratch.put(small.where("a < b").distinct(), "small")
        scratch.drop(edges, large)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))  # at most one row a node


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, n_shingles long, key binary, signature binary, sketch binary"
    signed = in_slices(texts, _signatures(words), schema)
    signed = scratch.put(signed, "signatures")
    classes = signed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("leader"))
    classes = scratch.put(classes, "classes")
    leaders = signed.join(
        classes.select(F.col("leader").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi"
    )
    leaders = scratch.put(leaders.dropDuplicates(["doc_id", "key"]).drop("key"), "leaders")

    bucketed = leaders.mapInPandas(_buckets, "bucket long, doc_id long")
    ordered = bucketed.repartitionByRange(partitions, "bucket", "doc_id").sortWithinPartitions("bucket", "doc_id")
    shared = ordered.mapInPandas(_neighbours, "bucket long, doc_id long, head long, before long")
    shared = scratch.put(shared, "shared")

    # 4.5 standard deviations of the share of agreeing minima at the threshold.
    n, share = BANDS * ROWS, percent / 100
    cut = int(n * (share - 4.5 * (share * (1 - share) / n) ** 0.5))
    to_first = shared.select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    to_last = shared.select(F.col("before").alias("a"), F.col("doc_id").alias("b"))
    near = to_first.union(to_last).where("a < b").distinct()
    pairs = scratch.put(_alike(near, leaders, cut, percent), "pairs")
    links = scratch.put(_verified(texts, pairs, words, percent), "links")
    reached = components(scratch, links)

    crossing = _crossing(scratch, shared, leaders, reached, cut, percent).distinct().join(pairs, ["a", "b"], "left_anti")
    crossing = scratch.put(crossing, "crossing")
    more = scratch.put(_verified(texts, crossing, words, percent), "more-links")
    if more.isEmpty():
        final = reached
    else:
        # The components so far stand for the links they were made of.
        so_far = reached.select(F.col("component").alias("a"), F.col("node").alias("b"))
        final = components(scratch, so_far.union(more))
    ids = classes.join(final, classes["leader"] == final["node"], "left").select(
        "key", F.coalesce("component", "leader").alias("component_id")
    )
    ids = scratch.put(ids, "components")
    narrow = scratch.put(signed.select("doc_id", "n_shingles", "key"), "documents")
    scratch.drop(signed, leaders, shared, pairs, links, crossing, more, classes)
    component = F.coalesce("component_id", "doc_id")
    return narrow.join(ids, "key", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept")
    )


def _alike(pairs: DataFrame, leaders: DataFrame, cut: int, percent: int) -> DataFrame:
    """Pairs whose sketches and signatures allow the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                bits = np.bitwise_count(_rows(batch["sketch_a"], np.uint64) ^ _rows(batch["sketch_b"], np.uint64)).sum(axis=1)
                agree = (_rows(batch["signature_a"], np.uint32) == _rows(batch["signature_b"], np.uint32)).sum(axis=1)
                good = (agree >= cut) & _near_enough(bits, (batch["n_a"] + batch["n_b"]).to_numpy(), percent)
                yield batch.loc[good, ["a", "b"]]

    def side(name: str) -> DataFrame:
        columns = {"doc_id": name, "n_shingles": f"n_{name}", "sketch": f"sketch_{name}", "signature": f"signature_{name}"}
        return leaders.select(*[F.col(c).alias(n) for c, n in columns.items()])

    return pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(run, "a long, b long").distinct()


def _verified(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold. Only documents of some pair give their sets."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = texts.join(involved.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = in_slices(needed, _sets(words), "doc_id long, members binary")
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("set_b"))
    joined = pairs.join(right, "b").join(left, "a")
    return in_slices(joined, _confirm(percent), "a long, b long").distinct()


def _crossing(
    scratch: Scratch, shared: DataFrame, leaders: DataFrame, reached: DataFrame, cut: int, percent: int
) -> DataFrame:
    """Alike pairs of different components in one bucket that no earlier pair can have joined."""
    rows = shared.select("bucket", "doc_id").distinct()
    component = F.coalesce("component", "doc_id")
    labelled = rows.join(reached, rows["doc_id"] == reached["node"], "left").select(
        "bucket", "doc_id", component.alias("component")
    )
    sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    crowded = sizes.groupBy("bucket").agg(
        F.count("*").alias("parts"), F.sum("n").alias("members"), F.max_by("component", F.struct("n", "component")).alias("major"),
        F.max("n").alias("largest"),
    ).where("parts > 1")
    blocks = crowded.select(
        "bucket", "major", F.ceil(F.col("members") / BLOCK).alias("wide"),
        F.ceil((F.col("members") - F.col("largest")) / BLOCK).alias("high"),
    )
    rows = scratch.put(labelled.join(blocks, "bucket").join(leaders, "doc_id"), "crowded")
    # A large bucket is a grid of cells; small ones share a cell, each keeping to itself.
    small = F.greatest("wide", "high") == 1
    shares = max(1, rows.count() // TOGETHER)
    cell = F.when(small, F.pmod(F.xxhash64("bucket"), F.lit(shares))).otherwise(F.col("bucket"))
    spread, zero = F.xxhash64("doc_id"), F.lit(0).cast("long")

    def placed(df: DataFrame, own: str, own_size: str, other: str, other_size: str) -> DataFrame:
        df = df.withColumns({"cell": cell, "small": small, own: F.pmod(spread, F.col(own_size))})
        df = df.withColumn(other, F.explode(F.sequence(zero, F.col(other_size) - 1)))
        return df.select("cell", "small", "x", "y", "bucket", "doc_id", "component", "n_shingles", "sketch", "signature")

    members = placed(rows, "x", "wide", "y", "high")
    minor = placed(scratch.again(rows).where("component != major"), "y", "high", "x", "wide")
    key = ["cell", "small", "x", "y"]
    return minor.groupBy(key).cogroup(members.groupBy(key)).applyInPandas(_cross(cut, percent), "a long, b long")


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component; same columns. Rows without ``doc_id`` go."""
    scratch = Scratch(docs.sparkSession, "near-kept")
    kept = scratch.put(near_duplicates(docs, words, percent).where("kept").select("doc_id").distinct(), "kept")
    # Whole rows in one column, so no name can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select("row.*")
