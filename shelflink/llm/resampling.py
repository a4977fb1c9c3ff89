"""Importance resampling of documents towards a target distribution.

Features are runs of one to ``longest`` words, hashed into ``buckets`` buckets. One table of counts
of the documents and one of the target give each bucket a gain, the scaled logarithm of the ratio of
its smoothed shares; a document weighs the sum of the gains of its features, read from one array. A
Gumbel draw from a hash of its id turns the weight into a score, and the highest scores are drawn.

The cut is found without sorting the documents: each partition reports a median of its remaining
keys above and below the last pivot with their number, the weighted median of those medians is the
next pivot, and at least an eighth of the remaining keys goes in every round, down to the exact last
key drawn. A partition's median is the weighted median of the medians of its batches, so a task holds
one batch at a time. Only the keys drawn are sorted, by range, and numbered.

NULL texts have no words; repeated rows are rows of their own (a doc_id repeated with other texts
included, ties go by doc_id, then number of features, then row); a NULL doc_id is hashed as empty text
and comes last in ties; extra columns are ignored; empty tables give empty results, an empty target
gains that only smooth.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflink.llm.common import Scratch, running_total

# Words of lower-cased UTF-8; every byte of a character beyond ASCII counts.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
BUCKETS = 10_000
#: Bytes of a text whose words are held at a time.
STRETCH = 1 << 20
KEY = ["_last", "_doc", "_features", "_row"]
#: Remaining keys are written anew when fewer than one in this many are left of the table read.
SHRINK = 4


def _stretches(text: bytes) -> Iterator[list[bytes]]:
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + STRETCH) if start + STRETCH < len(text) else None
        stop = gap.start() if gap else len(text)
        yield WORD.findall(text, start, stop)
        start = stop


def feature_buckets(text: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words of a text (UTF-8) and the bucket of each of its features."""
    n_words, before, found = 0, [], []
    for words in _stretches(text.lower()):
        n_words += len(words)
        words, old = before + words, len(before)
        after = [b" " + w for w in words]
        hashes = list(map(crc32, words))
        found.append(np.array(hashes[old:], np.int64) % buckets)
        for length in range(2, longest + 1):
            # The checksum of a run goes on from that of the run without its last word.
            hashes = list(map(crc32, after[length - 1 :], hashes))
            found.append(np.array(hashes[max(0, old - length + 1) :], np.int64) % buckets)
        before = words[max(0, len(words) - longest + 1) :] if longest > 1 else []
    return n_words, np.concatenate(found).astype(np.uint16) if found else np.zeros(0, np.uint16)


def hashed(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features and ``features`` (two bytes each) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                done = [feature_buckets(t or b"", longest, buckets) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([n for n, _ in done], pa.int64()),
                        pa.array([len(f) for _, f in done], pa.int64()),
                        pa.array([f.tobytes() for _, f in done], pa.binary()),
                    ],
                    ["doc_id", "n_words", "n_features", "features"],
                )

    return texts.mapInArrow(run, "doc_id long, n_words long, n_features long, features binary")


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All features of a batch in one array, and where each row's begin and end."""
    values = column.to_pylist()
    ends = np.cumsum([0, *(len(v) // 2 for v in values)])
    return np.frombuffer(b"".join(values), np.uint16), ends


def bucket_counts(features: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: at most one row per bucket and partition is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                counts += np.bincount(_joined(batch.slice(start, 256).column("features"))[0], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["bucket", "n"])

    return features.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket from the counts of both sides; at most ``buckets`` rows a side reach the driver."""
    s, t = ({r["bucket"]: r["n"] for r in side.collect()} for side in (own, target))
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b: int) -> int:
        share = (t.get(b, 0) + 1.0) * (all_s + float(buckets)) / ((s.get(b, 0) + 1.0) * (all_t + float(buckets)))
        return math.floor(1000 * math.log(share))

    return np.array([gain(b) for b in range(buckets)], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                every, ends = _joined(part.column("features"))
                sums = np.concatenate([[0], np.cumsum(gain[every])])
                weight = pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("doc_id", "n_words", "n_features")] + [weight],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def drawn_score(seed: int) -> Column:
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    chance = (number + 0.5) / F.lit(4294967296.0)
    return F.col("weight") + F.floor(F.log(-F.log(chance)) * -1000)


# --- weighted median of medians ----------------------------------------------------------------


def _up_to(keys: np.ndarray, pivot: tuple[int, ...]) -> np.ndarray:
    """Rows of ``keys`` (one column per part of the key) that are not above ``pivot``."""
    up, level = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    for column, value in zip(keys.T, pivot, strict=True):
        up |= level & (column < value)
        level &= column == value
    return up | level


def _median(keys: list[tuple[int, ...]], weights: list[int]) -> tuple[int, ...]:
    """Least key that with the smaller ones holds half of the weight."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    half, so_far = sum(weights) / 2, 0
    for k in order:
        so_far += weights[k]
        if so_far >= half:
            return keys[k]
    raise ValueError("no keys")


def _survey(pivot: tuple[int, ...] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each side of ``pivot`` the number of a partition's keys and a median of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        medians: dict[bool, list] = {False: [], True: []}
        sizes: dict[bool, list[int]] = {False: [], True: []}
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in KEY])
            above = ~_up_to(keys, pivot) if pivot else np.ones(len(keys), bool)
            for side in (False, True):
                mine = keys[above == side]
                if len(mine):
                    middle = np.lexsort(mine.T[::-1])[(len(mine) - 1) // 2]
                    medians[side].append(tuple(mine[middle].tolist()))
                    sizes[side].append(len(mine))
        sides = [s for s in (False, True) if sizes[s]]
        rows = [(s, sum(sizes[s]), *_median(medians[s], sizes[s])) for s in sides]
        columns = list(zip(*rows, strict=True)) or [()] * (2 + len(KEY))
        types = [pa.bool_(), *[pa.int64()] * (1 + len(KEY))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["above", "n", *KEY]
        )

    return run


def _not_above(pivot: tuple[int, ...]) -> Column:
    """``KEY`` is not above ``pivot``; the leading column by itself, so that the scan can skip files."""
    whole = F.struct(*KEY) <= F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(KEY, pivot, strict=True)))
    return (F.col(KEY[0]) <= pivot[0]) & whole


def _above(pivot: tuple[int, ...]) -> Column:
    return (F.col(KEY[0]) >= pivot[0]) & ~_not_above(pivot)


def cutoff(scratch: Scratch, keys: DataFrame, wanted: int) -> tuple[int, ...]:
    """The ``wanted``-th smallest key (1 or more); keys are unique. One row per partition and side reaches the driver."""
    schema = "above boolean, n long, " + ", ".join(f"{c} long" for c in KEY)
    rest, table, pivot, size, all_keys = keys, None, None, 0, 0
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        found = rest.mapInArrow(_survey(pivot), schema).collect()
        n = {side: sum(r["n"] for r in found if r["above"] == side) for side in (False, True)}
        size, all_keys = size or sum(n.values()), all_keys or sum(n.values())
        if pivot and n[False] == wanted:
            return pivot
        side = n[False] < wanted
        if pivot:
            rest = rest.where(_above(pivot) if side else _not_above(pivot))
        wanted -= n[False] if side else 0
        left = n[side]
        mine = [r for r in found if r["above"] == side]
        pivot = _median([tuple(r[c] for c in KEY) for r in mine], [r["n"] for r in mine])
        if left * SHRINK <= size:
            smaller = scratch.put(rest.coalesce(max(1, partitions * left // all_keys)), "keys")
            if table is not None:
                scratch.drop(table)
            rest = table = smaller
            size = left


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    least_words: int = 20,
    seed: int = 42,
    longest: int = 3,
    buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs`` (doc_id, text).

    ``target`` (text) gives the distribution aimed at. Of the N documents with ``least_words`` words or
    more, ``percent * N // 100`` are drawn and ranked from 1; rank is NULL elsewhere. At most 65,536
    buckets. The result reads written tables.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError(f"buckets must be from 1 to 65536: {buckets}")
    scratch = Scratch(docs.sparkSession, "resampling")
    features = scratch.put(hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), longest, buckets), "features")
    aim = hashed(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(aim, buckets), buckets)
    greatest = (1 << 63) - 1
    scored = weighed(features, gain).withColumn("score", drawn_score(seed))
    scored = scored.withColumns(
        {
            "_last": -F.col("score"),
            "_doc": F.coalesce("doc_id", F.lit(greatest)),
            "_features": F.col("n_features"),
            "_row": F.monotonically_increasing_id(),
        }
    )
    scored = scratch.put(scored, "scored")
    scratch.drop(features)
    enough = F.col("n_words") >= least_words
    entering = scored.where(enough)
    wanted = entering.count() * percent // 100
    columns = [F.col(c) for c in ("doc_id", "n_words", "n_features", "weight", "score")]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = cutoff(scratch, entering.select(*KEY), wanted)
    winners = entering.where(_not_above(last)).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_total(scratch, winners, "_one", KEY, "rank").select(*columns, "rank")
    others = scored.where(~enough | _above(last))
    return ranked.unionByName(others.select(*columns, F.lit(None).cast("long").alias("rank")))
