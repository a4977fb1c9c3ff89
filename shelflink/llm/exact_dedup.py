"""Exact deduplication with a cuckoo-filter index over live digests.

Documents are equal when their texts are identical. A text is known by its SHA-256 digest. Copies
are first counted per digest and salt where they are read, so a group that holds a third of all
rows arrives as a few rows. Digests are dealt into shards; the task of a shard streams its rows
through a cuckoo filter: a miss is a new text and is inserted, a hit is verified against the full
digests stored in the two buckets and is either a copy (its counts are added) or a chance match of
fingerprints (it is inserted as well). When the filter overflows it doubles and is filled again from
the stored keys. The answers go back to the documents by digest and salt, so no join key holds more
than one part in ``SALTS`` of a group.

Rows without text count as empty. Rows without ``doc_id`` are no documents and are left out. Rows
repeated with the same ``doc_id`` and text are one document; the same ``doc_id`` with two texts is
two documents. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflink.llm.common import Scratch, text_of

SALTS = 64
SHARD_ROWS = 200_000
SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Set of live 32-byte digests: 16-bit fingerprints in buckets of four, and the keys beside them.

    A digest has two buckets, each computable from the other and the fingerprint. ``find`` compares
    the stored digest of every slot whose fingerprint agrees, so answers are exact.
    """

    def __init__(self, buckets: int = 64):
        self.keys: list[bytes | None] = []  # by entry number; None once deleted
        self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [[0] * SLOTS for _ in range(buckets)]
        self.entries = [[-1] * SLOTS for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[2:10], "big") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def find(self, digest: bytes) -> int:
        """Entry number of ``digest``, -1 if it is not live."""
        mark, *buckets = self._places(digest)
        for b in buckets:
            marks = self.prints[b]
            if mark in marks:
                for slot in range(SLOTS):
                    entry = self.entries[b][slot]
                    if marks[slot] == mark and self.keys[entry] == digest:
                        return entry
        return -1

    def insert(self, digest: bytes) -> int:
        """Add a digest that ``find`` does not know; its entry number."""
        self.keys.append(digest)
        if not self._place(digest, len(self.keys) - 1):
            self._grow()
        return len(self.keys) - 1

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; false if there is none."""
        entry = self.find(digest)
        if entry < 0:
            return False
        mark, *buckets = self._places(digest)
        for b in buckets:
            for slot in range(SLOTS):
                if self.prints[b][slot] == mark and self.entries[b][slot] == entry:
                    self.prints[b][slot], self.entries[b][slot] = 0, -1
                    self.keys[entry] = None
                    return True
        return False

    def _place(self, digest: bytes, entry: int) -> bool:
        mark, first, second = self._places(digest)
        for b in (first, second):
            if 0 in self.prints[b]:
                slot = self.prints[b].index(0)
                self.prints[b][slot], self.entries[b][slot] = mark, entry
                return True
        bucket = first
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            marks, entries = self.prints[bucket], self.entries[bucket]
            mark, marks[slot] = marks[slot], mark
            entry, entries[slot] = entries[slot], entry
            bucket = self._other(bucket, mark)
            if 0 in self.prints[bucket]:
                slot = self.prints[bucket].index(0)
                self.prints[bucket][slot], self.entries[bucket][slot] = mark, entry
                return True
        return False

    def _grow(self) -> None:
        """Double the buckets until all stored keys fit. Every stored key is placed anew."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(self._place(k, i) for i, k in enumerate(self.keys) if k is not None):
                return


def _merge_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows (digest, salt, doc_id, n) of a shard with keep_id and group_size of their digest."""
    index, keep, size = CuckooIndex(), [], []
    entry_of = np.empty(len(rows), np.int64)
    for i, (digest, doc, n) in enumerate(zip(rows["digest"], rows["doc_id"], rows["n"], strict=True)):
        entry = index.find(digest)
        if entry < 0:
            entry = index.insert(digest)
            keep.append(doc)
            size.append(n)
        else:
            keep[entry] = max(keep[entry], doc)
            size[entry] += n
        entry_of[i] = entry
    return pd.DataFrame(
        {
            "digest": rows["digest"],
            "salt": rows["salt"],
            "keep_id": np.asarray(keep, np.int64)[entry_of],
            "group_size": np.asarray(size, np.int64)[entry_of],
        }
    )


def _change_shard(key: tuple, live: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    index = CuckooIndex()
    for digest in live["digest"]:
        if index.find(digest) < 0:
            index.insert(digest)
    for digest, add in zip(changes["digest"], changes["add"], strict=True):
        if not add:
            index.delete(digest)
        elif index.find(digest) < 0:
            index.insert(digest)
    return pd.DataFrame({"shard": key[0], "digest": [k for k in index.keys if k is not None]})


def update_index(live: DataFrame, changes: DataFrame) -> DataFrame:
    """Live digests (shard INT, digest BINARY) after ``changes`` (shard, digest, ``seq`` LONG, ``add``).

    Changes apply per digest in the order of ``seq``. Only the last change of a digest matters, so
    changes shrink to one row per digest before they reach the task of their shard.
    """
    last = changes.groupBy("shard", "digest").agg(F.max_by("add", "seq").alias("add"))
    return live.groupBy("shard").cogroup(last.groupBy("shard")).applyInPandas(
        _change_shard, "shard int, digest binary"
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document; the largest doc_id stays."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    digest = F.unhex(F.sha2(text_of(), 256))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    keyed = docs.where("doc_id IS NOT NULL").select("doc_id", digest.alias("digest"), salt.alias("salt"))
    keyed = scratch.put(keyed, "digests")
    per_document = keyed.groupBy("digest", "salt", "doc_id").agg(F.lit(1).alias("one"))
    partial = per_document.groupBy("digest", "salt").agg(
        F.max("doc_id").alias("doc_id"), F.count("one").alias("n")
    )
    shards = max(1, -(-keyed.count() // SHARD_ROWS), int(_partitions(docs)))
    # Bytes of the digest that the filter itself does not use.
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 17, 4)), 16, 10).cast("long"), F.lit(shards))
    merged = (
        partial.withColumn("shard", shard.cast("int"))
        .groupBy("shard")
        .applyInPandas(_merge_shard, "digest binary, salt int, keep_id long, group_size long")
    )
    return per_document.join(merged, ["digest", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _partitions(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.shuffle.partitions")


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one of the documents of equal text; same columns.

    Rows without ``doc_id`` are no documents and go. One of repeated rows stays.
    """
    scratch = Scratch(docs.sparkSession, "exact-kept")
    groups = scratch.put(exact_groups(docs), "groups")
    kept = groups.where("kept").select("doc_id", F.col("text_sha256").alias("sha"))
    # Whole rows in one column, so no name can clash.
    rows = docs.where("doc_id IS NOT NULL").select(
        F.struct("*").alias("row"), "doc_id", F.sha2(text_of(), 256).alias("sha")
    )
    out = rows.join(kept.hint("shuffle_hash"), ["doc_id", "sha"], "left_semi")
    # Only a table that repeats whole rows needs a second look at them.
    if docs.where("doc_id IS NOT NULL").count() != groups.count():
        out = out.dropDuplicates(["doc_id", "sha"])
    return out.select("row.*")
