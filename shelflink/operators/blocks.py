"""Pairs of titles by common words, found block by block.

Listings are cut into blocks, and every block meets the entries that can fit one of its listings in one or
more cells. A task reads the listings of its cell, sorts their words once, and then lets the entries look
theirs up, many at a time: the rarest words of an entry are looked up until what is left cannot make up the
share alone, the weights of what is met are summed up for every pair, and only pairs whose sum can still
reach the share are compared word by word. Rare and frequent are meant within the block, which needs no
counts of the whole tables. Words and pairs are not shuffled; a title is one row with its distinct words as one text.

Where the weights of a pair have to be alike, blocks are ranges of weight, and an entry goes only to the blocks
whose range it can meet (``span``). Elsewhere blocks are dealt by ``id`` and an entry goes to all of them.

Rows of both sides have the ``id`` of a title, its lengths, its ``whole`` weight and its ``words``, distinct and
joined by blanks; listings may have ``weights``, a byte for every word, in place of its length and the blank after it.
Spellings go to every cell: rows whose ``words`` are a word of entries and the words of listings that it may be called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Listings in a block at most, cells for each core, words met at once, entries that a task reads before it looks them up.
BLOCK_ROWS, CELLS_PER_CORE, EXPANDED, READ = 400_000, 3, 1 << 17, 1 << 16
COLUMNS = ("id", "text_length", "sorted_length", "whole", "words", "weights")
#: What a row is, in the order in which a task reads them.
LISTING, SPELLING, ENTRY = range(3)
#: Beyond the words that have to be looked up, others are while all cost at most so many times as much, or so little.
MORE, CHEAP = 4, 64
#: Bits of a weight beside the number of a pair; a greater one stands for more than any share.
WEIGHT_BITS, HUGE = 12, 1 << 40
MOST_PACKED = (1 << WEIGHT_BITS) - 1
#: Titles whose weights differ by less than this factor are counted together.
STEP = 1.02


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all ranges, one range after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive items of about ``most`` together, one at least."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(start, end)
        start = end


def _found(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``np.searchsorted``, with neighbours one after the other."""
    order = np.argsort(wanted)
    places = np.empty(len(wanted), np.int64)
    places[order] = np.searchsorted(sorted_, wanted[order])
    return places


def _tokens(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All words of blank-separated texts, and where those of each text start."""
    lists = pc.split_pattern(texts.combine_chunks(), " ")
    starts = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(starts[0], starts[-1] - starts[0]), starts - starts[0]


def _numbers(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Numbers of words, -1 for those that the vocabulary lacks."""
    return pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy().astype(np.int64)


def weighed(batches: Iterator[pa.RecordBatch], known: pa.Table, other: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of ``(id, words)`` with their ``whole`` and ``weights``, those of ``known(word, weight)`` or else ``other``."""
    vocabulary = known["word"].combine_chunks()
    weight_of = np.append(known["weight"].to_numpy(), other).astype(np.int64)
    waiting, n = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            waiting.append(batch)
            n += len(batch)
        if n < (READ if batch is not None else 1):
            continue
        table = pa.Table.from_batches(waiting)
        words, starts = _tokens(table["words"])
        weight = weight_of[_numbers(words, vocabulary)]
        whole = np.add.reduceat(weight, starts[:-1])
        buffers = [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(weight.astype(np.uint8))]
        weights = pa.Array.from_buffers(pa.binary(), n, buffers)
        columns = [table["id"].combine_chunks(), pa.array(whole), table["words"].combine_chunks(), weights]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        waiting, n = [], 0


def _lengths(words: pa.Array) -> np.ndarray:
    """Length of each word and the blank after it."""
    return pc.utf8_length(words).to_numpy().astype(np.int64) + 1


class Titles:
    """Rows of one side as arrays. ``word`` and ``row`` have the known words of all titles, smaller numbers first."""

    def __init__(self, table: pa.Table, word: np.ndarray, starts: np.ndarray, weight_of: np.ndarray):
        one = {c: table[c].combine_chunks() for c in ("id", "text_length", "sorted_length", "whole")}
        self.ids, self.n = one["id"], len(table)
        self.text, self.sorted, self.whole = (one[c].to_numpy().astype(np.int64) for c in ("text_length", "sorted_length", "whole"))
        keys = np.repeat(np.arange(self.n), np.diff(starts))
        keys *= len(weight_of)
        keys += word
        if word.min(initial=0) < 0:
            keys = keys[word >= 0]
        keys.sort()
        self.row = (keys // max(len(weight_of), 1)).astype(np.int32)
        keys -= self.row.astype(np.int64) * len(weight_of)
        self.word = keys.astype(np.int32)
        del keys
        self.starts = _offsets(np.bincount(self.row, minlength=self.n))
        self.lengths = np.diff(self.starts)
        self.weight = weight_of[self.word].astype(np.int32)

    def tried(self, percent: int, cost_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words, always the last ones of a title, are to be looked up, and the weight of the others of each title.

        Those without which the others may make up ``percent`` of the whole, and more as long as they are cheap.
        """
        some, left = np.zeros(len(self.word), bool), np.zeros(self.n, np.int64)
        for rows in _pieces(self.lengths, EXPANDED):
            at = slice(int(self.starts[rows.start]), int(self.starts[rows.stop]))
            row, starts = self.row[at] - rows.start, self.starts[rows.start : rows.stop + 1] - at.start
            so_far, cost = _offsets(self.weight[at]), _offsets(cost_of[self.word[at]])
            # Weight of a word and of those before it.
            needed = (so_far[1:] - so_far[starts[:-1]][row]) * 100 >= self.whole[rows][row] * percent
            # The needed words of a title are its last ones, and so are those that are tried.
            first, end = starts[:-1], starts[1:]
            dear = cost[end] - cost[end - np.bincount(row[needed], minlength=len(end))]
            cheap = np.where(dear > 0, np.maximum(dear * MORE, CHEAP), -1)
            needed |= cost[end][row] - cost[:-1] <= cheap[row]
            some[at] = needed
            left[rows] = so_far[end - np.bincount(row[needed], minlength=len(end))] - so_far[first]
        return some, left


class Block:
    """Listings of a cell in rising order of ``whole``, their words numbered from the most frequent one."""

    def __init__(self, table: pa.Table, few: int | None, every: bool, spellings: pa.Table | None = None):
        table = table.sort_by("whole")
        words, starts = _tokens(table["words"])
        coded = words.dictionary_encode()
        number, self.n = coded.indices.to_numpy().astype(np.int64), len(table)
        count = np.bincount(number, minlength=len(coded.dictionary))
        order = np.argsort(-count, kind="stable")
        self.count, self.vocabulary = count[order], coded.dictionary.take(pa.array(order))
        renumbered = np.empty(len(order), np.int64)
        renumbered[order] = np.arange(len(order))
        number = renumbered[number]
        del coded, words
        if table["weights"].null_count:  # in all rows
            self.weight_of = _lengths(self.vocabulary)
        else:
            self.weight_of = np.zeros(len(order), np.int64)
            self.weight_of[number] = np.frombuffer(b"".join(table["weights"].to_pylist()), np.uint8)
        self.of = Titles(table, number, starts, self.weight_of)
        del number
        self.bits = max(self.n, 1).bit_length()
        self.column = np.full(len(order), -1, np.int32)
        self.every = self._posted(np.ones(len(self.of.word), bool)) if every else None
        if few is not None:
            some, self.left = self.of.tried(few, self.count)
            self.few = self._posted(some)
        self.own, self.own_weight, self.cost = self.vocabulary, self.weight_of, self.count
        self.called = None
        if spellings is not None:
            self._call(spellings)

    def _posted(self, some: np.ndarray) -> np.ndarray:
        """Sorted keys of word and row, with room for a weight."""
        keys = self.of.word[some].astype(np.int64)
        keys <<= self.bits
        keys |= self.of.row[some]
        keys <<= WEIGHT_BITS
        keys.sort()
        return keys

    def _call(self, spellings: pa.Table) -> None:
        """Number the words of entries from the one with the most places, with all that each may be called."""
        size = len(self.vocabulary)
        names, callers, called, n = [self.vocabulary], [np.arange(size, dtype=np.int32)], [np.arange(size, dtype=np.int32)], size
        for start in range(0, len(spellings), READ):
            words, starts = _tokens(spellings["words"].slice(start, READ))
            near, heads = _numbers(words, self.vocabulary), starts[:-1]
            caller = near[heads]
            near[heads] = -1
            new = np.flatnonzero((caller < 0) & np.logical_or.reduceat(near >= 0, heads))
            caller[new] = n + np.arange(len(new))
            n += len(new)
            names.append(words.take(pa.array(heads[new])))
            met = np.flatnonzero(near >= 0)
            callers.append(np.repeat(caller, np.diff(starts))[met].astype(np.int32))
            called.append(near[met].astype(np.int32))
        cost = np.zeros(n, np.int64)
        for caller, near in zip(callers, called, strict=True):
            cost += np.bincount(caller, self.count[near], n).astype(np.int64)
        order = np.argsort(-cost, kind="stable")
        self.own, self.cost = pa.concat_arrays(names).take(pa.array(order)), cost[order]
        self.own_weight = _lengths(self.own)
        renumbered = np.empty(n, np.int64)
        renumbered[order] = np.arange(n)
        keys = renumbered[np.concatenate(callers)]
        keys <<= 32
        keys |= np.concatenate(called)
        keys.sort()
        starts = np.searchsorted(keys, np.arange(n + 1) << 32)
        self.called = keys.astype(np.uint32).astype(np.int32), starts

    def entries(self, table: pa.Table) -> Titles:
        words, starts = _tokens(table["words"])
        return Titles(table, _numbers(words, self.own), starts, self.own_weight)

    def named(self, words: np.ndarray) -> np.ndarray:
        """How many words listings may call each."""
        return np.ones(len(words), np.int64) if self.called is None else np.diff(self.called[1])[words]

    def names(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``words``, words of entries, and the numbers of what listings call them."""
        if self.called is None:
            return np.arange(len(words)), words
        near, starts = self.called
        lengths = self.named(words)
        return np.repeat(np.arange(len(words)), lengths), near[_ranges(starts[words], lengths)]

    def met(
        self, posted: np.ndarray, entry: np.ndarray, words: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Entries, the rows from ``low`` to ``high`` of each that they meet in ``words``, and the weight of those words.

        ``entry`` rises; ``low`` and ``high`` are those of all entries. Every pair comes once; a weight may be too great.
        """
        keys = words.astype(np.int64) << self.bits
        starts = _found(posted, keys + low[entry] << WEIGHT_BITS)
        counts = np.maximum(_found(posted, keys + high[entry] << WEIGHT_BITS) - starts, 0)
        some = counts > 0
        entry, keys, starts, counts, weight = entry[some], keys[some], starts[some], counts[some], weight[some]
        every, first = np.unique(entry, return_index=True)
        ends = np.append(first, len(entry))
        for piece in _pieces(np.add.reduceat(counts, first) if len(first) else counts, EXPANDED):
            own = slice(int(ends[piece.start]), int(ends[piece.stop]))
            if counts[own].sum() > EXPANDED:  # one entry
                total = np.zeros(self.n, np.int64)
                for part in _pieces(counts[own], EXPANDED):
                    at = slice(own.start + part.start, own.start + part.stop)
                    rows = (posted[_ranges(starts[at], counts[at])] >> WEIGHT_BITS) - np.repeat(keys[at], counts[at])
                    total += np.bincount(rows, np.repeat(weight[at], counts[at]), self.n).astype(np.int64)
                rows = np.flatnonzero(total)
                yield np.full(len(rows), every[piece.start]), rows, total[rows]
                continue
            base = (np.repeat(np.arange(piece.stop - piece.start), np.diff(ends[piece.start : piece.stop + 1])) << self.bits) - keys[own]
            base <<= WEIGHT_BITS
            base += np.minimum(weight[own], MOST_PACKED)
            packed = posted[_ranges(starts[own], counts[own])]
            packed += np.repeat(base, counts[own])
            packed.sort()
            pair = packed >> WEIGHT_BITS
            once = np.flatnonzero(np.diff(pair, prepend=-1))
            packed &= MOST_PACKED
            if weight[own].max() >= MOST_PACKED:
                packed[packed == MOST_PACKED] = HUGE
            pair = pair[once]
            yield every[piece][pair >> self.bits], pair & ((1 << self.bits) - 1), np.add.reduceat(packed, once)

    def common(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of the listings ``rows``, one listing after the other, and their number."""
        lengths = self.of.lengths[rows]
        return _ranges(self.of.starts[rows], lengths), lengths


class Group:
    """A few entries with a table of their words: what an entry's row says about the word of a column."""

    def __init__(self, block: Block, entries: Titles, rows: np.ndarray):
        self.block, lengths = block, entries.lengths[rows]
        at = _ranges(entries.starts[rows], lengths)
        place, self.word = block.names(entries.word[at])
        #: Places of words among the entries', and the numbers of the words of listings that they may be called.
        self.at = at[place]
        self.row = np.repeat(np.arange(len(rows)), lengths)[place]
        self.used, self.column = np.unique(self.word, return_inverse=True)
        self.width = len(self.used) + 1
        self.table = np.zeros((len(rows), self.width), bool)
        self.table[self.row, self.column] = True
        block.column[self.used] = np.arange(len(self.used))

    def close(self) -> None:
        self.block.column[self.used] = -1

    def shared(self, entry: np.ndarray, listing: np.ndarray, weight: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Weight of the words of the listing that the entry has, for pieces of the pairs."""
        for piece in _pieces(self.block.of.lengths[listing], EXPANDED):
            at, lengths = self.block.common(listing[piece])
            column = self.block.column[self.block.of.word[at]]
            # Column -1 is the last one, which no entry has.
            hit = self.table.ravel()[np.repeat(entry[piece] * self.width, lengths) + np.where(column < 0, self.width - 1, column)]
            yield piece, np.add.reduceat(np.where(hit, weight[at], 0), _offsets(lengths)[:-1])


Pairs = tuple[np.ndarray, np.ndarray]


def _compared(block: Block, q: Titles, entry: np.ndarray, listing: np.ndarray, words: int, holds: Callable) -> Iterator[Pairs]:
    """The pairs, in order of entries, for which ``holds`` of a group, entries by place in it and in ``q``, and listings; ``words`` of entries together."""
    rows, starts = np.unique(entry, return_index=True)
    ends = np.append(starts, len(entry))
    for piece in _pieces(q.lengths[rows], words):
        own = slice(int(ends[piece.start]), int(ends[piece.stop]))
        group = Group(block, q, rows[piece])
        place = np.repeat(np.arange(piece.stop - piece.start), np.diff(ends[piece.start : piece.stop + 1]))
        good = holds(group, place, entry[own], listing[own])
        group.close()
        if len(good):
            yield entry[own][good], listing[own][good]


def sharing(block: Block, q: Titles, words: int, percent: int, enough: Callable) -> Iterator[Pairs]:
    """Pairs whose common words make up ``percent`` of the lighter side and satisfy ``enough``."""
    l = block.of
    some, left = q.tried(percent, block.cost)
    heavier = np.searchsorted(l.whole, q.whole)

    def holds(group, place, entry, listing):
        good = np.zeros(len(entry), bool)
        lighter = np.minimum(q.whole[entry], l.whole[listing])
        for piece, weight in group.shared(place, listing, l.weight):
            near = np.flatnonzero(weight * 100 >= lighter[piece] * percent)
            at = near + piece.start
            good[at] = enough(q, entry[at], l, listing[at], weight[near])
        return np.flatnonzero(good)

    every = slice(None)
    for posted, at, low, high in (
        (block.every, some, heavier, np.full(q.n, block.n)),
        (block.few, every, np.zeros(q.n, np.int64), heavier),
    ):
        for entry, rows, met in block.met(posted, q.row[at], q.word[at], q.weight[at], low, high):
            own, lighter = (left[entry], q.whole[entry]) if posted is block.every else (block.left[rows], l.whole[rows])
            most = np.minimum(met + own, lighter)
            near = np.flatnonzero(most * 100 >= lighter * percent)
            entry, rows = entry[near], rows[near]
            near = enough(q, entry, l, rows, most[near])
            yield from _compared(block, q, entry[near], rows[near], words, holds)


def overlapping(block: Block, q: Titles, words: int, percent: int) -> Iterator[Pairs]:
    """Pairs whose common words make up ``percent`` of the heavier side."""
    l = block.of
    some, left = q.tried(percent, block.cost)
    # The common weight is at most that of the lighter side.
    low, high = np.searchsorted(l.whole * 100, q.whole * percent), np.searchsorted(l.whole * percent, q.whole * 100, "right")

    def holds(group, place, entry, listing):
        good = np.zeros(len(entry), bool)
        heavier = np.maximum(q.whole[entry], l.whole[listing])
        for piece, weight in group.shared(place, listing, l.weight):
            good[piece] = weight * 100 >= heavier[piece] * percent
        return np.flatnonzero(good)

    for entry, rows, met in block.met(block.few, q.row[some], q.word[some], q.weight[some], low, high):
        # What both have beside the words met are words more frequent than those tried on one of the sides.
        most = met + np.maximum(left[entry], block.left[rows])
        near = most * 100 >= np.maximum(q.whole[entry], l.whole[rows]) * percent
        yield from _compared(block, q, entry[near], rows[near], words, holds)


def near(block: Block, q: Titles, words: int, percent: int, most_weight: int) -> Iterator[Pairs]:
    """Pairs of about equal weight in which ``percent`` of either side are words that the other has, by any of its keys."""
    l = block.of
    some, left = q.tried(percent, block.cost)
    low, high = np.searchsorted(l.whole, -(-q.whole * percent // 100)), np.searchsorted(l.whole, q.whole * 100 // percent, "right")
    l_weight, q_weight = np.minimum(l.weight, most_weight), np.minimum(q.weight, most_weight)

    def holds(group, place, entry, listing):
        good = np.zeros(len(entry), bool)
        for piece, weight in group.shared(place, listing, l_weight):
            good[piece] = weight * 100 >= l.whole[listing[piece]] * percent
        good = np.flatnonzero(good)
        place, entry, listing = place[good], entry[good], listing[good]
        # Own words of entries by row and column, sorted.
        keys = group.row * group.width + group.column
        order = np.argsort(keys)
        keys, own = keys[order], group.at[order]
        known = np.zeros(len(good), np.int64)
        for piece in _pieces(l.lengths[listing], EXPANDED):
            at, lengths = block.common(listing[piece])
            column = block.column[l.word[at]]
            hit = column >= 0
            which = np.repeat(np.arange(piece.start, piece.stop), lengths)[hit]
            wanted = place[which] * group.width + column[hit]
            starts = np.searchsorted(keys, wanted)
            counts = np.searchsorted(keys, wanted, "right") - starts
            which, own_ = np.repeat(which, counts), own[_ranges(starts, counts)]
            # A word with several keys in the listing counts once.
            which, own_ = np.divmod(np.unique(which * len(q.word) + own_), max(len(q.word), 1))
            known += np.bincount(which, q_weight[own_], len(good)).astype(np.int64)
        return good[known * 100 >= q.whole[entry] * percent]

    at = np.flatnonzero(some)
    names, ends = block.named(q.word[at]), np.searchsorted(q.row[at], np.arange(q.n + 1))
    for piece in _pieces(np.bincount(q.row[at], names, q.n), EXPANDED):
        own = at[ends[piece.start] : ends[piece.stop]]
        place, name = block.names(q.word[own])
        own = own[place]
        for entry, rows, met in block.met(block.every, q.row[own], name, q.weight[own], low, high):
            close = (met + left[entry]) * 100 >= q.whole[entry] * percent
            yield from _compared(block, q, entry[close], rows[close], words, holds)


def _several(ids: pa.Array) -> np.ndarray:
    """Which ids there are more than once."""
    number = ids.dictionary_encode("encode").indices.to_numpy()
    return np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)


def _looked_up(block: Block, table: pa.Table, find: Callable, once: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Ids of the pairs of some entries, with ``once`` without those that several titles of an id have in common."""
    entries, listings = block.entries(table), block.of

    def batch(pairs: list[Pairs]) -> pa.RecordBatch:
        both = (np.concatenate(side) for side in zip(*pairs, strict=True))
        ids = (side.ids.take(pa.array(at)) for side, at in zip((entries, listings), both, strict=True))
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(ids, schema, strict=True)], schema=schema)

    twice, ready, n = [], [], 0
    if once:
        several, other = _several(entries.ids), _several(listings.ids)
    for entry, listing in find(block, entries):
        if once:
            again = several[entry] | other[listing]
            twice.append((entry[again], listing[again]))
            entry, listing = entry[~again], listing[~again]
        ready.append((entry, listing))
        n += len(entry)
        if n >= READ:
            yield batch(ready)
            ready, n = [], 0
    if n:
        yield batch(ready)
    if sum(len(entry) for entry, _ in twice):
        same = batch(twice)
        keys = [c.dictionary_encode("encode").indices.to_numpy().astype(np.int64) for c in same.columns]
        _, first = np.unique(keys[0] * len(same) + keys[1], return_index=True)
        yield same.take(pa.array(first))


def _cells(
    batches: Iterator[pa.RecordBatch], find: Callable, few: int | None, every: bool, once: bool, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and side, with ``once`` by id too, to the pairs of each cell."""
    cell, listings, spellings, block, waiting = None, [], [], None, []

    def rest() -> Iterator[pa.RecordBatch]:
        if waiting:
            yield from _looked_up(block, pa.concat_tables(waiting), find, once, schema)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        place = batch.column("cell").to_numpy() * 3 + batch.column("side").to_numpy()
        edges = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            part = table.slice(start, end - start)
            own, side = divmod(int(place[start]), 3)
            if own != cell:
                yield from rest()
                cell, listings, spellings, block, waiting = own, [], [], None, []
            if side != ENTRY:
                (listings if side == LISTING else spellings).append(part)
                continue
            if block is None:
                if not listings:
                    continue
                called = pa.concat_tables(spellings) if spellings else None
                block = Block(pa.concat_tables(listings), few, every, called)
                listings, spellings = [], []
            waiting.append(part)
            if sum(map(len, waiting)) < READ:
                continue
            part, last = pa.concat_tables(waiting), 0
            if once:
                # The last id may go on in the next batch.
                number = part["id"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
                last = len(part) - int(np.flatnonzero(np.diff(number, prepend=-1))[-1])
            waiting = [part.slice(len(part) - last)] if last else []
            if last < len(part):
                yield from _looked_up(block, part.slice(0, len(part) - last), find, once, schema)
    yield from rest()


class Layout:
    """Which blocks listings of a weight are in, and the cells of each block.

    ``offered`` and ``wanted`` have the numbers of listings and of entries by step of weight, ``reach`` the
    steps that an entry of a step can meet, at most. A step of more than ``most`` listings is dealt out to several blocks.
    """

    def __init__(self, offered: dict[int, int], wanted: dict[int, int], reach: Callable, blocks: int, most: int, cells: int):
        steps = max([0, *offered, *(reach(s)[1] for s in wanted)]) + 2
        total = sum(offered.values())
        size = min(most, max(1, -(-total // blocks)))
        none = None
        first, last, block, filled = [none] * steps, [none] * steps, 0, 0
        for step in sorted(offered):
            n = offered[step]
            if filled and filled + n > size:
                block, filled = block + 1, 0
            parts = max(1, -(-n // most))
            first[step], last[step] = block, block + parts - 1
            filled = filled + n if parts == 1 else most
            block += parts - 1
        self.blocks = block + 1
        # A step without listings: the next block from below, the one before it from above.
        for step in reversed(range(steps)):
            first[step] = (first[step + 1] if step + 1 < steps else self.blocks) if first[step] is none else first[step]
        for step in range(steps):
            last[step] = (last[step - 1] if step else -1) if last[step] is none else last[step]
        self.first, self.last = first, last
        visits = [0] * (self.blocks + 1)
        for step, n in wanted.items():
            low, high = reach(step)
            a, b = first[max(low, 0)], last[high]
            if a <= b:
                visits[a] += n
                visits[b + 1] -= n
        for b in range(1, self.blocks + 1):
            visits[b] += visits[b - 1]
        visits = visits[: self.blocks]
        everyone = max(sum(visits), 1)
        self.parts = [max(1, round(cells * n / everyone)) for n in visits]
        self.start = [sum(self.parts[:b]) for b in range(self.blocks)]
        self.cells = sum(self.parts)
        #: Rows that go to cells, those of listings about.
        self.moved = sum(visits) + sum(total * p for p in self.parts) / self.blocks


def pairs_of_blocks(
    queries: DataFrame,
    listings: DataFrame,
    find: Callable,
    few: int | None,
    every: bool = True,
    block_rows: int = BLOCK_ROWS,
    span: int | None = None,
    spellings: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, listing_id)``, each once: what ``find`` makes of every block of listings and the entries that visit it.

    Both inputs must be tables that are cheap to read again. With ``few``, listings can be looked up by those words
    that they need to make up that percentage of the whole, with ``every`` by all. With ``span``, the lighter
    title of a pair weighs that percentage of the heavier one at least. ``spellings(words)`` has a word
    of entries and what listings may call it.
    """
    cores = CELLS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism

    def step_of(weight: Column) -> Column:
        return F.floor(F.log(F.greatest(weight, F.lit(1)).cast("double")) / log(STEP)).cast("int")

    least, most = F.floor(F.col("whole") * (span or 0) / 100), F.ceil(F.col("whole") * 100 / (span or 100))
    # Steps that differ by more than this never meet; two are for rounding.
    far = int(log(100 / span) / log(STEP)) + 2 if span else 0
    step, low, high = (step_of(w) if span else F.lit(0) for w in (F.col("whole"), least, most))

    def counted(rows: DataFrame) -> dict[int, int]:
        return {r.step: r.n for r in rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}

    offered, wanted = counted(listings), counted(queries)
    total = sum(offered.values())
    fewest = max(1, -(-total // block_rows))
    tried = sorted({fewest, *(min(cores, max(fewest, round(1.4**k))) for k in range(40))})
    layouts = [
        Layout(offered, wanted, lambda s: (s - far, s + far), k, block_rows if span else max(1, -(-total // k)), cores) for k in tried
    ]
    # As many blocks as repeat the fewest rows.
    layout = min(layouts, key=lambda x: x.moved)

    def at(values: list[int], place: Column) -> Column:
        return F.get(F.lit(values), F.least(place, F.lit(len(values) - 1)))

    def dealt(rows: DataFrame, side: int) -> DataFrame:
        if side == LISTING:
            parts = at(layout.last, step) - at(layout.first, step) + 1
            block = at(layout.first, step) + F.pmod(F.xxhash64("id"), parts).cast("int")
            rows = rows.withColumn("_block", block)
            part = F.explode(F.sequence(F.lit(0), at(layout.parts, F.col("_block")) - 1))
        else:
            first, last = at(layout.first, low), at(layout.last, high)
            rows = rows.withColumn("_block", F.explode_outer(F.when(first <= last, F.sequence(first, last)))).where("_block IS NOT NULL")
            part = F.pmod(F.xxhash64("id"), at(layout.parts, F.col("_block"))).cast("int")
        rows = rows.withColumn("_part", part)
        if side == ENTRY:
            rows = rows.withColumn("weights", F.lit(None).cast("binary"))
        return rows.select((at(layout.start, F.col("_block")) + F.col("_part")).alias("cell"), F.lit(side).alias("side"), *COLUMNS)

    both = dealt(listings, LISTING).union(dealt(queries, ENTRY))
    if spellings is not None:
        cells = F.explode(F.sequence(F.lit(0), F.lit(layout.cells - 1)))
        none = [F.lit(None).cast(both.schema[c].dataType).alias(c) for c in COLUMNS]
        none[COLUMNS.index("words")] = F.col("words")
        both = both.union(spellings.select(cells.alias("cell"), F.lit(SPELLING).alias("side"), *none))
    once = span is None
    rows = both.repartitionById(layout.cells, F.col("cell")).sortWithinPartitions("cell", "side", *["id"] * once)
    kinds = [t.schema["id"].dataType.simpleString() for t in (queries, listings)]
    types = [to_arrow_type(t.schema["id"].dataType) for t in (queries, listings)]
    schema = pa.schema(list(zip(("query_id", "listing_id"), types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cells(batches, find, few, every, once, schema)

    found = rows.mapInArrow(run, f"query_id {kinds[0]}, listing_id {kinds[1]}")
    # Titles of an id are together in a cell, except with ranges of weight.
    return found if once else found.distinct()
