"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

An example or document is the unit vector of (1 + log count) * idf over all its words, idf counted over all
documents; a word that no example has counts as a word of one document. Labels change no weight, so cosines are those of
plain TF-IDF.

Examples are sorted by their heaviest frequent terms and cut into blocks. The ``DENSE`` most frequent terms, which make up
most postings, are stored as columns with the largest weight of each block; the other lists are so short that they
rarely have two postings in a block, so the postings themselves take the place of its largest weight. Both
bound the similarity of a block's examples. Queries with the same most promising block are searched together, so that they need
much the same blocks. Blocks are scored in falling order of this bound; a query
skips those whose bound is below the similarity of its k-th best example. That is done in single precision; whatever is near the k-th best is scored again in double precision, so the k nearest are
exact; ties go to the smaller doc_id.

``VOTERS`` examples vote with weight 1 / (distance + 0.05), times 1 + ``TELLING`` for each telling word that
text and example share: a word that goes with the label (chi-squared at least ``LEAST_CHI2``, at least ``LEAST_LIFT`` times
as frequent in one class as in the other). The share of toxic votes is calibrated by isotonic regression on
held-back examples, which vote only afterwards. Texts without any word of the examples get the rate of such
examples. The ``NEAREST`` first voters and the telling words are the evidence.

Bound of the fit: labelled documents in the order of a hash, at most ``TRAIN_ROWS`` and ``TRAIN_BYTES`` of
text. The arrays of the index follow from it (at most four bytes for each byte of text, usually less than one), pass
the driver once and are broadcast; tasks count the words, build the index and calibrate. Everything else covers all rows and whole
texts. NULL text counts as empty. Without any labelled document the score is 0.5.
Repeated rows are scored each; of differing texts of one doc_id the one with the smallest hash is learned from, once. Rows
without ``doc_id`` are scored, never learned from. NULL labels are left out; differing labels of a
document average. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelflink.llm.common import Scratch, in_slices, text_of
from shelflink.llm.labelled import bin_of, calibrated, calibration, remainder, training_texts

TRAIN_ROWS, TRAIN_BYTES = 20_000, 64 << 20
TELLING = 10.0
LEAST_CHI2, LEAST_LIFT, LEAST_DOCS = 25.0, 3.0, 4
NEAREST, VOTERS = 15, 50
BLOCK = 64
#: Terms stored as columns, blocks scored together, queries searched together, queries put in order. None changes a result.
DENSE, GROUP, TOGETHER, ORDERED = 512, 16, 128, 1024
#: More than single precision can lose.
SLACK = 1e-5
THRESHOLD = 0.7
REMEMBERED = 50_000
#: Different words counted in a task before they are looked up.
COUNTED = 500_000
#: A-Z to a-z; letters, digits and bytes of non-ASCII characters stay, all else parts words.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all ranges, one range after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def unit(counts: dict[int, int], idf: np.ndarray) -> dict[int, float]:
    terms = sorted(counts)
    weights = (1 + np.log([counts[t] for t in terms])) * idf[terms] if terms else np.zeros(0)
    return dict(zip(terms, (weights / np.sqrt(weights @ weights)).tolist() if terms else [], strict=True))


class BlockMaxIndex:
    """Unit vectors of examples by blocks: columns of frequent terms with the largest weight of each block, postings of the rest."""

    def __init__(self, terms: list[bytes], idf: np.ndarray, ids: list[int], vectors: Iterable[dict[int, float]], y: list[float]):
        lists = [(np.fromiter(v, np.int32, len(v)), np.fromiter(v.values(), float, len(v))) for v in vectors]
        weights = np.concatenate([np.zeros(0), *(w for _, w in lists)])
        self._build(
            terms, idf, np.array(ids, np.int64), np.array([len(t) for t, _ in lists], np.int64),
            np.concatenate([np.zeros(0, np.int32), *(t for t, _ in lists)]), np.arange(len(weights), dtype=np.int32), weights,
            np.ones(len(terms)), np.array(y, float),
        )

    @classmethod
    def of_counts(cls, given: dict) -> BlockMaxIndex:
        """Index of the arrays that ``fit_toxicity`` sends out; examples without words are left out."""
        some = given["lengths"] > 0
        counts, idf = given["counts"], given["idf"]
        index = cls.__new__(cls)
        index._build(
            given["words"].split(), idf, given["ids"][some], given["lengths"][some], given["terms"], counts,
            1 + np.log(np.maximum(np.arange(counts.max(initial=0) + 1), 1)), idf, given["y"][some],
            given["telling"], given["unknown"], given["held"][some],
        )
        return index

    def _build(self, words, idf, ids, lengths, terms, codes, values, scale, y, telling=None, unknown=1.0, held=None) -> None:
        """A weight is ``values[code] * scale[term]``, over the length of its vector if ``scale`` is not one."""
        self.number = {w: i for i, w in enumerate(words)}
        self.idf, self.unknown, self.values, self.scale = idf, unknown, values, scale
        self.telling = np.zeros(len(words), bool) if telling is None else telling
        n, m = len(ids), len(words)
        first = _offsets(lengths)
        frequent = np.argsort(-np.bincount(terms, minlength=m), kind="stable")[:DENSE]
        self.column = np.full(m, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent), dtype=np.int32)
        # Examples by their eight heaviest frequent terms, the doc_id last: those of one language or subject share blocks.
        heaviest, norms = np.full((n, 8), -1, np.int64), np.ones(n)
        for i in range(n):
            row = slice(first[i], first[i + 1])
            weight = values[codes[row]] * scale[terms[row]]
            column = self.column[terms[row]]
            top = np.lexsort((column, np.where(column < 0, 1.0, -weight)))[:8]
            heaviest[i, : len(top)] = column[top]
            norms[i] = np.sqrt(weight @ weight)
        order = np.lexsort((ids, *heaviest.T[::-1]))
        moved = _ranges(first[order], lengths[order])
        self.ids, self.y, self.norms = ids[order], y[order], norms[order]
        self.held = np.zeros(n, bool) if held is None else held[order]
        # Rows: the vector of each example.
        self.starts, self.terms, self.codes = _offsets(lengths[order]), terms[moved], codes[moved]
        del moved
        self.blocks = -(-n // BLOCK)
        place = np.repeat(np.arange(n, dtype=np.int32), lengths[order])
        rare = self.column[self.terms] < 0
        self.dense = np.zeros((self.blocks * BLOCK, len(frequent)), np.float32)
        at = np.flatnonzero(~rare)
        self.dense[place[at], self.column[self.terms[at]]] = self._shares(at, place)
        self.largest = self.dense.reshape(self.blocks, BLOCK, len(frequent)).max(1)
        at = np.flatnonzero(rare)
        at = at[np.argsort(self.terms[at], kind="stable")]
        self.places, self.shares = place[at], self._shares(at, place)
        self.posted = _offsets(np.bincount(self.terms[at], minlength=m))
        # Rows of telling words only.
        at = np.flatnonzero(self.telling[self.terms])
        self.names = {int(t): words[t].decode("utf-8", "replace") for t in np.flatnonzero(self.telling)}
        self.told, self.told_starts = self.terms[at], np.searchsorted(place[at], np.arange(n + 1))

    def _shares(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        weights = self.values[self.codes[at]] * self.scale[self.terms[at]]
        return (weights / self.norms[place[at]]).astype(np.float32)

    def query(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text's unit vector; words that no example has only lengthen the vector."""
        counted = Counter(words)
        terms = np.array([self.number.get(w, -1) for w in counted], np.int64)
        weights = 1 + np.log(np.fromiter(counted.values(), float, len(counted)))
        known = terms >= 0
        others = weights[~known] * self.unknown
        terms, weights = terms[known], weights[known]
        order = np.argsort(terms)
        terms = terms[order]
        weights = weights[order] * self.idf[terms]
        return terms, weights / np.sqrt(weights @ weights + others @ others) if len(terms) else weights

    def vector(self, words: list[bytes]) -> dict[int, float]:
        terms, weights = self.query(words)
        return dict(zip(terms.tolist(), weights.tolist(), strict=True))

    def _columns(self, given: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Weights of the queries' frequent terms."""
        columns = np.zeros((len(given), self.dense.shape[1]), np.float32)
        for r, (terms, weights) in enumerate(given):
            at = self.column[terms]
            frequent = at >= 0
            columns[r, at[frequent]] = weights[frequent]
        return columns

    def _alike(self, given: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Order of the queries by the block with their highest bound over frequent terms."""
        return np.argsort((self._columns(given) @ self.largest.T).argmax(1), kind="stable")

    def _near(self, given: list[tuple[np.ndarray, np.ndarray]], k: int, hide: np.ndarray | None) -> np.ndarray:
        """Places whose similarity in single precision may be one of the k largest, as a mask for each query."""
        n, slots = len(given), self.blocks * BLOCK
        columns = self._columns(given)
        score = np.zeros((n, slots), np.float32)
        for r, (terms, weights) in enumerate(given):
            rare = self.column[terms] < 0
            terms, weights = terms[rare], weights[rare]
            starts = self.posted[terms]
            lengths = self.posted[terms + 1] - starts
            found = _ranges(starts, lengths)
            score[r] = np.bincount(self.places[found], self.shares[found] * np.repeat(weights, lengths), slots)
        bound = columns @ self.largest.T + score.reshape(n, self.blocks, BLOCK).max(2)
        best = np.zeros((n, k), np.float32)
        scored = np.zeros((n, self.blocks), bool)
        order = np.argsort(-bound.max(0), kind="stable")
        for start in range(0, self.blocks, GROUP):
            group = order[start : start + GROUP]
            # Rounding must not end the search early, nor leave out a tie.
            reach = bound[:, group].max(1)
            open_ = np.flatnonzero((reach > 0) & (reach >= best.min(1) - SLACK))
            if not len(open_):
                continue
            asked, cos = columns[open_], np.empty((len(open_), len(group) * BLOCK), np.float32)
            for j, block in enumerate(group.tolist()):
                lies, into = slice(block * BLOCK, (block + 1) * BLOCK), slice(j * BLOCK, (j + 1) * BLOCK)
                np.matmul(asked, self.dense[lies].T, out=cos[:, into])
                cos[:, into] += score[open_, lies]
                if hide is not None:
                    cos[:, into][:, hide[lies]] = 0
                score[open_, lies] = cos[:, into]
            scored[np.ix_(open_, group)] = True
            best[open_] = np.partition(np.concatenate([best[open_], cos], 1), -k, 1)[:, -k:]
        near = (score > 0) & (score >= best.min(1)[:, None] - SLACK)
        return near & np.repeat(scored, BLOCK, axis=1)

    def nearest_of(self, queries: list, k: int = NEAREST, without_held: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places, cosines and common telling words of the k most similar examples with a term in common, for each query.

        A query is a pair of arrays as ``query`` makes it, or a dictionary of the same.
        """
        none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        if not len(self.ids) or not queries:
            return [none for _ in queries]
        given = [
            (np.fromiter(q, np.int64, len(q)), np.fromiter(q.values(), float, len(q))) if isinstance(q, dict) else q for q in queries
        ]
        hide = None
        if without_held:
            hide = np.append(self.held, np.zeros(self.blocks * BLOCK - len(self.held), bool))
        weight_of, met = np.zeros(len(self.column)), np.zeros(len(self.column), bool)
        out = [none] * len(given)
        order = self._alike(given).tolist() if len(given) > TOGETHER else range(len(given))
        found = ((i, near) for some in batched(order, TOGETHER) for i, near in zip(some, self._near([given[i] for i in some], k, hide), strict=True))
        for i, near in found:
            terms, weights = given[i]
            at = np.flatnonzero(near)
            if not len(at):
                continue
            weight_of[terms], met[terms] = weights * self.scale[terms], True
            starts, ends = self.starts[at], self.starts[at + 1]
            held = np.concatenate([self.terms[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            # Few words of an example are the query's: find them in a small table first.
            hits = np.flatnonzero(met[held])
            whose = np.repeat(np.arange(len(at)), ends - starts)[hits]
            codes = self.codes[hits + (starts - _offsets(ends - starts)[:-1])[whose]]
            products = weight_of[held[hits]] * self.values[codes]
            cos = np.round(np.bincount(whose, products, len(at)) / self.norms[at], 9)
            keep = np.lexsort((self.ids[at], -cos))[:k]
            at, cos = at[keep], cos[keep]
            lengths = self.told_starts[at + 1] - self.told_starts[at]
            shared = weight_of[self.told[_ranges(self.told_starts[at], lengths)]] > 0
            common = np.bincount(np.repeat(np.arange(len(at)), lengths)[shared], minlength=len(at))
            weight_of[terms], met[terms] = 0, False
            out[i] = at, cos, common
        return out

    def nearest(self, query: dict[int, float], k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([query], k)[0][:2]

    def votes(self, queries: list, without_held: bool = False) -> list[tuple[float, list[int]]]:
        """Share of toxic votes, and the doc_ids of the nearest voters, for each query."""
        out = []
        for at, cos, common in self.nearest_of(queries, VOTERS, without_held):
            weight = (1 + TELLING * common) / (1 - np.minimum(cos, 1) + 0.05)
            out.append((float(weight @ self.y[at] / weight.sum()) if len(at) else 0.0, self.ids[at[:NEAREST]].tolist()))
        return out


class ToxicityModel:
    """What the fit leaves on the driver: a broadcast of the index's arrays, the calibration's steps, a rate."""

    def __init__(self, shared, index_of: Callable[[dict], BlockMaxIndex], steps, rest: float):
        self.shared, self.index_of, self.steps, self.rest = shared, index_of, steps, rest

    @property
    def index(self) -> BlockMaxIndex:
        return self.index_of(self.shared.value)

    def score(self, texts: Iterator[str], known: dict) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
        """Scores, nearest examples and telling words. ``known`` remembers the answers of earlier texts."""
        index = self.index
        names = index.names
        votes, near, shown = [], [], []
        for some in batched(texts, ORDERED):
            keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in some]
            if len(known) >= REMEMBERED:
                known.clear()
            new = {key: t for key, t in zip(keys, some, strict=True) if key not in known}
            queries = [index.query(tokens(t)) for t in new.values()]
            for key, (terms, _), (vote, ids) in zip(new, queries, index.votes(queries), strict=True):
                told = terms[index.telling[terms]].tolist()
                known[key] = vote if len(terms) else np.nan, ids, [names[t] for t in told]
            for key in keys:
                vote, ids, terms = known[key]
                votes.append(vote)
                near.append(ids)
                shown.append(terms)
        vote = np.array(votes, float)
        out = np.full(len(vote), self.rest)
        met = ~np.isnan(vote)
        out[met] = calibrated(vote[met], self.steps)
        return out, near, shown


def built_index(given: dict) -> BlockMaxIndex:
    """The index of the arrays, built once in each Python worker and kept in their place."""
    if "index" not in given:
        index = BlockMaxIndex.of_counts(given)
        given.clear()
        given["index"] = index
    return given["index"]


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counted = [Counter(tokens(t)) for t in batch["text"]]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"], "y": batch["y"], "fold": batch["fold"],
                "words": [list(c) for c in counted], "counts": [list(c.values()) for c in counted],
            }
        )


def _numbers(given: dict) -> dict[bytes, int]:
    if "number" not in given:
        given["number"] = {w: i for i, w in enumerate(given["words"].split())}
    return given["number"]


def _document_counts(docs: DataFrame, shared, n_words: int) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = _numbers(shared.value)
        held, n = np.zeros(n_words, np.int64), 0
        counted: Counter[bytes] = Counter()

        def settle() -> None:
            for word, count in counted.items():
                if (at := number.get(word)) is not None:
                    held[at] += count
            counted.clear()

        for batch in batches:
            n += len(batch)
            for text in batch["text"]:
                counted.update(set(tokens(text)))
                if len(counted) > COUNTED:
                    settle()
        settle()
        at = np.flatnonzero(held)
        yield pd.DataFrame({"term": np.append(at, -1).astype(np.int32), "n": np.append(held[at], n)})

    parts = in_slices(docs.select(text_of().alias("text")), run, "term int, n long")
    # One row a word of the examples.
    counted = parts.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = counted["term"].to_numpy(), counted["n"].to_numpy()
    out = np.zeros(n_words, np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), out


def document_counts(docs: DataFrame, words: Iterable[bytes]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each of ``words``, over all documents."""
    words = list(words)
    shared = docs.sparkSession.sparkContext.broadcast({"words": b" ".join(words)})
    return _document_counts(docs, shared, len(words))


def examples_of(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int, scratch: Scratch) -> DataFrame:
    """doc_id, text, y, fold of the sample: one row a document, in hash order up to ``size`` bytes of text."""
    train = training_texts(docs, labels, label, remainder(3) != 1, rows)
    # A document that is repeated often is one example.
    one = train.groupBy("doc_id", "y", "fold").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    one = scratch.put(one.select("doc_id", F.col("t.text").alias("text"), "y", "fold"), "texts")
    # At most ``rows`` small rows.
    order = Window.orderBy(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("long")), "doc_id")
    sized = one.select("doc_id", F.sum(F.octet_length("text")).over(order).alias("_size"))
    return one.join(F.broadcast(sized.where(F.col("_size") <= size).select("doc_id")), "doc_id", "left_semi")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES
) -> ToxicityModel | None:
    """Model of ``label``, learned where crc32(doc_id) mod 3 is not 1; None without such rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity-fit")
    train = examples_of(docs, labels, label, rows, size, scratch)
    schema = "doc_id long, y double, fold boolean, words array<binary>, counts array<int>"
    counted = scratch.put(in_slices(train, _words, schema), "train")
    n, positive = counted.where("NOT fold").agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n:
        return None
    # Held-back examples are learned from as well, but say nothing about which words are telling.
    told, known_y = F.count_if(~F.col("fold")), F.coalesce(F.sum(F.expr("IF(fold, 0, y)")), F.lit(0.0))
    each = counted.select(F.explode("words").alias("word"), "y", "fold")
    found = each.groupBy("word").agg(F.count("*").alias("all"), told.alias("df"), known_y.alias("with"))
    # Frequent words first: what is read together lies together.
    found = found.toArrow().sort_by([("all", "descending"), ("word", "ascending")])
    d, a = found["df"].to_numpy().astype(float), found["with"].to_numpy()
    b, other = d - a, n - positive
    chi2 = n * (a * other - b * positive) ** 2 / (positive * other * d * (n - d) + 1e-9)
    # Half a document more on both sides, so a word of one class only has a lift too.
    lift = ((a + 0.5) / (positive + 1)) / ((b + 0.5) / (other + 1))
    telling = (d >= LEAST_DOCS) & (chi2 >= LEAST_CHI2) & ((lift >= LEAST_LIFT) | (lift <= 1 / LEAST_LIFT))
    words = spark.sparkContext.broadcast({"words": b" ".join(found["word"].to_pylist())})
    del found
    total, in_docs = _document_counts(docs, words, len(d))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = _numbers(words.value)
        for batch in batches:
            terms = [[number[w] for w in ws] for ws in batch["words"]]
            yield batch[["doc_id", "y", "fold", "counts"]].assign(terms=terms)

    schema = "doc_id long, y double, fold boolean, terms array<int>, counts array<int>"
    examples = in_slices(counted, sparse, schema).toArrow().sort_by("doc_id")
    terms, counts = (examples[c].combine_chunks() for c in ("terms", "counts"))
    given = {
        "words": words.value["words"], "idf": np.log((total + 1) / (in_docs + 1)) + 1, "telling": telling,
        "unknown": float(np.log((total + 1) / 2) + 1), "lengths": np.diff(terms.offsets.to_numpy()).astype(np.int64),
        "terms": terms.values.to_numpy(), "counts": counts.values.to_numpy(),
        "ids": examples["doc_id"].to_numpy(), "y": examples["y"].to_numpy(),
        "held": examples["fold"].combine_chunks().to_numpy(zero_copy_only=False),
    }
    rate, rest = float(given["y"].mean()), given["y"][given["lengths"] == 0]
    shared = spark.sparkContext.broadcast(given)
    del given, examples, terms, counts

    def held_votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = built_index(shared.value)
        for batch in batches:
            for some in batched(zip(batch["words"], batch["counts"], batch["y"], strict=True), ORDERED):
                queries = [index.query([w for w, c in zip(ws, cs, strict=True) for _ in range(c)]) for ws, cs, _ in some]
                vote = np.array([v for v, _ in index.votes(queries, without_held=True)])
                yield pd.DataFrame({"bin": bin_of(vote), "y": [y for _, _, y in some]})

    # Calibrated without the votes of held-back examples; at most a row a bin comes back.
    held = in_slices(counted.where("fold AND size(words) > 0"), held_votes, "bin long, y double")
    bins = [(r.bin, r.s, r.m) for r in held.groupBy("bin").agg(F.sum("y").alias("s"), F.count("*").alias("m")).collect()]
    steps = calibration(bins, rate) if bins else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    words.unpersist()
    scratch.drop(counted)
    return ToxicityModel(shared, built_index, steps, float((rest.sum() + rate) / (len(rest) + 1)))


def with_evidence(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id, score, neighbours (doc_ids of the nearest voters), terms of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            if model is None:
                none = [[] for _ in range(len(batch))]
                score, near, shown = np.full(len(batch), 0.5), none, none
            else:
                score, near, shown = model.score(batch["text"], known)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score, "neighbours": near, "terms": shown})

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of().alias("text"))
    return texts.mapInPandas(run, f"doc_id {kind}, score double, neighbours array<long>, terms array<string>")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours, terms of every row of ``docs``."""
    rated = with_evidence(docs, fit_toxicity(docs, labels))
    return rated.select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours", "terms",
    )
