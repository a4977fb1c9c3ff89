"""SentencePiece encoding and decoding with a public vocabulary.

An Aho-Corasick automaton over the pieces reads a text once; at each position its output links give
all pieces that end there, and each relaxes the best score of a segmentation up to that position.
The best path back gives the ids. Characters that no piece holds become their UTF-8 byte pieces.

The vocabulary given with this job is a byte-pair one: its stored scores are merge ranks, whose sums
prefer many short pieces. ``scores="zipf"`` (the default) takes the log-probability of the rank
under Zipf's law instead; ``scores="stored"`` keeps the stored ones. Neither repeats the library's
merge order: the result is the segmentation of the highest total score, which the library can decode.

As in the library, a text gets one leading blank and blanks are written as U+2581; nothing is
normalised away. A U+2581 of the text itself is written in byte pieces, so every text comes back
exactly. Pieces never run over a blank that follows another character; so a text is cut there, and the
answer for each short stretch is remembered while a task lasts.

NULL text counts as empty; an empty text has no ids. Rows are encoded each on their own, so repeated
rows, ties and NULL ids need no rule. Equal scores: the shorter last piece wins. An empty table
gives an empty result. Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelflink.llm.common import text_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Stretches that a task remembers before it starts anew, and the longest that it remembers.
REMEMBERED, LONGEST = 250_000, 64
#: Rows whose ids are held at a time.
SLICE = 256
#: One character without a piece: length, score (counted apart), no id.
UNKNOWN = (1, 0.0, -1)
STRETCH = re.compile(f"{BLANK}*[^{BLANK}]*")


@dataclass
class Pieces:
    """Pieces by id: text, score, and the byte that a byte piece stands for (-1: none)."""

    text: list[str]
    score: list[float]
    byte: list[int]
    usable: list[bool]
    unknown: float


def load_pieces(path: str = VOCABULARY, scores: str = "zipf") -> Pieces:
    """Read a vocabulary on the driver: some hundred kilobytes that travel with the tasks."""
    model = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
    n = model.get_piece_size()
    text = [model.id_to_piece(i) for i in range(n)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
    byte = [int(text[i][3:5], 16) if model.is_byte(i) else -1 for i in range(n)]
    usable = [not special[i] and byte[i] < 0 for i in range(n)]
    stored = [model.get_score(i) for i in range(n)]
    if scores == "stored":
        score = stored
    else:
        order = sorted((i for i in range(n) if usable[i]), key=lambda i: (-stored[i], i))
        whole = math.log(sum(1 / (r + 1) for r in range(len(order))))
        score = list(stored)
        for r, i in enumerate(order):
            score[i] = -math.log(r + 1) - whole
    return Pieces(text, score, byte, usable, min(s for s, u in zip(score, usable, strict=True) if u) - 10)


class Encoder:
    """The automaton and what it remembers; made once per task."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.bytes = {b: i for i, b in enumerate(pieces.byte) if b >= 0}
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(pieces.text):
            if pieces.usable[i]:
                self.automaton.add_word(piece, (len(piece), pieces.score[i], i))
        self.automaton.make_automaton()
        inner = any(BLANK in p.lstrip(BLANK) for p, u in zip(pieces.text, pieces.usable, strict=True) if u)
        self.cut = (lambda s: [s]) if inner else STRETCH.findall
        self.single = frozenset(p for p, u in zip(pieces.text, pieces.usable, strict=True) if u and len(p) == 1)
        self.known: dict[str, list[int]] = {}

    def segment(self, stretch: str) -> list[int]:
        """Ids of the best segmentation of an escaped text."""
        n = len(stretch)
        best, back = [0.0] * (n + 1), [UNKNOWN] * (n + 1)
        done, strange = 0, not self.single.issuperset(stretch)
        # Matches come by end; of one end the longest first, so an equal score later is a shorter piece.
        for last, piece in self.automaton.iter(stretch):
            end = last + 1
            if strange and end - done > 1:
                self._unknown(stretch, best, back, done, end - 1)
            total = best[end - piece[0]] + piece[1]
            if end > done:
                best[end], back[end], done = total, piece, end
                if strange and stretch[last] not in self.single and best[last] + self.pieces.unknown > total:
                    best[end], back[end] = best[last] + self.pieces.unknown, UNKNOWN
            elif total >= best[end]:
                best[end], back[end] = total, piece
        if done < n:
            self._unknown(stretch, best, back, done, n)
        ids, end = [], n
        while end:
            length, _, i = back[end]
            if i >= 0:
                ids.append(i)
            else:
                raw = stretch[end - 1].encode("utf-8", "surrogatepass")
                ids.extend(self.bytes.get(b, 0) for b in reversed(raw))
            end -= length
        return ids[::-1]

    def _unknown(self, stretch: str, best: list, back: list, start: int, end: int) -> None:
        """No piece ends at the positions after ``start`` up to ``end``."""
        for at in range(start + 1, end + 1):
            best[at], back[at] = best[at - 1] + self.pieces.unknown, UNKNOWN

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        known = self.known
        for nth, part in enumerate(text.split(BLANK)):
            if nth:
                ids.extend(self.bytes.get(b, 0) for b in BLANK.encode())
            escaped = (" " + part if nth == 0 else part).replace(" ", BLANK)
            for stretch in self.cut(escaped):
                found = known.get(stretch)
                if found is None:
                    found = self.segment(stretch) if stretch else []
                    if len(stretch) <= LONGEST:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[stretch] = found
                ids.extend(found)
        return ids


class Decoder:
    def __init__(self, pieces: Pieces):
        self.raw = [
            bytes([b]) if b >= 0 else p.replace(BLANK, " ").encode() if u else b""
            for p, b, u in zip(pieces.text, pieces.byte, pieces.usable, strict=True)
        ]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        # The blank that encoding put in front.
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def _with_tokens(docs: DataFrame, path: str, scores: str, check: bool) -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens``; ``check`` adds ``decoded``. A few hundred rows at a time."""
    pieces = load_pieces(path, scores)
    names = ["ids", "n_tokens"] + ["decoded"] * check
    rows = docs.drop(*names)
    schema = StructType([*rows.schema, *StructType.fromDDL("ids array<int>, n_tokens long").fields])
    if check:
        schema = schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(pieces), Decoder(pieces)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                ids, ends, back = array("i"), [0], []
                for text in part.column("text"):
                    found = encoder.encode(text.as_py() or "")
                    ids.extend(found)
                    ends.append(len(ids))
                    if check:
                        back.append(decoder.decode(found))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
                added = [lists, pa.array(np.diff(ends), pa.int64())] + [pa.array(back, pa.string())] * check
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, *names])

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str = VOCABULARY, scores: str = "zipf") -> DataFrame:
    """``docs`` with columns ``ids`` (array of int) and ``n_tokens``, in place of any of these names."""
    return _with_tokens(docs, path, scores, check=False)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of ``ids``; NULL ids give an empty text."""
    pieces = load_pieces(path)
    rows = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(pieces)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = [decoder.decode(ids.as_py() or []) for ids in part.column("ids")]
                columns = [*part.columns, pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema]).add("decoded", "string"))


def encoded_and_checked(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256, round_trip of every row."""
    back = _with_tokens(docs.select("doc_id", text_of().alias("text")), path, "zipf", check=True)
    return back.select(
        "doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
