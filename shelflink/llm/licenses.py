"""License scan with a positional index of rare licence words.

Templates are short licence statements. The index maps each of their words to its postings: template
and position. IDF counts the documents that hold a word, over all documents. For each file the
licence words are looked up with the highest IDF first; a posting and a place in the file give the
place where the template would start, and postings of different words that agree on it are
intersected. An alignment that enough of the template's rare words share is verified: the
template's mandatory key phrases have to stand at the place where the alignment puts them, and
the share of the template's words that stand in place is its score.

Short forms (Creative Commons names and abbreviations behind words such as "licensed under" or before a
version, SPDX identifiers behind their tag) have too few words to vote and are found by their words
standing consecutively; the longest name counts. Besides, three base phrases are found at every place where their words stand
consecutively. Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.

NULL text counts as empty and has no words. Rows are scanned each on their own: repeated rows, ties and
NULL ids need no rule; equal alignments go to the template named first and the earlier place. An
empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflink.llm.common import text_of
from shelflink.llm.toxicity import tokens

#: Words that stand consecutively, and their label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, statement and mandatory key phrases of each template.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("permission is hereby granted", "deal in the software without restriction"),
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("except in compliance with the license",),
    ),
    (
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        ("general public license version 3",),
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ("terms of the gnu general public license",),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("source and binary forms", "following conditions are met"),
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license v 2 0",),
    ),
    (
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution",),
    ),
)
#: Label and words of short forms: names after "licensed under" or alike, and SPDX identifiers.
LEADS = ("licensed under", "licensed under the", "licensed under a", "released under", "released under the", "available under", "available under the", "distributed under", "distributed under the", "license")
CREATIVE_COMMONS = {
    "cc-by": ("cc by", "creative commons attribution"),
    "cc-by-sa": ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"),
    "cc-by-nc": ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"),
    "cc-by-nd": ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs", "creative commons attribution no derivatives"),
    "cc-by-nc-sa": ("cc by nc sa", "creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"),
    "cc-by-nc-nd": ("cc by nc nd", "creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs", "creative commons attribution non commercial no derivatives"),
    "cc0": ("cc0", "creative commons zero"),
}
SPDX = {
    "mit": ("mit",), "apache-2.0": ("apache 2 0",), "mpl-2.0": ("mpl 2 0",), "isc": ("isc",),
    "gpl-2.0": ("gpl 2 0",), "gpl-3.0": ("gpl 3 0",), "lgpl-2.1": ("lgpl 2 1",), "lgpl-3.0": ("lgpl 3 0",), "agpl-3.0": ("agpl 3 0",),
    "bsd": ("bsd 2 clause", "bsd 3 clause"), "unlicense": ("unlicense",),
} | {label: names[:1] for label, names in CREATIVE_COMMONS.items()}


def _short_forms() -> dict[bytes, list[tuple[str, list[bytes], list[list[bytes]]]]]:
    """By first word of the name: label, words of the name, words that may stand before it (none: no lead needed)."""
    forms: dict[bytes, list[tuple[str, list[bytes], list[list[bytes]]]]] = defaultdict(list)
    leads = [lead.encode().split() for lead in LEADS]
    for label, names in CREATIVE_COMMONS.items():
        for name in names:
            words = name.encode().split()
            forms[words[0]].append((label, words, leads))
    for label, names in SPDX.items():
        for name in names:
            words = name.encode().split()
            forms[words[0]].append((label, words, [b"spdx license identifier".split()]))
    return forms


def _short_places(words: list[bytes], forms: dict) -> list[tuple[str, int]]:
    """(label, place of the name) of every short form; where several fit, the longest name.

    A name counts after one of its leads, or with a version (1.0 to 4.0) behind it: "cc by" alone may be anything.
    """
    found = []
    for first in forms:
        at = -1
        while True:
            try:
                at = words.index(first, at + 1)
            except ValueError:
                break
            best: tuple[int, str] = (0, "")
            for label, name, leads in forms[first]:
                end = at + len(name)
                if len(name) <= best[0] or words[at:end] != name:
                    continue
                versioned = (
                    label.startswith("cc") and words[end : end + 1] in ([b"1"], [b"2"], [b"3"], [b"4"]) and words[end + 1 : end + 2] in ([b"0"], [b"5"])
                )
                if versioned or any(at >= len(lead) and words[at - len(lead) : at] == lead for lead in leads):
                    best = len(name), label
            if best[0]:
                found.append((best[1], at))
    return sorted(found, key=lambda x: x[1])

#: Words of highest IDF that vote for a template (ties as well), and the least that have to agree on a place.
RARE, AGREE = 4, 2
LEAST_SCORE = 0.6


@dataclass
class TemplateIndex:
    """Postings of the words of all templates, and the base phrases."""

    words: list[list[bytes]] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    keys: list[list[tuple[int, list[bytes]]]] = field(default_factory=list)
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))

    @classmethod
    def of(cls, templates=TEMPLATES) -> TemplateIndex:
        index = cls()
        for t, (label, statement, phrases) in enumerate(templates):
            words = statement.encode().split()
            index.words.append(words)
            index.labels.append(label)
            keys = []
            for phrase in phrases:
                p = phrase.encode().split()
                keys.append((next(i for i in range(len(words)) if words[i : i + len(p)] == p), p))
            index.keys.append(keys)
            for i, w in enumerate(words):
                index.postings[w].append((t, i))
        return index


def word_counts(docs: DataFrame, index: TemplateIndex) -> dict[bytes, int]:
    """Documents that hold each template word, over all documents; at most one row a template word."""
    vocabulary = frozenset(index.postings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for text in batch["text"]:
                for w in vocabulary.intersection(tokens(text)):
                    total[w] += 1
        yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    counted = docs.select(text_of().alias("text")).mapInPandas(run, "word binary, n long")
    rows = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def voting_words(index: TemplateIndex, idf: dict[bytes, float]) -> list[frozenset[bytes]]:
    """Per template its words of highest IDF; common words would vote for every place."""
    voters = []
    for words in index.words:
        ranked = sorted((idf[w] for w in set(words)), reverse=True)
        least = ranked[min(RARE, len(ranked)) - 1]
        voters.append(frozenset(w for w in words if idf[w] >= least))
    return voters


def aligned(words: list[bytes], index: TemplateIndex, voters: list[frozenset[bytes]]) -> list[tuple[int, int, float]]:
    """(template, place of its first word, score) of every verified alignment in a file's words."""
    places = defaultdict(list)
    for i, w in enumerate(words):
        if w in index.postings:
            places[w].append(i)
    votes: dict[tuple[int, int], int] = defaultdict(int)
    for w in places:
        for t, at in index.postings[w]:
            if w in voters[t]:
                for i in places[w]:
                    votes[t, i - at] += 1
    found = []
    for (t, start), n in sorted(votes.items()):
        if n < AGREE or not all(words[max(0, start + k) : start + k + len(p)] == p for k, p in index.keys[t]):
            continue
        template = index.words[t]
        in_place = sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(template))
        if in_place >= LEAST_SCORE * len(template):
            found.append((t, start, in_place / len(template)))
    return found


def _base_places(words: list[bytes]) -> list[tuple[int, str]]:
    phrases = [(p.encode().split(), label) for p, label in BASE.items()]
    found = []
    at = -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return found
        for p, label in phrases:
            start = at - len(p) + 1
            if start >= 0 and words[start : at + 1] == p:
                found.append((start, label))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches of every row.

    ``matches`` lists label and first word of the aligned templates, then of the short forms.
    """
    index = TemplateIndex.of()
    rows = max(1, docs.count())
    counts = word_counts(docs, index)
    idf = {w: float(np.log((rows + 1) / (counts.get(w, 0) + 1))) for w in index.postings}
    voters = voting_words(index, idf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A file without any rare word needs no alignment.
        rare = frozenset().union(*voters)
        forms = _short_forms()
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = tokens(text)
                base = _base_places(words)
                hits = aligned(words, index, voters) if not rare.isdisjoint(words) else []
                short = _short_places(words, forms)
                starts = [s for s, _ in base]
                base_labels = {label for _, label in base}
                score = 1.0 if short else max([h[2] for h in hits], default=0.5 if base else 0.0)
                out.append(
                    (
                        len(words), len(base), min(starts, default=None), max(starts, default=None),
                        ",".join(sorted(base_labels)),
                        ",".join(sorted(base_labels | {index.labels[t] for t, _, _ in hits} | {label for label, _ in short})),
                        score, [f"{index.labels[t]}:{s}" for t, s, _ in hits] + [f"{label}:{s}" for label, s in short],
                    )
                )
            columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
            frame = pd.DataFrame(out, columns=columns)
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, matches array<string>"
    )
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, schema)
