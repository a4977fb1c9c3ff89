"""Plain-Python statements of what the queries compute, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
LICENSES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def lower(text: str) -> str:
    """A-Z only."""
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def rules(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words),
    }


def secrets(text: str | None) -> dict:
    text = text or ""
    spans = {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16],
    }
    order = sorted((s, k, e) for k, kind in enumerate(spans) for s, e in spans[kind])
    listed = ",".join(f"{list(spans)[k]}:{s}:{e}" for s, k, e in order)
    return {f"n_{k}": len(v) for k, v in spans.items()} | {
        "base_sha256": hashlib.sha256(listed.encode()).hexdigest()
    }


def licenses(text: str | None) -> dict:
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))
    found = []
    for phrase, label in LICENSES.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    starts = [i for i, _ in found]
    return {
        "n_words": len(words),
        "n_base": len(found),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({label for _, label in found})),
    }


def shingles(text: str | None, k: int) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near(rows: list[tuple[int, str | None]], k: int, percent: int = 80) -> dict[int, int]:
    """Component of each doc_id, comparing all with all."""
    sets = {d: shingles(t, k) for d, t in rows}
    ids = sorted(sets)
    links = defaultdict(set)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links[a].add(b), links[b].add(a)
    component = {}
    for d in ids:
        if d not in component:
            stack = [d]
            while stack:
                n = stack.pop()
                if n not in component:
                    component[n] = d
                    stack.extend(links[n])
    return component
