"""Plain-Python statement of the linking rules, for small fixtures."""

from __future__ import annotations

import re


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def percent(common: int, total: int) -> int:
    return round(100 * (2 * common / total))


def ratio(a: str, b: str) -> int:
    if a == b:
        return 100
    return percent(lcs(a, b), len(a) + len(b)) if a and b else 0


def partial(a: str, b: str) -> int:
    if a == b:
        return 100
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0
    windows = (long[i : i + len(short)] for i in range(len(long)))
    best = max(2 * lcs(short, w) / (len(short) + len(w)) for w in windows)
    return 100 if best > 0.995 else round(100 * best)


def clean(text: str) -> list[str]:
    text = "".join(c for c in text if not 0x80 <= ord(c) <= 0xFF)
    return re.sub(r"\W", " ", text).lower().split()


def token_sort(a: str, b: str) -> int:
    return ratio(" ".join(sorted(clean(a))), " ".join(sorted(clean(b))))


def token_set(a: str, b: str) -> int:
    x, y = set(clean(a)), set(clean(b))
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    one, two = (f"{both} {' '.join(sorted(z))}".strip() for z in (x - y, y - x))
    return max(ratio(both, one), ratio(both, two), ratio(one, two))


def base_score(q: str, l: str, same_main: bool, author: int | None = None) -> float:
    parts = (ratio(q, l), partial(q, l), token_sort(q, l), token_set(q, l))
    long = len(q) > 50 or len(l) > 50
    weights = (0.1, 0.1, 0.2, 0.6) if long else (0.15, 0.2, 0.25, 0.4)
    score = 0.0
    for part, weight in zip(parts, weights):
        score += part * weight
    words = set(q.split())
    if len(words) <= 3 and len(words & set(l.split())) < len(words) / 2:
        score *= 0.7
    gap, total = abs(len(q) - len(l)), len(q) + len(l)
    if total > 100:
        score *= 0.95 if gap > 30 else 1
    else:
        score *= 0.9 if gap > 10 else 1
    if same_main:
        score *= 1.2
    if author is not None:
        score *= 1.2 if author / 100 > 0.8 else 0.7 if author / 100 < 0.4 else 1
    return score


def best(query, listings, pair_author=None):
    """``query`` and ``listings`` hold (main, variations, author); index of the winner, score."""
    top, winner = 0.0, None
    for q in query[1]:
        for i, (main, variations, author) in enumerate(listings):
            weigh = token_set(pair_author, author) if pair_author and author else None
            for l in variations:
                score = base_score(q, l, query[0] == main, weigh)
                if score > top:
                    top, winner = score, i
    return winner, top
