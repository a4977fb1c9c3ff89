"""Content outside the largest element stays, and class names do not empty a page."""

from __future__ import annotations

import pytest

from shelflink.llm.html_text import main_text

T = "A longer paragraph, with commas, and a full stop. It says one thing, then another; and ends."
P = f"<p>{T}</p>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><h1>T</h1><p>intro, short.</p><ul>{f'<li>{T}</li>' * 5}</ul><p>end.</p></article>", "\n".join(["T", "intro, short.", *[T] * 5, "end."])),
        (f"<div><h1>Title</h1><section>{P * 7}</section><section>{P * 3}</section></div>", "\n".join(["Title", *[T] * 10])),
        (f"<div><p>Before, it.</p><blockquote>{P * 5}</blockquote>{P}</div>", "\n".join(["Before, it.", *[T] * 6])),
        (f"<div>{P}<table><tr><td>{P * 5}</td></tr></table>{P}</div>", "\n".join([T] * 7)),
    ],
)
def test_content_outside_the_largest_element(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("open_, close", [("<div class='layout has-sidebar'>", "</div>"), ("<div id='page-with-menu'>", "</div>"), ("<article class='post share-enabled'>", "</article>")])
@pytest.mark.parametrize("inner", ["", "<main>"])
def test_wrappers_with_such_class_names(open_, close, inner):
    page = f"<body>{open_}{inner}<h1>Title</h1>{P * 3}{'</main>' if inner else ''}<div class='sidebar'>{P}</div>{close}</body>"
    assert main_text(page) == "\n".join(["Title", T, T, T])
