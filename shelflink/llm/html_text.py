"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text between block-level tags, each with its root-to-leaf
path of tags (and classes). Text length and punctuation are added up per path and divided by the
number of its blocks; link text counts against its path. The two ratios are smoothed over the blocks
in page order, fused into one score per path, and paths at or above a threshold relative to the
page's mean are content. The content container is the deepest element that holds all of them, or the
article or section around it; its blocks that do not belong to boilerplate elements are the article, so short
paragraphs and headings inside it stay.

Elements such as nav are boilerplate; of a header inside an article only the headings stay. A class, id or role that
says so (``DESCRIBING`` parts such as has- take it back) makes an element boilerplate too, however long its text: adverts and comments
may be longer than the article. Excepted are elements that hold an h1 and most of the page's text, that hold all its
article elements, or without which no sentence would be left.

NULL html counts as empty; a page without content has an empty text. Broken markup is read
leniently: unclosed paragraphs, list items and cells end where the next one starts, end tags without a
start are ignored, elements left open end with the page. Rows are read each on their own: repeated
rows, ties and NULL ids need no rule. An empty
table gives an empty result. Pages of any length are read whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflink.llm.common import text_of

#: A quote opens a string only after an equals sign; possessive, so a tag without end is read once.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S
)
CLASS = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is no text.
OPAQUE = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "title", "head", "select", "option", "button"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "msub", "msup", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder",
}
#: Elements that hold no article text, and parts of class names that say the same.
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
BOILERPLATE_PART = re.compile(
    r"ads?|adsense|adsbygoogle|advert\w*|banner|breadcrumbs?|ccpa|comment\w*|cookie\w*|consent|disqus\w*|footer|gdpr|header|masthead|menu|"
    r"modal|nav\w*|\w+nav|navbar|newsletter|notices?|popup|promo\w*|related|repl(?:y|ies)|respond|responses?|share|sharebar|sharing|sidebar|"
    r"social|sponsor\w*|subscribe|toolbar|widget"
)
#: Parts that make such a name describe a page or an article instead.
DESCRIBING = {"has", "with", "without", "no", "enabled", "disabled", "open", "closed", "layout", "entry", "post", "article", "story"}
#: What marks even an article element: a reader's comment.
COMMENT_PART = re.compile(r"comment\w*|repl(?:y|ies)|responses?")
PARTS = re.compile(r"[-_]+")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag of the first kind ends an open element of the second kinds.
ENDS = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
} | {t: {"p"} for t in ("div", "ul", "ol", "dl", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "footer", "nav", "header", "aside", "main", "form", "hr", "figure")}
#: Open elements that such a start tag must not reach beyond.
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "td", "th", "blockquote", "main"}
MARKS = frozenset(".,;:!?…。，；：！？")
THRESHOLD = 0.5
ARTICLE = {"article", "main"}
#: Elements that group blocks; lists, tables and quotes are parts of what surrounds them.
GROUPS = {"article", "main", "section", "div", "body", "html"}


class Page:
    """Elements and text blocks of a page in order.

    Element i: its tag, parent, path (a number for each path of tags and classes), last element inside, whether a class name
    says boilerplate. Elements stand in the order of their start tags, so i to last[i] are what it holds. Block: its element,
    text, characters inside links.
    """

    def __init__(self) -> None:
        self.tags, self.parents, self.paths, self.last, self.marked = [""], [0], [0], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._steps: dict[tuple[int, str], int] = {}

    def open(self, parent: int, tag: str, classes: str) -> int:
        at = len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        step = self.paths[parent], f"{tag}.{classes}" if classes else tag
        self.paths.append(self._steps.setdefault(step, len(self._steps) + 1))
        self.last.append(at)
        self.marked.append(bool(classes) and tag not in ("html", "body", "main") and says_boilerplate(classes, tag))
        return at

    def below(self, own: list[bool]) -> list[bool]:
        """For each element whether it or one around it is in ``own``."""
        out = [False] * len(own)
        for at, parent in enumerate(self.parents):
            out[at] = own[at] or out[parent]
        return out


def says_boilerplate(classes: str, tag: str) -> bool:
    pattern = COMMENT_PART if tag == "article" else BOILERPLATE_PART
    for name in classes.lower().split():
        parts = PARTS.split(name)
        if any(map(pattern.fullmatch, parts)) and DESCRIBING.isdisjoint(parts):
            return True
    return False


def page_of(html: str) -> Page:
    """The page, with entities decoded and white space collapsed; one pass, memory in proportion to the page."""
    page = Page()
    # Open elements: tag and number of the block element.
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = defaultdict(int)
    parts: list[str] = []
    here = linked = opaque = 0
    at, end, search = 0, len(html), TAG.search

    def flush() -> None:
        nonlocal parts, linked
        text = "".join(parts)
        text = " ".join((unescape(text) if "&" in text else text).split())
        if text:
            page.blocks.append((here, text, linked))
        parts, linked = [], 0

    def close() -> None:
        nonlocal here, opaque
        name, number = stack.pop()
        open_[name] -= 1
        opaque -= name in OPAQUE
        if name not in INLINE:
            page.last[number] = len(page.tags) - 1
            here = page.parents[number]

    while at < end:
        tag = search(html, at)
        # A "<" that opens no tag is text.
        text = html[at : tag.start() if tag else end]
        if text and not opaque:
            parts.append(text)
            if open_["a"]:
                linked += len(text)
        if not tag:
            break
        at = tag.end()
        name = tag[2]
        if not name:
            continue
        name = name.lower()
        if tag[1]:
            if name == "br" or not open_[name]:
                continue
            if parts and name not in INLINE:
                flush()
            while stack[-1][0] != name:
                if parts and stack[-1][0] not in INLINE:
                    flush()
                close()
            close()
            continue
        if name in RAW:
            found = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = found.end() if found else end
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            if name not in VOID:
                open_[name] += 1
                stack.append((name, here))
            continue
        if parts:
            flush()
        if name in VOID:
            continue
        ends = ENDS.get(name)
        if ends and any(open_[e] for e in ends):
            depth = cut = len(stack)
            while depth:
                depth -= 1
                if stack[depth][0] in ends:
                    cut = depth
                elif stack[depth][0] in SCOPES:
                    break
            while len(stack) > cut:
                close()
        attributes = tag[3]
        classes = " ".join(a or b or c for a, b, c in CLASS.findall(attributes)) if "=" in attributes else ""
        here = page.open(here, name, classes)
        stack.append((name, here))
        open_[name] += 1
        opaque += name in OPAQUE
    flush()
    while stack:
        close()
    page.last[0] = len(page.tags) - 1
    return page


def _plain(page: Page) -> list[bool]:
    """For each block whether no element around it is boilerplate, by tag or by class."""
    tags, parents = page.tags, page.parents
    articles = page.below([t in ARTICLE for t in tags])
    # The headline may stand in the article's own header.
    headers = page.below([t == "header" and articles[at] for at, t in enumerate(tags)])
    dropped = page.below([t in BOILERPLATE and not (t == "header" and articles[at]) for at, t in enumerate(tags)])
    wanted = [
        not dropped[e] and not (headers[e] and tags[e] not in HEADINGS and tags[parents[e]] not in HEADINGS) for e, _, _ in page.blocks
    ]
    if not any(page.marked):
        return wanted
    # Text, article text and first headings up to each element.
    text, inside, first = ([0] * (len(tags) + 1) for _ in range(3))
    for (e, t, _), w in zip(page.blocks, wanted, strict=True):
        text[e + 1] += len(t) if w else 0
        inside[e + 1] += len(t) if w and articles[e] else 0
        first[e + 1] += w and tags[e] == "h1"
    for sums in (text, inside, first):
        for at in range(1, len(sums)):
            sums[at] += sums[at - 1]

    def held(sums: list[int], at: int) -> int:
        return sums[page.last[at] + 1] - sums[at]

    own = [m and not (held(first, at) and 2 * held(text, at) > text[-1]) for at, m in enumerate(page.marked)]
    while True:
        below = page.below(own)
        plain = [w and not below[e] for (e, _, _), w in zip(page.blocks, wanted, strict=True)]
        left = [(e, t, linked) for (e, t, linked), p in zip(page.blocks, plain, strict=True) if p]
        outer = [at for at, m in enumerate(own) if m and not below[parents[at]]]
        if inside[-1] and not any(articles[e] for e, _, _ in left):
            # All article text lies inside such elements: these are its wrappers.
            wrappers = [at for at in outer if held(inside, at)]
        elif any(not linked and not MARKS.isdisjoint(t) for _, t, linked in left):
            return plain
        else:
            # No sentence is left outside: what holds most text is no boilerplate.
            wrappers = [at for at in outer if 2 * held(text, at) > text[-1]]
        if not wrappers:
            return plain
        for at in wrappers:
            own[at] = False


def content_blocks(page: Page) -> list[str]:
    """Texts of the article's blocks."""
    blocks = page.blocks
    if not blocks:
        return []
    paths = [page.paths[e] for e, _, _ in blocks]
    length, marks, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for path, (_, text, linked) in zip(paths, blocks, strict=True):
        length[path] += max(0, len(text) - 2 * linked)
        marks[path] += 0 if linked else sum(map(text.count, MARKS))
        count[path] += 1
    lengths = [length[p] / count[p] for p in paths]
    marked = [marks[p] / count[p] for p in paths]

    # Neighbours speak for each other: weights 1, 2, 1 over the blocks in page order.
    def smooth(values: list[float]) -> list[float]:
        before, after = [values[0], *values[:-1]], [*values[1:], values[-1]]
        return [(x + 2 * y + z) / 4 for x, y, z in zip(before, values, after, strict=True)]

    lengths, marked = smooth(lengths), smooth(marked)
    mean_length, mean_marked = sum(lengths) / len(lengths) or 1.0, sum(marked) / len(marked) or 1.0
    fused: dict[int, float] = defaultdict(float)
    for path, x, y in zip(paths, lengths, marked, strict=True):
        fused[path] += (x / mean_length + y / mean_marked) / 2 / count[path]
    plain = _plain(page)
    content = [e for p, path, (e, _, _) in zip(plain, paths, blocks, strict=True) if p and fused[path] >= THRESHOLD and length[path] > 0]
    content = content or [e for p, (e, _, _) in zip(plain, blocks, strict=True) if p]
    # The deepest element around all of it. A lone paragraph, list or table is no container: what surrounds it may hold a heading and more.
    if not content:
        return []
    around, low, high = content[0], min(content), max(content)
    while around and not (around <= low and high <= page.last[around] and page.tags[around] in GROUPS):
        around = page.parents[around]
    # The article or section around it, unless an element between them says otherwise.
    at = around
    while at and page.tags[at] not in ARTICLE:
        at = page.parents[at]
    around = at or around
    inside = [at for at, (p, (e, _, _)) in enumerate(zip(plain, blocks, strict=True)) if p and around <= e <= page.last[around]]
    # A headline may stand right before the element that holds the article.
    before = inside[0] - 1
    if before >= 0 and plain[before] and page.tags[blocks[before][0]] == "h1" and all(page.tags[blocks[at][0]] != "h1" for at in inside):
        inside.insert(0, before)
    return [blocks[at][1] for at in inside]


def main_text(html: str) -> str:
    return "\n".join(content_blocks(page_of(html)))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text)

    text = extracted.asNondeterministic()(text_of("html"))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
