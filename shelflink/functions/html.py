"""Reading single facts out of HTML fragments with built-in text functions.

Not a general parser: it knows tags, quoted and unquoted attributes, comments, scripts and the
entities below, which is what listing pages need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelflink.functions.text import strip

# Named entities; &amp; is resolved last.
ENTITIES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "copy": "©",
    "reg": "®",
    "ndash": "–",
    "mdash": "—",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "hellip": "…",
    "agrave": "à",
    "ccedil": "ç",
    "egrave": "è",
    "eacute": "é",
    "ouml": "ö",
    "uuml": "ü",
}
VOID = ("area", "br", "col", "hr", "img", "input", "link", "meta", "source", "wbr")
AMPERSAND = "&(?:amp|#0*38|#[xX]0*26);"
NUMERIC = "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
#: A quote opens a string only where a value starts.
ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+"""
VALUE = r"""("[^"]*+"|'[^']*+'|[^\s>]++)"""


def _code_point(entity: Column) -> Column:
    body = F.substring(entity, 3, F.length(entity) - 3)
    is_hex = F.lower(F.left(body, F.lit(1))) == "x"
    number = F.when(is_hex, F.conv(F.substring(body, 2, 6), 16, 10)).otherwise(body).cast("long")
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    text = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(valid, text).otherwise(F.lit("�"))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unescape(text: Column) -> Column:
    """Resolve entities once (``&amp;lt;`` becomes ``&lt;``)."""

    def resolve(t: Column) -> Column:
        out = t
        for name, char in ENTITIES.items():
            out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
        found = F.array_except(
            F.regexp_extract_all(t, F.lit(NUMERIC), F.lit(0)),
            F.regexp_extract_all(t, F.lit(AMPERSAND), F.lit(0)),
        )
        out = F.aggregate(found, out, lambda done, e: F.replace(done, e, _code_point(e)))
        return F.when(F.contains(t, F.lit("&")), F.regexp_replace(out, AMPERSAND, "&")).otherwise(t)

    return bind(text, resolve)


def without_hidden(html: Column) -> Column:
    """Drop comments, scripts and styles, whose content is not markup."""
    return F.regexp_replace(
        html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", ""
    )


def elements(html: Column, tag: str) -> Column:
    """Fragments from every ``<tag ...>`` to the next end or start of that tag, in order.

    An element left open ends where the next one starts.
    """
    pattern = rf"(?is)<{tag}\b{ATTRIBUTES}>(?:(?!<{tag}\b).)*?(?:</{tag}\s*>|(?=<{tag}\b))"
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def tags_with(html: Column, tag: str, attribute: str) -> Column:
    """All opening tags that carry the attribute."""
    return F.filter(
        F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b{ATTRIBUTES}>"), F.lit(0)),
        lambda t: has_attribute(t, attribute),
    )


def _before(name: str) -> str:
    """Pattern of a tag's start up to its first attribute ``name``, whole attributes at a time."""
    other = rf"(?!{name}[\s=/>])[^\s=/>]++(?:\s*+=\s*+{VALUE.replace('(', '(?:', 1)})?+"
    return rf"(?is)^<[\w:-]++(?:[\s/]++{other})*+[\s/]++{name}"


def has_attribute(tag: Column, attribute: str) -> Column:
    return tag.rlike(rf"{_before(attribute)}[\s=/>]")


def attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute ``name`` of an opening tag, entities resolved; NULL when absent."""
    quoted = F.regexp_extract(tag, rf"{_before(name)}\s*+=\s*+{VALUE}", 1)
    bare = F.when(quoted.rlike("^[\"']"), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(quoted)
    return F.when(has_attribute(tag, name), unescape(bare))


def opening_tag(fragment: Column) -> Column:
    return F.regexp_extract(fragment, rf"(?is)^<\w+{ATTRIBUTES}>", 0)


def text_of(fragment: Column) -> Column:
    """Text of a fragment with its white space."""
    return unescape(F.regexp_replace(fragment, rf"(?s)</?\w{ATTRIBUTES}>", ""))


def tight_text_of(fragment: Column) -> Column:
    """Text of a fragment, every piece between tags trimmed."""
    pieces = F.transform(F.split(fragment, rf"(?s)</?\w{ATTRIBUTES}>"), lambda p: strip(unescape(p)))
    return F.array_join(pieces, "")


def with_class(part: str) -> str:
    """Pattern of an opening tag whose class contains ``part``; group 1 is the tag name."""
    value = rf"""(?:"[^"]*{part}[^"]*"|'[^']*{part}[^']*'|[^\s"'>]*{part}[^\s"'>]*)"""
    return rf"<([a-zA-Z][\w-]*)(?=[^>]*\sclass\s*=\s*{value}){ATTRIBUTES}>"


def inner_of(fragment: Column, opened: Column, name: Column) -> Column:
    """What the element that starts with the tag ``opened`` holds; NULL when ``opened`` is ''.

    The end tag is found by counting nested elements of the same ``name``.
    """
    rest = F.substring(fragment, F.instr(fragment, opened) + F.length(opened), F.length(fragment))
    pieces = F.split(rest, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"\b)")))

    def step(seen: Column, piece: Column) -> Column:
        head = F.lower(F.left(piece, F.lit(2) + F.length(name)))
        turn = F.when(head == F.concat(F.lit("</"), name), -1).when(
            F.startswith(head, F.concat(F.lit("<"), name)), 1
        )
        depth = F.when(seen.depth > 0, seen.depth + F.coalesce(turn, F.lit(0))).otherwise(0)
        return bind(
            depth,
            lambda d: F.struct(
                d.alias("depth"),
                F.concat(seen.inner, F.when(d > 0, piece).otherwise(F.lit(""))).alias("inner"),
            ),
        )

    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("inner"))
    inner = F.aggregate(pieces, start, step).inner
    return F.when(name.isin(*VOID), F.lit("")).when(opened != "", inner)
