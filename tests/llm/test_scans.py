"""Rules, secrets and licences against plain Python, with awkward texts."""

from __future__ import annotations

import base64
import hashlib

import corpus_brute as brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelflink.llm.licenses import TEMPLATES, license_scan
from shelflink.llm.quality_rules import RULES, accepted, judged
from shelflink.llm.secrets import fit_ratio, known_secrets, random_runs, secret_digests

SOME = hashlib.sha256(b"x").hexdigest()
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from the farm"
TEXTS = [
    None, "", " ", "\n\n", "a", PROSE, PROSE + "\n" + PROSE, f"{PROSE} {PROSE}\x1f{PROSE}\x0b\x0c\r",
    "x y z x y z x y z x y z", "# * $ % & | < > ##", "\n".join(["same line"] * 9 + [" ", "", "other"]),
    f'token = "{SOME}"', f"TOKEN:{SOME} 😀 api_key='abcdefghijkl' é", "password=short", "password=password=abc: tokens secret: abcdefghijkl",
    "token=secret: abcdefghijklmn", "AKIA" + "A1" * 7 + " AKIAAKIA AKIA" + "B" * 30, "apikey=AKIA" + "Z" * 20, SOME * 3,
    "paſſword=abcdefghijkl toKen=abcdefghijklmnop", "MIT License. mit-license MITlicense mit  license\nlicense",
    "GNU General Public License general public license", "Apache-License; apache.license apache licenses éapache license",
    "license mit", " ".join(f"key{i}={SOME[:20]}" for i in range(300)), "w " * 30_000 + "mit license", "İ mit license",
]


def _check(got, want_of, texts):
    assert len(got) == len(texts)
    for r in got:
        want = want_of(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, texts[r.doc_id]


@pytest.mark.parametrize(("scan", "want_of"), [(judged, brute.rules), (secret_digests, brute.secrets), (license_scan, brute.licenses)])
def test_base_columns(docs_of, scan, want_of):
    rows = list(enumerate(TEXTS))
    _check(scan(docs_of(rows)).collect(), want_of, TEXTS)
    assert scan(docs_of([])).count() == 0
    clashing = docs_of([*rows, (None, "x")]).withColumns(
        {c: F.lit(1) for c in ("_text", "n_words", "assign", "kept", "score", "_words")}
    )
    assert scan(clashing).count() == len(rows) + 1


def test_base_columns_of_generated_texts(docs_of):
    pieces = st.sampled_from(
        ["token", "secret", "=", ":", " ", '"', "'", "\n", "AKIA", "ABCDEFGH12", "0123456789abcdef", "mit", "license", "é", "😀", "a b a b a b", "\t"]
    )
    texts: list[str] = []

    @settings(max_examples=150, database=None, derandomize=True)
    @given(st.lists(pieces, max_size=25).map("".join))
    def collect(text):
        texts.append(text)

    collect()
    docs = docs_of(list(enumerate(texts)))
    _check(judged(docs).collect(), brute.rules, texts)
    _check(secret_digests(docs).collect(), brute.secrets, texts)
    _check(license_scan(docs).collect(), brute.licenses, texts)


def test_verdict_does_not_depend_on_the_order_of_rules(docs_of):
    docs = docs_of([*enumerate(TEXTS), (100, PROSE.upper()), (101, PROSE.replace(" ", "!! ")), (102, PROSE.replace(" ", " | "))])
    kept = sorted(r.doc_id for r in judged(docs).where("kept").collect())
    assert sorted(r.doc_id for r in judged(docs, RULES[::-1]).where("kept").collect()) == kept
    assert sorted(r.doc_id for r in accepted(docs).collect()) == kept
    assert accepted(docs).columns == docs.columns
    assert 5 in kept and not {0, 1, 100, 101, 102} & set(kept)


def test_random_strings_are_told_from_identifiers(docs_of):
    def random(i):
        return base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode()[: 24 + i % 16]

    ordinary = ["get_user_session_by_account_id_v2", "internationalization2024update", "/usr/local/share/applications/index", "a" * 40, "release-notes-2023-10-appendix"]
    words = "wonderful yesterday configuration international get_account_name user-session-id applications update_table release-notes"
    rows = [(i, f"{words} {random(i)} end") for i in range(40)] + [(100 + i, f"{words} {x} end") for i, x in enumerate(ordinary)]
    docs = docs_of(rows)
    ratio = fit_ratio(docs)
    found = {r.doc_id: [x.text for x in r.random] for r in random_runs(known_secrets(docs), ratio).collect()}
    hits = sum(found[i] == [random(i)] for i in range(40))
    assert hits >= 38
    assert all(found[100 + i] == [] for i in range(len(ordinary)))
    # Places are code points, and runs inside a pattern span are left to it.
    docs = docs_of([(1, f"é😀 {random(1)}"), (2, f"token={random(2).replace('+', 'x')}")])
    spans = {r.doc_id: (r.assign, r.random) for r in random_runs(known_secrets(docs), ratio).collect()}
    assert [(x.start, x.end) for x in spans[1][1]] == [(3, 3 + len(random(1)))]
    assert len(spans[2][0]) == 1 and not spans[2][1]


def test_random_keys_of_many_kinds_and_what_lies_beside_patterns(docs_of):
    def key(alphabet, n, i):
        number, out = int(hashlib.sha512(f"{alphabet}{i}".encode()).hexdigest(), 16), ""
        for _ in range(n):
            number, digit = divmod(number, len(alphabet))
            out += alphabet[digit]
        return out

    lower = "abcdefghijklmnopqrstuvwxyz"
    kinds = [(lower + lower.upper() + "0123456789", 16), (lower, 32), (lower + "0123456789", 24), (lower.upper() + "0123456789", 24)]
    words = "the wonderful configuration of international applications is a user guide to release notes and session updates by unbelievably long elements with names and tags to get"
    ordinary = [
        "getElementsByTagName", "release_notes_2024", "/usr/share/applications", "2023-10-12", "================", "configuration",
        "userSessionGuide", "INTERNATIONAL_RELEASE", "session-updates-2023", "unbelievably-long-words",
    ]
    rows = [(1000 * k + i, f"{words} {key(a, n, i)} end") for k, (a, n) in enumerate(kinds) for i in range(20)]
    rows += [(10_000 + i, f"{words} {x} end") for i, x in enumerate(ordinary)]
    docs = docs_of(rows)
    ratio = fit_ratio(docs)
    assert fit_ratio(docs.repartition(7)) == ratio
    few = [fit_ratio(d, rows=10) for d in (docs, docs.repartition(5).union(docs))]
    assert len(few[0]) == len(ratio)
    found = {r.doc_id: [x.text for x in r.random] for r in random_runs(known_secrets(docs), ratio).collect()}
    for k, (a, n) in enumerate(kinds):
        assert sum(key(a, n, i) in found[1000 * k + i] for i in range(20)) >= 18, a
    assert [x for i in range(len(ordinary)) for x in found[10_000 + i]] == []
    # A hex span inside a run: both sides are judged by themselves.
    left, right = key(kinds[0][0], 20, "l") + "Z", "Z" + key(kinds[0][0], 20, "r")
    docs = docs_of([(1, f"{left}{'0123456789abcdef' * 2}{right}")])
    (row,) = random_runs(known_secrets(docs), ratio).collect()
    assert [x.text for x in row.random] == [left, right] and [(x.start, x.end) for x in row.random] == [(0, 21), (53, 74)]


def test_license_templates(docs_of):
    rows = [(i, f"{PROSE}\n{t[1].capitalize()}.\n{PROSE}") for i, t in enumerate(TEMPLATES)]
    broken = TEMPLATES[6][1].replace("met", "ignored")
    rows += [(100, broken), (101, PROSE), (102, "this is a license to use the software for any person"), (103, "BSD")]
    got = {r.doc_id: r for r in license_scan(docs_of(rows)).collect()}
    for i, t in enumerate(TEMPLATES):
        assert t[0] in got[i].labels.split(",") and got[i].score == 1.0
        assert f"{t[0]}:{len(PROSE.split())}" in got[i].matches
    assert all(got[i].labels == "" and got[i].score == 0.0 for i in (100, 101, 102, 103))
