from __future__ import annotations

from shelflink.functions.titles import with_variations
from shelflink.sources.reading_list import title_authors

CASES = [
    ("The Song of Achilles", "song of achilles", "", ["song of achilles"]),
    ("Dune (Dune Chronicles #1)", "dune", "", ["dune"]),
    ("Emma: A Novel", "emma", "a novel", ["emma", "emma a novel"]),
    (
        "Sapiens: A Brief History of Humankind",
        "sapiens",
        "a brief history of humankind",
        ["sapiens", "sapiens a brief history of humankind", "sapiens a brief history"],
    ),
    ("Biology 2nd Edition", "biology", "", ["biology"]),
    ("Biology (2nd, Revised Edition)", "biology", "", ["biology"]),
    ("X (a) Y (series 2) Z (b)", "x", "", ["x"]),
    ("Saga (Volume 3)", "saga", "", ["saga"]),
    ("Saga (Vol. 3)", "saga", "", ["saga"]),
    ("Saga (12)", "saga", "", ["saga"]),
    ("It (Book 7 of All)", "it", "", ["it"]),
    ("  The Blank", "the blank", "", ["the blank"]),
    ("A [Tale]; of, 'Two'", "tale of two", "", ["tale of two"]),
    ("Odd:  ", "odd", "", ["odd"]),
    ("Odd: ()", "odd", "()", ["odd", "odd "]),
    ("Line  break\n\tx", "line break x", "", ["line break x"]),
    ("Two (series\n one)", "two series one", "", ["two series one"]),
    ("A: B: C", "a", "b: c", ["a", "a b c"]),
    ("", "", "", [""]),
]


def test_title_rules(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, title string")
    got = with_variations(rows).orderBy("i").collect()
    for row, (title, main, subtitle, variations) in zip(got, CASES):
        assert (row.main, row.subtitle, row.variations) == (main, subtitle, variations), title


def test_title_authors_are_trimmed_like_entries(spark):
    rows = [("Dune ", " Frank Herbert ", 1), ("Emma", "", 2), ("  ", "Nobody", 3), ("Ulysses", "Joyce", 4), ("Ulysses", " ", 5)]
    shelf = spark.createDataFrame(rows, "Title string, Author string, position long")
    assert [tuple(r) for r in title_authors(shelf, "position").collect()] == [("Dune", "Frank Herbert")]
