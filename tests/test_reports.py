from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shelflink.plans import report
from shelflink.sources.reading_list import entries_of_shelf, read_reading_list, title_authors

SCHEMA = (
    "position long, query string, match string, score int, score_pct string, price string, "
    "url string, cover_url string, match_type string"
)
ROWS = [
    (5, "Five", "Five by A", 84, "84%", None, None, None, "fuzzy"),
    (0, 'Zero | "q"', "Zero by B", 100, "100%", "$1.00", "http://z", "http://c", "fuzzy"),
    (3, "Three", "Three", 95, "95%", "$2", "http://t", None, "fuzzy_author_exact"),
    (4, "Four", "Four", 95, "95%", "", "http://f", None, "fuzzy"),
    (2, "Two", "Two by, C", 100, "100%", None, None, None, "isbn_exact"),
    (1, "One", "One", 90, "90%", None, None, None, "fuzzy_isbn_author"),
    (6, "Six", "Six", 85, "85%", None, None, None, "fuzzy"),
    (7, "Seven", "Seven", 94, "94%", None, None, None, "fuzzy_author_exact"),
]


@pytest.fixture
def matches(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def entries(spark):
    return spark.range(20).withColumnRenamed("id", "position")


def test_summary_tables(matches, entries):
    row = report.summary(entries, matches).first()
    assert (row.total_searched, row.total_matches, row.match_rate, row.rate_band) == (20, 8, 40.0, "fair")
    empty = report.summary(entries.where("false"), matches.where("false")).first()
    assert tuple(empty) == (0, 0, 0.0, "poor")
    assert dict(map(tuple, report.certainty_counts(matches).collect())) == {"certain": 3, "potential": 5}
    assert dict(map(tuple, report.tier_counts(matches).collect())) == {
        ">=95": 4, ">=90": 2, ">=85": 1, "below": 1,
    }
    about = report.metadata(entries, matches, 88).first()
    assert about.threshold == 88 and about.generated_at is not None
    assert [r.query for r in report.ordered(matches).collect()][:3] == ['Zero | "q"', "One", "Two"]
    found = report.review(matches, "E", 90, "score", descending=True).collect()
    assert [r.position for r in found] == [0, 3, 7, 1]
    assert report.unmatched(entries, matches).count() == 12


def lines(path):
    return [l for p in sorted(path.glob("part-*")) for l in p.read_text().splitlines()]


def test_text_csv_markdown(matches, entries, tmp_path):
    for kind in ("text", "csv", "markdown"):
        report.write_matches(matches, entries, str(tmp_path / kind), kind, 90, "Mine", "Shop")
    text = lines(tmp_path / "text")
    assert text[0] == 'Shop: Zero by B, Mine: Zero | "q", Match Score: 100%' and len(text) == 8
    csv = lines(tmp_path / "csv")
    assert csv[0] == "Mine Title,Shop Match,Score,Price,URL"
    assert csv[1] == '"Zero | ""q""",Zero by B,100%,$1.00,http://z'
    markdown = lines(tmp_path / "markdown")
    assert markdown[0] == "# Shop Matches"
    assert markdown[2] == "Found **8** matches out of **20** books (threshold: 90%)."
    assert markdown[4] == "| Mine Title | Shop Match | Score | Price | Link |"
    assert markdown[6] == '| Zero \\| "q" | Zero by B | 100% | $1.00 | [View](http://z) |'
    assert markdown[7] == "| One | One | 90% |  |  |"


def test_empty_reports(matches, entries, tmp_path):
    none = matches.where("false")
    for kind in ("text", "csv", "markdown", "json"):
        report.write_matches(none, entries, str(tmp_path / kind), kind)
    assert lines(tmp_path / "text") == ["No matches found."]
    assert lines(tmp_path / "csv")[0] == "Wanted Title,Listing Match,Score"
    assert lines(tmp_path / "csv")[1].startswith("No matches found,")
    assert lines(tmp_path / "markdown")[-1] == "_No matches found._"
    assert lines(tmp_path / "json" / "matches") == []


def test_json_and_tables(spark, matches, entries, tmp_path):
    report.write_matches(matches, entries, str(tmp_path / "j"), "JSON")
    rows = [json.loads(l) for l in lines(tmp_path / "j" / "matches")]
    assert rows[0]["wanted_title"] == 'Zero | "q"' and rows[0]["score"] == 100
    assert "price" not in rows[1] and "url" not in rows[1]
    about = json.loads(lines(tmp_path / "j" / "metadata")[0])
    assert about["total_matches"] == 8 and about["total_searched"] == 20
    report.write_matches(matches, entries, str(tmp_path / "t"), "tables")
    back = spark.read.parquet(str(tmp_path / "t" / "matches"))
    assert back.where("certainty = 'certain'").count() == 3 and back.count() == 8
    with pytest.raises(ValueError, match="text, csv, json, markdown, tables"):
        report.write_matches(matches, entries, str(tmp_path / "x"), "yaml")


EXPORT = '''Book Id,Title,Author,ISBN,ISBN13,My Rating,Bookshelves
1,"He said ""Go"", twice",Ann,"=""0262046482""","=""9780262046480""",5,to-read
2,Empty,Bob,"=""""","=""""",0,to-read
3,Only ten,Cid,"=""043942089X""","=""""",0,to-read
4,No author,,,,0,to-read
5,No shelf,Eve,,,0,
6,Two shelves,Fay,,,0,"to-read, fav"
7,"Line
break",Gus,,978-0-262-04648-0,0,to-read
8,Only ten,Hal,,,0,read
'''


def test_reading_list(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(EXPORT)
    export = read_reading_list(spark, str(path))
    assert export.columns == ["Title", "Bookshelves", "Author", "ISBN", "ISBN13"]
    rows = entries_of_shelf(export, "to-read").orderBy("position").collect()
    assert [(r.title, r.author, r.isbn) for r in rows] == [
        ('He said "Go", twice', "Ann", "9780262046480"),
        ("Empty", "Bob", None),
        ("Only ten", "Cid", "043942089X"),
        ("No author", None, None),
        ("Line\nbreak", "Gus", "9780262046480"),
    ]
    bare = entries_of_shelf(export, "to-read", use_isbn=False)
    assert bare.where(F.col("isbn").isNotNull()).count() == 0
    numbered = export.withColumn("n", F.monotonically_increasing_id())
    authors = dict(map(tuple, title_authors(numbered, "n").collect()))
    assert authors["Only ten"] == "Hal" and "No author" not in authors


def test_optional_and_required_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,Bookshelves\nX,s\n")
    row = entries_of_shelf(read_reading_list(spark, str(tmp_path / "a.csv")), "s").first()
    assert (row.title, row.author, row.isbn) == ("X", None, None)
    (tmp_path / "b.csv").write_text("Name,Bookshelves\nX,s\n")
    with pytest.raises(ValueError, match="Title"):
        read_reading_list(spark, str(tmp_path / "b.csv"))


def test_text_lines_survive_missing_titles(spark):
    rows = spark.createDataFrame([(1, None, "m", "90%"), (2, "q", None, None)], "position long, query string, match string, score_pct string")
    got = [r.value for r in report.text_lines(rows).orderBy("position").collect()]
    assert got == ["Listing: m, Wanted: , Match Score: 90%", "Listing: , Wanted: q, Match Score: "]
