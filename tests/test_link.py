from __future__ import annotations

import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from shelflink.functions.ids import is_valid_isbn
from shelflink.functions.titles import with_variations
from shelflink.operators import candidates
from shelflink.operators.candidates import block_by_title
from shelflink.operators.lookup import hot_keys, lookup_join
from shelflink.operators.scoring import FLOOR_RULES, check_weights, least_base_percent
from shelflink.operators.titles import title_table
from shelflink.plans.link import link
from shelflink.scratch import written

ENTRY = "position long, title string, author string, isbn string"
LISTING = (
    "listing_pos long, title string, author string, isbn string, price string, url string, "
    "cover_url string"
)
NAMES = ["Ada Berg", "Berg Ada", "Ilya Moreau", "Ilya Morel", None]
IDS = ["0262046482", "9780262046480", "043942089X", "9780439420891", "9780262049999", None, None, None]
WORDS = "dune messiah emma coast the of long river ring small harbour night letters sea".split()


def variants(isbn):
    pairs = {"0262046482": "9780262046480", "043942089X": "9780439420891"}
    pairs |= {v: k for k, v in pairs.items()}
    other = {"9780262049999": "0262049996"}
    return {isbn, pairs.get(isbn), other.get(isbn)} - {None}


def make_rows(seed, n_entries, n_listings):
    rng = random.Random(seed)

    def title():
        words = rng.choices(WORDS, k=rng.randrange(1, 6))
        text = " ".join(words)
        kind = rng.randrange(6)
        if kind == 0:
            text += ": " + " ".join(rng.choices(WORDS, k=rng.randrange(1, 6)))
        if kind == 1:
            text = "The " + text + " (Series 1)"
        if kind == 2:
            text = text.replace("e", "a", 1)
        return text

    entries = [(i, title(), rng.choice(NAMES), rng.choice(IDS)) for i in range(n_entries)]
    listings = [
        (i, title(), rng.choice(NAMES), rng.choice(IDS), f"${i}.50", f"u{i}", None)
        for i in range(n_listings)
    ]
    return entries, listings


def prepared(spark, titles):
    rows = spark.createDataFrame([(t,) for t in sorted(set(titles))], "title string")
    return {r.title: (r.main, r.variations) for r in with_variations(rows).collect()}


def expected(parts, entries, candidates, threshold, require_author, authors=None):
    """``candidates(entry)`` lists the listings it meets, in order."""
    out = {}
    for position, title, author, isbn in entries:
        met = candidates(position, title)
        exact = [l for l in candidates(position, None) if isbn and l[3] in variants(isbn)]
        if exact:
            first = min(exact)
            out[position] = (first[0], 100, "isbn_exact")
            continue
        pair_author = authors.get(title) if authors else None
        offers = [(*parts[l[1]], l[2]) for l in met]
        winner, top = brute.best(parts[title], offers, pair_author)
        if winner is None:
            continue
        listing = met[winner]
        score, kind = min(int(top), 100), "fuzzy"
        if isbn and listing[3] and isbn[:9] == listing[3][:9]:
            score, kind = min(int(score * 1.10), 100), "fuzzy_isbn_partial"
        alike = brute.token_set(author, listing[2]) if author and listing[2] else None
        if alike is not None and alike >= 95:
            score = min(int(score * 1.15), 100)
            kind = "fuzzy_isbn_author" if "isbn" in kind else "fuzzy_author_exact"
        if score < threshold or (require_author and alike is not None and alike < 50):
            continue
        out[position] = (listing[0], score, kind)
    return out


def result(matches):
    return {r.position: (r.listing_pos, r.score, r.match_type) for r in matches.collect()}


@pytest.mark.parametrize("threshold, require_author, by_pair", [(90, True, False), (60, False, True)])
def test_pages_match_brute_force(spark, threshold, require_author, by_pair):
    entries, listings = make_rows(1, 60, 400)
    rng = random.Random(2)
    page = {l[0]: rng.randrange(60) for l in listings}
    parts = prepared(spark, [r[1] for r in entries + listings])
    authors = {t: a for _, t, a, _ in entries if a} if by_pair else None
    e = spark.createDataFrame(entries, ENTRY)
    l = spark.createDataFrame(
        [(*r, page[r[0]]) for r in listings], LISTING + ", query_id long"
    )
    lookup = spark.createDataFrame(list(authors.items()), "title string, author string") if by_pair else None

    def met(position, title):
        return [r for r in listings if page[r[0]] == position]

    want = expected(parts, entries, met, threshold, require_author, authors)
    options = dict(threshold=threshold, require_author=require_author, title_authors=lookup)
    assert result(link(e, l, **options)) == want
    assert result(link(e, l, prune=False, hot_rows=1, **options)) == want
    assert len({k for _, _, k in want.values()}) >= 2 + by_pair


def blocks(spark, parts, entries, listings, overlap):
    """Candidate titles per entry title, straight from the definition."""
    tables = {}
    for side, rows in (("q", entries), ("l", listings)):
        for title in {r[1] for r in rows}:
            for i, text in enumerate(parts[title][1]):
                tables[side, title, i] = set(brute.clean(text))
    df = {}
    offered = [words for (side, _, _), words in tables.items() if side == "l"]
    for words in offered:
        for w in words:
            df[w] = df.get(w, 0) + 1

    def weigh(words):
        return sum((len(offered) // df.get(w, 1)).bit_length() for w in words)

    found = {}
    for (a, q, _), x in tables.items():
        for (b, l, _), y in tables.items():
            if a == "q" and b == "l" and x & y:
                if weigh(x & y) * 100 >= overlap * max(weigh(x), weigh(y)):
                    found.setdefault(q, set()).add(l)
    return found


@pytest.mark.parametrize("overlap", [60, 30])
def test_titles_match_brute_force(spark, overlap):
    entries, listings = make_rows(3, 150, 200)
    entries += [(1000 + i, "dune messiah", "Ada Berg", None) for i in range(80)]
    listings += [(1000 + i, "dune  messiah", None, None, None, None, None) for i in range(80)]
    parts = prepared(spark, [r[1] for r in entries + listings])
    near = blocks(spark, parts, entries, listings, overlap)

    def met(position, title):
        return [r for r in listings if title is None or r[1] in near.get(title, ())]

    want = expected(parts, entries, met, 80, True)
    e = spark.createDataFrame(entries, ENTRY).repartition(7)
    l = spark.createDataFrame(listings, LISTING).repartition(5)
    assert result(link(e, l, threshold=80, min_overlap=overlap)) == want
    again = link(e.coalesce(1), l.coalesce(1), threshold=80, min_overlap=overlap, prune=False, hot_rows=1)
    assert result(again) == want


def test_blocking_is_complete_for_long_and_frequent_words(spark):
    """Very long titles take the other verification path; cells split frequent words."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(160)]
    base = rng.sample(vocabulary, 100)
    entries, listings = [], []
    for i in range(40):
        words = base[:] if i % 2 else rng.sample(vocabulary, rng.randrange(1, 90))
        rng.shuffle(words)
        entries.append((i, " ".join(words[: rng.randrange(50, 100)] if i % 2 else words)))
        listings.append((i, " ".join(w for w in words if rng.random() < 0.9) or "w1"))
    entries += [(100 + i, f"common {i % 9}") for i in range(9)]
    listings += [(100 + i, f"common {i % 9} x") for i in range(9)]
    parts = prepared(spark, [r[1] for r in entries + listings])
    near = blocks(spark, parts, entries, listings, 60)

    def table(rows):
        return written(title_table(spark.createDataFrame(rows, "id long, title string")), "t")

    titles_q, titles_l = dict(entries), dict(listings)
    want = {
        (i, j) for i, q in titles_q.items() for j, l in titles_l.items() if l in near.get(q, ())
    }
    for cell_rows in (20_000, 3):
        got = block_by_title(table(entries), table(listings), 60, cell_rows).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    assert any(len(titles_q[i].split()) > 64 for i, _ in want)


@pytest.mark.parametrize("entries", [0, 1])
def test_one_sided_hot_words_repeat_no_rows(spark, entries):
    rows = spark.range(100_000).select("id", F.lit("hot").alias("word"), F.lit(1).alias("variation"))
    full = rows.selectExpr("word", "id", "variation", "1L AS rest", "1L AS whole", "array(word) AS words")
    few = full.where(F.col("id") < entries)
    crowded = candidates._crowded_words(few, full, 2000)
    for broadcast in (True, False):
        listings = candidates._grid(full, crowded, broadcast, "l", "q", 2000)
        wanted = candidates._grid(few, crowded, broadcast, "q", "l", 2000)
        assert listings.count() == 100_000 * entries
        assert wanted.count() == 50 * entries
        assert listings.join(wanted, ["word", "_q_line", "_l_line"]).count() == 100_000 * entries


def test_matches_fall_as_threshold_rises(spark):
    entries, listings = make_rows(6, 100, 150)
    e, l = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(listings, LISTING)
    found = [set(result(link(e, l, threshold=t, require_author=False))) for t in (70, 85, 95)]
    assert found[0] >= found[1] >= found[2] and len(found[0]) > len(found[2])


def test_rules_and_labels(spark):
    rule = FLOOR_RULES[0][0]
    entries = [
        (0, f"{rule} zzzz yyyy", None, None),
        (1, "no isbn author", "Ada Berg", "0262046482"),
        (2, None, None, "043942089X"),
        (3, "nobody sells this", None, None),
        (4, "night letters", "Ilya Moreau", None),
    ]
    listings = [
        (0, f"{rule.title()} a completely different tail of words", None, None, "$60", "u", "c", 0),
        (1, "other", None, "9780262046480", "$1,050.00", None, None, 1),
        (2, "third", "Umar", "9780439420891", "free", None, None, 2),
        (4, "night letters", "Someone Else", None, None, None, None, 4),
    ]
    e = spark.createDataFrame(entries, ENTRY)
    l = spark.createDataFrame(listings, LISTING + ", query_id long")
    rows = {r.position: r for r in link(e, l).collect()}
    assert set(rows) == {0, 1, 2}
    assert rows[0].score == 92 and rows[0].high_price and rows[0].score_pct == "92%"
    assert rows[1].match == "other by Unknown" and rows[1].price_value == 1050.0
    assert rows[2].match == "third by Umar" and rows[2].price_value is None
    assert rows[1].bonuses == [] and rows[1].match_type == "isbn_exact"
    loose = {r.position: r for r in link(e, l, require_author=False, use_isbn=False).collect()}
    assert loose[4].match == "night letters by Someone Else" and 1 not in loose


def test_weights_and_bound():
    with pytest.raises(ValueError):
        check_weights({"ratio": 1.0})
    with pytest.raises(ValueError):
        check_weights(dict.fromkeys(("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio"), 0.3))
    need = least_base_percent(90)
    assert math.floor(math.floor(need * 1.10) * 1.15) >= 90
    assert math.floor(math.floor((need - 1) * 1.10) * 1.15) < 90
    assert least_base_percent(0) == 0


def test_lookup_join_spreads_hot_keys_and_keeps_all_rows(spark):
    rows = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(
            F.concat(F.lit("k"), F.col("id") % 50)
        ).alias("key"),
    )
    lookup = spark.createDataFrame([("hot", 1), ("k2", 2), ("k5", 3)], "key string, v int")
    plain = rows.join(lookup, "key", "left")
    salted = lookup_join(rows, lookup, "key", F.col("id"), "left", hot_rows=100)
    assert sorted(map(tuple, salted.select("id", "key", "v").collect())) == sorted(
        map(tuple, plain.select("id", "key", "v").collect())
    )
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("key is not null")
    assert hot_keys(counts, "key", hot_rows=500).count() == 1
    assert lookup_join(rows, lookup, "key", F.col("id"), hot_rows=100).count() == plain.where(
        "v is not null"
    ).count()


def test_validity_is_not_needed_for_matching(spark):
    """An identifier with a wrong check character still matches itself."""
    e = spark.createDataFrame([(0, "a", None, "0262046483")], ENTRY)
    l = spark.createDataFrame([(7, "b", None, "0262046483", None, None, None)], LISTING)
    assert result(link(e, l)) == {0: (7, 100, "isbn_exact")}
    assert not spark.range(1).select(is_valid_isbn(F.lit("0262046483"))).first()[0]
