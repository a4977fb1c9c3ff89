"""Secret scan: patterns of known secrets, and random strings told apart by Markov models.

Two character Markov models, one of random strings and one of ordinary identifiers, are counted from
labelled samples; a long run of identifier characters is reported when the log-likelihood ratio of
the two exceeds ``LEAST_RATIO``. Everything is DataFrame expressions.

Random samples are made by hashing document ids and written in hexadecimal and base 64, values
that the patterns find in the documents are added; ordinary samples are the other words and
identifiers of 8 to 19 characters that the documents hold twice or more, and names, paths, versions and dates made of their words. Bound of the fit: ``TRAIN_ROWS`` documents, chosen by hash of doc_id.

Places are code points, ends exclusive. NULL text counts as empty. Rows are scanned each on their
own: repeated rows, ties and NULL ids need no rule. An empty table gives an empty result. Texts of
any length are read whole; places are running sums over pieces of a text, taken in blocks, so a
text with very many matches costs little more than linear time.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflink.llm.common import Scratch, let, text_of

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so asking for the least length here finds the same places as filtering later.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{12,}"
LEAST_RUN = 12
ORDINARY = r"[A-Za-z0-9+/_=-]{8,}"
KINDS = ("assign", "access", "hex", "random")
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
STATES = len(LETTERS) + 1
TRAIN_ROWS = 5_000
LEAST_RATIO = math.log(1e6)
BLOCK = 128
#: Weight of the common share of a state against counted steps.
BACKOFF = 8.0


def _running(lengths: Column) -> Column:
    """Sum of the entries before each entry, in blocks: appending to a long array copies it each time."""

    def sums(start: Column, values: Column) -> Column:
        return F.aggregate(
            values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )

    def of(values: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(values) / BLOCK).cast("int") - 1)
        blocks = F.transform(numbers, lambda b: F.slice(values, b * BLOCK + 1, BLOCK))

        def placed(cut: Column) -> Column:
            totals = F.transform(cut, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
            return let(
                sums(F.lit(0), totals),
                lambda starts: F.flatten(
                    F.transform(cut, lambda x, b: F.slice(sums(F.get(starts, b), x), 1, F.size(x)))
                ),
            )

        return let(blocks, placed)

    return F.when(F.size(lengths) > 0, let(lengths, of)).otherwise(F.array().cast("array<int>"))


def _spans(pattern: str, group: int = 0, least: int = 0) -> Column:
    """(start, end, text) of the matches in ``_text`` whose ``group`` has ``least`` characters."""

    def matches(i: int) -> Column:
        return F.regexp_extract_all("_text", F.lit(pattern), F.lit(i))

    def placed(found: Column, starts: Column) -> Column:
        # Pieces in order: gap, match, gap, match, ...
        return F.transform(
            found,
            lambda m, i: F.struct(
                F.get(starts, i * 2 + 1).alias("start"), (F.get(starts, i * 2 + 1) + F.length(m)).alias("end"), m.alias("text")
            ),
        )

    def spans(found: Column) -> Column:
        gaps = F.transform(F.split("_text", pattern, -1), lambda g: F.length(g))
        pieces = let(gaps, lambda g: F.flatten(F.transform(found, lambda m, i: F.array(F.get(g, i), F.length(m)))))
        all_spans = let(_running(pieces), lambda starts: placed(found, starts))
        if group:
            all_spans = let(
                matches(group), lambda g: F.filter(all_spans, lambda x, i: F.length(F.get(g, i)) >= least)
            )
        none = F.array().cast("array<struct<start:int,end:int,text:string>>")
        return F.when(F.size(found) > 0, all_spans).otherwise(none)

    return let(matches(0), spans)


def known_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, _text and the pattern spans ``assign``, ``access``, ``hex`` of every row."""
    df = docs.select("doc_id", text_of().alias("_text"))
    return df.withColumns(
        {"assign": _spans(ASSIGN, group=2, least=12), "access": _spans(ACCESS), "hex": _spans(HEX)}
    )


def _states(text: Column) -> Column:
    """Model state of each character: its number in ``LETTERS``, all others in state 0."""
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(LETTERS), c))


def _steps(samples: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of neighbouring states over ``sample``, which was seen ``n`` times; at most STATES squared rows."""
    states = samples.where("length(sample) > 1").select(_states(F.col("sample")).alias("s"), "n")
    pair = F.explode(F.transform(F.slice("s", 1, F.size("s") - 1), lambda a, i: F.struct(a.alias("a"), F.get("s", i + 1).alias("b"))))
    counted = states.select(pair.alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n")).collect()
    return {(a, b): n for a, b, n in counted}


def _identifiers(word: Column) -> Column:
    """Names, paths, versions, dates and rules as people write them, made of one word and its hash."""
    capital, number = F.initcap(word), F.pmod(F.xxhash64(word), F.lit(10_000))
    two = [F.lpad(F.pmod(F.floor(number / k), F.lit(m)).cast("string"), 2, "0") for k, m in ((1, 30), (30, 12), (7, 28))]
    year = F.concat(F.lit("20"), two[0])
    return F.array(
        F.concat_ws("_", word, word), F.concat_ws("-", word, word, year), F.concat_ws("/", F.lit(""), word, word),
        F.concat(word, capital, capital), F.upper(word), F.concat_ws("_", F.upper(word), F.upper(word)),
        F.concat(F.substr(F.upper(word), F.lit(1), F.lit(3)), capital), F.concat(word, F.lit("_v"), two[1]),
        F.concat(word, year, word), F.concat(capital, number.cast("string")), F.concat_ws("-", year, two[1], two[2]),
        F.concat(word, F.lit("="), capital), F.concat(capital, F.lit("+"), word), F.lit("------"), F.lit("======"),
    )


def fit_ratio(docs: DataFrame, rows: int = TRAIN_ROWS) -> list[float]:
    """Log of random over ordinary step probability, by first state times STATES plus second."""
    scratch = Scratch(docs.sparkSession, "secrets-fit")
    # The fit reads this sample only, the same in every run; the scan reads every row.
    chance = F.struct(F.xxhash64(F.lit("fit"), "doc_id").alias("h"), F.xxhash64("text").alias("t"))
    part = max(1, docs.count() // max(1, rows))
    drawn = docs.select("doc_id", "text", chance.alias("_chance")).where(F.pmod("_chance.h", F.lit(part)) == 0)
    last = drawn.select("_chance").orderBy("_chance").limit(2 * rows).agg(F.max("_chance").alias("_last"))
    # A repeated row counts once, so ties at the bound add nothing.
    sample = drawn.where(F.col("_chance") <= last.scalar()).dropDuplicates(["_chance"])
    found = scratch.put(known_secrets(sample), "sample")
    digest = F.sha2(F.concat_ws(":", F.lit("random"), F.col("doc_id").cast("string")), 256)
    made = found.select(F.explode(F.array(digest, F.base64(F.unhex(digest)))).alias("sample"))
    matched = found.select(F.explode(F.concat("access", "hex")).alias("x")).select(F.col("x.text").alias("sample"))
    runs = F.regexp_extract_all("_text", F.lit(ORDINARY), F.lit(0))
    secret = F.transform(F.concat("assign", "access", "hex"), lambda x: x["text"])
    seen = found.where(F.size(secret) == 0).select(F.explode(runs).alias("sample"))
    # Long runs, and those seen once, may themselves be secrets.
    short = seen.where("length(sample) < 20 AND NOT sample RLIKE '[0-9].*[0-9].*[0-9].*[0-9]'")
    ordinary = short.groupBy("sample").agg(F.count("*").alias("n")).where("n > 1")
    words = F.explode(F.regexp_extract_all("_text", F.lit(r"[A-Za-z]{3,}"), F.lit(0)))
    named = found.select(words.alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    joined = named.where("n > 1 AND length(w) < 20").select(F.explode(_identifiers(F.col("w"))).alias("sample"), F.lit(1).alias("n"))
    random = made.union(matched).withColumn("n", F.lit(1))
    random_steps, ordinary_steps = _steps(random), _steps(ordinary.union(joined))
    scratch.drop(found)

    def shares(counts: dict[tuple[int, int], int]) -> Callable[[int, int], float]:
        """Step probabilities; states seen seldom fall back on how common the next state is."""
        total = sum(counts.values())
        ends, starts = [0] * STATES, [0] * STATES
        for (a, b), n in counts.items():
            starts[a] += n
            ends[b] += n

        def share(a: int, b: int) -> float:
            common = (ends[b] + 0.5) / (total + 0.5 * STATES)
            return (counts.get((a, b), 0) + BACKOFF * common) / (starts[a] + BACKOFF)

        return share

    random, plain = shares(random_steps), shares(ordinary_steps)
    return [math.log(random(a, b) / plain(a, b)) for a in range(STATES) for b in range(STATES)]


def random_runs(df: DataFrame, ratio: list[float], least: float = LEAST_RATIO) -> DataFrame:
    """``df`` (with ``_text`` and pattern spans) with ``random``: runs that the models call random.

    What a pattern span covers of a run is left to the pattern; pieces of ``LEAST_RUN`` characters or
    more beside it are judged like runs.
    """

    def beside(known: Column, x: Column) -> Column:
        """Pieces of the run ``x`` outside the spans ``known``, which are sorted by start."""

        def pieces(over: Column) -> Column:
            def piece(i: Column) -> Column:
                # From the furthest end so far to the next start; NULLs are skipped.
                start = F.greatest(x["start"], F.array_max(F.transform(F.slice(over, 1, i), lambda k: k["end"])))
                end = F.least(x["end"], F.get(over, i)["start"])
                text = F.substr(x["text"], start - x["start"] + 1, F.greatest(end - start, F.lit(0)))
                return F.struct(start.alias("start"), end.alias("end"), text.alias("text"))

            cut = F.transform(F.sequence(F.lit(0), F.size(over)), piece)
            return F.when(F.size(over) == 0, F.array(x)).otherwise(cut)

        return let(F.filter(known, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), pieces)

    def free(known: Column) -> Column:
        cut = F.flatten(F.transform(_spans(RUN), lambda x: beside(known, x)))
        return F.filter(cut, lambda x: x["end"] - x["start"] >= LEAST_RUN)

    table = F.lit(ratio)

    def score(x: Column) -> Column:
        def total(s: Column) -> Column:
            steps = F.transform(
                F.slice(s, 1, F.size(s) - 1), lambda a, i: F.get(table, a * STATES + F.get(s, i + 1))
            )
            return F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v)

        return let(_states(x["text"]), total)

    candidates = let(F.array_sort(F.concat("assign", "access", "hex")), free)
    return df.withColumn("random", F.filter(candidates, lambda x: score(x) > least))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, assign, access, hex, random: arrays of (start, end, text) of every row."""
    return random_runs(known_secrets(docs), fit_ratio(docs)).drop("_text")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""

    def tagged(kind: str) -> Column:
        number = F.lit(KINDS.index(kind)).alias("n")
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), number, x["end"].alias("end")))

    def listed(*kinds: str) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(
            F.transform(
                F.sort_array(F.concat(*map(tagged, kinds))), lambda x: F.concat_ws(":", F.get(names, x["n"]), x["start"], x["end"])
            ),
            ",",
        )

    found = secrets(docs)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(*KINDS[:3]), 256).alias("base_sha256"),
        listed(*KINDS).alias("spans"),
    )
