"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule has measures (columns it needs) and a rejection predicate. On a bounded sample every rule
is run alone; its time is its cost, the share of rows it rejects its selectivity. Rules run in the
order of rejection per cost; ``accepted`` measures for a rule only the rows that no earlier rule
rejected (``judged`` returns the base counts of all rows, so it measures those first). The verdict is the conjunction of all rules, so it does not depend on that order.

NULL and empty texts have no words and fail. Words are separated by the six ASCII white-space
characters. Rows are judged each on their own: repeated rows, ties and NULL ids need no rule. An
empty table gives an empty result. Texts of any length are read whole; repetition inside a text is
found by sorting hashes of its five-word windows, never by comparing all pairs.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflink.llm.common import WORD, Scratch, let, text_of

WINDOW = 5
SAMPLE_ROWS = 500
BLANKS = r"\x20\x09-\x0D"


def _longs(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns({k: c.cast("long") for k, c in columns.items()})


# Measures. ``on`` says for which rows a measure is needed; others get NULL.
def words(df: DataFrame, on: Column) -> DataFrame:
    df = df.withColumn("_words", F.when(on, F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))))
    return _longs(df, n_words=F.size("_words"), word_chars=F.length(F.array_join("_words", "")))


def symbols(df: DataFrame, on: Column) -> DataFrame:
    return _longs(df, n_symbols=F.when(on, F.regexp_count("_text", F.lit("[#*$%&|<>]"))))


def capitals(df: DataFrame, on: Column) -> DataFrame:
    counts = {"_upper": "[A-Z]", "_letters": "[A-Za-z]"}
    return _longs(df, **{k: F.when(on, F.regexp_count("_text", F.lit(p))) for k, p in counts.items()})


def shouts(df: DataFrame, on: Column) -> DataFrame:
    return _longs(df, _shouts=F.when(on, F.regexp_count("_text", F.lit(f"!(?=[{BLANKS}]|$)"))))


def lines(df: DataFrame, on: Column) -> DataFrame:
    with_word = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    df = df.withColumn("_lines", F.when(on, with_word))
    df = _longs(df, _n_lines=F.size("_lines"), _distinct=F.size(F.array_distinct("_lines")))
    return df.withColumn("n_dup_lines", F.col("_n_lines") - F.col("_distinct")).drop("_lines")


def _covered(places: Column) -> Column:
    """Words inside windows that start at the sorted ``places``."""
    gain = F.transform(
        places, lambda p, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get(places, i - 1)))
    )
    return F.aggregate(gain, F.lit(0), lambda a, x: a + x)


def _repeated(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    numbered = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def places(ordered: Column) -> Column:
        def twice(e: Column, i: Column) -> Column:
            before = F.get(ordered, i - 1)["h"].eqNullSafe(e["h"])
            return before | F.get(ordered, i + 1)["h"].eqNullSafe(e["h"])

        return F.array_sort(F.transform(F.filter(ordered, twice), lambda e: e["i"]))

    covered = let(let(F.sort_array(numbered), places), _covered)
    # Few texts repeat anything; only those are sorted.
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(0)


def repetition(df: DataFrame, on: Column) -> DataFrame:
    """Words inside windows of five that occur twice or more in the text."""

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    repeated = F.when(F.size("_words") < WINDOW, 0).otherwise(let(let(hashes, windows), _repeated))
    return _longs(df, n_repeat_words=F.when(on & F.col("_words").isNotNull(), repeated))


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[Callable[[DataFrame, Column], DataFrame], ...]
    rejects: str


RULES = (
    Rule("few_words", (words,), "n_words < 10"),
    Rule("repeated_words", (words, repetition), "100 * n_repeat_words > 20 * n_words"),
    Rule("word_length", (words,), "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    Rule("symbols", (words, symbols), "100 * n_symbols > 10 * word_chars"),
    Rule("repeated_lines", (lines,), "100 * n_dup_lines > 30 * _n_lines"),
    Rule("capitals", (capitals,), "100 * _upper > 60 * _letters AND _letters >= 50"),
    Rule("shouts", (words, shouts), "100 * _shouts > 30 * n_words"),
)


def _measured(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    for measure in dict.fromkeys(m for rule in rules for m in rule.needs):
        df = measure(df, F.lit(True))
    return df


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejected share per second on a sample of at most ``sample_rows`` rows."""
    scratch = Scratch(docs.sparkSession, "rules-sample")
    sample = scratch.put(docs.select(text_of().alias("_text")).limit(sample_rows), "sample")
    value = {}
    for rule in rules:
        rejected = _measured(sample, (rule,)).agg(F.count_if(F.expr(rule.rejects)))
        start = time.perf_counter()
        n = rejected.first()[0]
        value[rule.name] = (n + 0.01) / (time.perf_counter() - start)
    scratch.drop(sample)
    return sorted(rules, key=lambda r: -value[r.name])


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass all rules, with the same columns."""
    # Whole rows in one column, so no name can clash. Each rule sees what the rules before it left.
    df = docs.select(F.struct("*").alias("_row"), text_of().alias("_text"))
    for rule in rule_order(docs, rules):
        for measure in rule.needs:
            df = measure(df, F.lit(True))
        df = df.where(f"NOT coalesce({rule.rejects}, false)").select("_row", "_text")
    return df.select("_row.*")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row.

    The counts are wanted for every row, so they are measured first; the cascade then decides.
    """
    df = docs.select("doc_id", text_of().alias("_text"))
    base = Rule("base", (words, symbols, lines, repetition), "n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    order = rule_order(docs, rules)
    df = _measured(df, (base, *order)).drop("_words")
    # Evaluated from the left, so a rule runs only where no earlier one rejects.
    rejected = F.lit(False)
    for rule in order:
        rejected = rejected | F.expr(f"coalesce({rule.rejects}, false)")
    failed = F.expr(base.rejects)
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~rejected).alias("kept"),
    )
