"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a boolean expression that says "reject". Their cost and selectivity are measured on a bounded sample;
the cascade then asks the rules in the order of rejections per cost and stops at the first that rejects. The order
decides what is fast, never which rows are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shielded, table

SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS, SAMPLE_CHARS = 512, 1 << 14  # bounds of the sample on which cost and selectivity are measured
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_array(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, "")).cast("long")


def n_symbols(text: Column, symbols: str = SYMBOLS) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.char_length(text) - F.char_length(F.translate(text, symbols, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines (split at \\n) with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window of so many words found twice or more in the text; overlaps count once.

    Windows are compared by 64-bit hashes of their words. Texts without a repeated window, nearly all, end at a
    hash-set comparison; only the others sort their windows, so the cost is n log n at most."""

    def covered(hashes: Column) -> Column:
        rows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda r: F.filter(r, lambda x, i: (F.get(r, i - 1)["h"] == x["h"]) | (F.get(r, i + 1)["h"] == x["h"]))
        starts = let(rows, lambda r: F.array_sort(F.transform(F.filter(twice(r), lambda x: x.isNotNull()), lambda x: x["i"])))
        spans = let(starts, lambda s: F.transform(s, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(s, i + 1) - p, F.lit(window)))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    def windows(each: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(each) - window), lambda i: F.xxhash64(*[F.get(each, i + k) for k in range(window)]))

    def count(each: Column) -> Column:
        return let(windows(each), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))

    return let(words, lambda w: F.when(F.size(w) <= window, F.lit(0)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), count))).cast("long")


def base_failed(words: Column, repeated: Column) -> Column:
    return (words < 20) | (100 * repeated > 30 * words)


def rules(text: str = "text") -> dict[str, Column]:
    """The default rules: each is true where a text is rejected. Counts named here must be columns."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.greatest(F.col("word_chars"), F.lit(1))
    shouting = F.char_length(F.regexp_replace(whole, r"[^\p{Lu}]", ""))
    marks = F.char_length(F.regexp_replace(whole, r"[^!?]", ""))
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 25 * F.col("n_words")),
        "dup_lines": 2 * F.col("n_dup_lines") > (F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1),
        "upper_case": 2 * shouting > bare,
        "marks": 10 * marks > 3 * F.col("n_words"),
        "stutter": 10 * let(word_array(F.col(text)), lambda w: F.size(F.filter(w, lambda x, i: F.get(w, i - 1) == x))) > 3 * F.col("n_words"),
        "letters": 2 * F.char_length(F.regexp_replace(whole, r"\P{L}", "")) < bare,
    }


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the rules use."""
    t = F.col(text)
    names = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}
    docs = docs.drop(*(names - {text}))
    return (
        docs.withColumn("_w", word_array(t))
        .withColumns({"n_words": n_words(F.col("_w")), "word_chars": word_chars(t), "n_symbols": n_symbols(t), "n_dup_lines": n_dup_lines(t), "n_repeat_words": n_repeat_words(F.col("_w"))})
        .drop("_w")
    )


def measured_order(docs: DataFrame, checks: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, rejection rate, seconds a row) by falling rejections per second, measured on a bounded sample of rows."""
    taken = docs.take(sample_rows)  # reads the first partitions only
    sample, rows = docs.sparkSession.createDataFrame(taken, docs.schema), max(1, len(taken))
    sample.agg(*(F.count_if(c) for c in checks.values())).collect()  # compiled code and warm files for all alike
    found = []
    for name, check in checks.items():
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(check)).first()[0]
        found.append((name, rejected / rows, max(1e-9, (time.perf_counter() - began) / rows)))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0]))


def cascade(docs: DataFrame, checks: dict[str, Column], order: list[str], out: str = "rejected_by") -> DataFrame:
    """Adds the name of the first rule, in this order, that rejects the row; null if none does. CASE asks no further
    rule once one has rejected."""
    if not order:
        return docs.withColumn(out, F.lit(None).cast("string"))
    first = F.when(F.coalesce(checks[order[0]], F.lit(False)), F.lit(order[0]))
    for name in order[1:]:
        first = first.when(F.coalesce(checks[name], F.lit(False)), F.lit(name))
    return docs.withColumn(out, first)


@shielded("_w")
def judge(docs: DataFrame, text: str = "text", checks: dict[str, Column] | None = None) -> DataFrame:
    """Adds the counts, base_failed, rejected_by and kept to whole documents; every row stays, and extra columns too
    (those with the names of added columns are replaced).

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike; an empty table gives
    an empty one. Work is n log n in the longest text and nothing is shuffled."""
    checks = checks or rules(text)
    full = counted(docs.drop(*({"base_failed", "rejected_by", "kept"} - {text})), text)
    plain = counted(docs.select(F.substring(text, 1, SAMPLE_CHARS).alias(text)), text)
    order = [name for name, _, _ in measured_order(plain, checks)]
    failed = F.when(F.col("n_words") < 20, F.lit(True)).otherwise(base_failed(F.col("n_words"), F.col("n_repeat_words")))
    full = cascade(full.withColumn("base_failed", failed), checks, order)
    return full.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
