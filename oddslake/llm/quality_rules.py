"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.llm.common import SPACE_CHARS, SPACE_CLASS, read_table, text_or_empty

#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "be", "are", "this", "was", "by", "at", "or", "an",
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "dem", "von", "mit", "sich", "auf", "für", "als", "auch",
    "le", "la", "les", "des", "du", "et", "est", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "au", "il", "elle",
    "el", "los", "las", "de", "en", "y", "que", "del", "se", "por", "con", "para", "una", "es", "su", "al", "no", "lo", "como",
)


class Rule(NamedTuple):
    """A document passes if ``least`` <= the named ratio <= ``most``; None leaves that side open."""

    ratio: str
    least: float | None
    most: float | None


#: The production thresholds.
RULES = (
    Rule("words", 50, None),
    Rule("mean_word_chars", 1.5, 16.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_share", 0.02, None),
    Rule("repeated_line_share", None, 0.5),
    Rule("bullet_line_share", None, 0.9),
    Rule("ellipsis_line_share", None, 0.3),
    Rule("loud_word_share", None, 0.3),
)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def ratios() -> dict[str, Column]:
    """The ratios a rule may name, over the measures that ``measured`` adds."""
    lines = F.col("n_lines_with_words")
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word_chars": _share(F.col("word_chars"), F.col("n_words")),
        "symbols_per_word": _share(F.col("n_symbols"), F.col("n_words")),
        "stop_word_share": _share(F.col("n_stop_words"), F.col("n_words")),
        "repeated_line_share": _share(F.col("n_dup_lines"), lines),
        "bullet_line_share": _share(F.col("n_bullet_lines"), lines),
        "ellipsis_line_share": _share(F.col("n_ellipsis_lines"), lines),
        "loud_word_share": _share(F.col("n_loud_words"), F.col("n_words")),
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression that holds if every rule passes."""
    known, passed = ratios(), F.lit(True)
    for rule in rules:
        value = known[rule.ratio]
        if rule.least is not None:
            passed = passed & (value >= rule.least)
        if rule.most is not None:
            passed = passed & (value <= rule.most)
    return passed


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once, also where Spark moves the whole expression into a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _measures(p: Column) -> Column:
    words, lines = p["words"], p["lines"]
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    packed = p["body"]
    for char in SPACE_CHARS:
        packed = F.replace(packed, F.lit(char), F.lit(""))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(packed).cast("long").alias("word_chars"),
        F.regexp_count(p["body"], F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines_with_words"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: x.rlike("^[ \\t-\\r]*[-*•]"))).alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)[ \\t-\\r]*$"))).alias("n_ellipsis_lines"),
        F.regexp_count(p["body"], F.lit("!!+")).alias("n_loud_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop_words"),
        _let(windows, lambda h: _covered_words(h, words)).alias("n_repeat_words"),
    )


def _covered_words(windows: Column, words: Column) -> Column:
    """Words in windows that are found twice: only if some hash repeats, windows are put in order of hash and words, which sets equal ones side by side."""
    repeated = F.size(windows) > F.size(F.array_distinct(windows))
    own = lambda h, i: F.struct(h.alias("h"), F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))
    ordered = F.array_sort(F.transform(windows, own))

    def covered(o: Column) -> Column:
        same = lambda x, y: (y["h"] == x["h"]) & (y["a"] == x["a"]) & (y["b"] == x["b"]) & (y["c"] == x["c"])
        twin = F.filter(o, lambda x, i: F.coalesce(same(x, F.get(o, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(o, i + 1)), F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(twin, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))).cast("long")

    return F.when(repeated, _let(ordered, covered)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the measures of ``text``, one row for each row of ``docs``."""
    body = text_or_empty(text)
    trimmed = F.btrim(body, F.lit(SPACE_CHARS))
    no_words = F.array().cast("array<string>")
    parts = F.struct(
        body.alias("body"),
        F.when(F.length(trimmed) > 0, F.split(trimmed, f"{SPACE_CLASS}+")).otherwise(no_words).alias("words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"),
    )
    return docs.select("doc_id", _let(parts, _measures).alias("m")).select("doc_id", "m.*")


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, base_failed and kept for every document.

    ``docs`` has doc_id and text. Null and empty texts have no words: all measures are 0
    and base_failed is true. Null and repeated ids get a row for each input row. Windows
    of three words are compared by hash and, where a hash repeats, by their words. An empty
    table gives an empty result; other columns are not read.
    """
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(docs).withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark, sf_dir: str) -> DataFrame:
    out = assess(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
