"""Quality rules: a table of thresholds compiled into one projection.

Everything is Spark columns over the text: no Python runs, nothing is
shuffled. A value that others are made of sits in an exploded array of one
element, which keeps it computed once per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Very common words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as was by an a be at or this from are have not but he his they you we "
    "der die und das von zu mit den ist des im dem nicht ein eine als auch es sich auf für an er so dass sie werden "
    "de la le et les des en un une du que est pour qui dans pas par plus sur au avec ce il sont se ou "
    "el los las una y que por con para del no su al lo como más pero sus le ha o este sí"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure of a text has to lie between two bounds (None: open)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Public thresholds for web text, the word count apart, which the base rule has.
RULES = (
    Rule("mean_word_length", "try_divide(word_chars, n_words)", 2.0, 14.0),
    Rule("symbols_per_word", "try_divide(n_symbols, n_words)", None, 0.1),
    Rule("stop_word_share", "try_divide(n_stop_words, n_words)", 0.02, None),
    Rule("words_with_letters", "try_divide(n_letter_words, n_words)", 0.6, None),
    Rule("stuttered_words", "try_divide(n_stutter, n_words)", None, 0.3),
    Rule("duplicate_lines", "try_divide(n_dup_lines - 1, n_lines)", None, 0.3),  # one is fine in a short text
    Rule("bullet_lines", "try_divide(n_bullet_lines, n_lines)", None, 0.9),
    Rule("ellipsis_lines", "try_divide(n_ellipsis_lines, n_lines)", None, 0.3),
)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often they are used."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def _repeat_words(hashes: str) -> Column:
    """Words covered by windows whose hash occurs twice; ``hashes`` has the windows in order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(sorted_pairs: Column) -> Column:
        after = F.concat(F.slice(sorted_pairs, 2, F.greatest(F.size(sorted_pairs) - 1, F.lit(0))), F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("i"))))
        both = F.zip_with(sorted_pairs, after, lambda a, b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["h"] == b["h"]).alias("same")))
        places = F.flatten(F.transform(F.filter(both, lambda x: x["same"]), lambda x: F.array(x["i"], x["j"])))
        ordered = F.sort_array(F.array_distinct(places))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total"))
        return F.aggregate(ordered, start, step)["total"]

    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeats, F.transform(F.array(pairs), covered)[0]).otherwise(0).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the measures that rules are made of, one row per row of ``docs``.

    Words are runs of characters other than ASCII white space; null texts have
    none. Windows of eight words are told apart by a 64-bit hash of their words.
    """
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    df = _once(df, _words=F.filter(F.split("_text", f"[{SPACES}]+"), lambda w: w != ""))
    df = _once(df, _lines=F.filter(F.split("_text", "\n"), lambda x: F.trim(F.translate(x, SPACES, " ")) != ""))
    n = F.size("_words")
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    df = _once(df, _windows=F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    bare = F.lower(F.translate("_text", ".,;:?!\"()", ""))
    long = lambda c: c.cast("long")
    chars = F.char_length("_text")
    letters = F.regexp_count("_text", F.lit(r"(?<![^ \t\n\x0b\f\r])[^ \t\n\x0b\f\r\p{L}]*\p{L}"))
    return df.select(
        F.col("_id").alias(id_col),
        long(n).alias("n_words"),
        long(F.char_length(F.translate("_text", SPACES, ""))).alias("word_chars"),
        long(chars - F.char_length(F.translate("_text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _repeat_words("_windows").alias("n_repeat_words"),
        long(F.size(F.filter(F.zip_with("_words", F.slice("_words", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda same: same))).alias("n_stutter"),
        long(F.size("_lines")).alias("n_lines"),
        long(F.size(F.filter(F.split(bare, f"[{SPACES}]+"), lambda w: w.isin(*sorted(set(STOP_WORDS)))))).alias("n_stop_words"),
        long(letters).alias("n_letter_words"),
        long(F.size(F.filter("_lines", lambda x: F.ltrim(x).rlike(r"^[-*•]")))).alias("n_bullet_lines"),
        long(F.size(F.filter("_lines", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$")))).alias("n_ellipsis_lines"),
    )


def compile_rules(rules=RULES) -> Column:
    """One condition: every measure within its bounds. A text without words fails."""
    passed = F.col("n_words") > 0
    for rule in rules:
        value = F.expr(rule.measure)
        if rule.low is not None:
            passed &= F.coalesce(value >= rule.low, F.lit(False))
        if rule.high is not None:
            passed &= F.coalesce(value <= rule.high, F.lit(False))
    return passed


def failed_rules(rules=RULES) -> Column:
    """Names of the rules that a text breaks, for reports."""
    tests = []
    for rule in rules:
        value, low, high = F.expr(rule.measure), F.lit(rule.low), F.lit(rule.high)
        tests.append(F.when((value < low) | (value > high), rule.name))
    return F.array_compact(F.array(*tests))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Measures with ``base_failed`` and ``kept``, one row per row of ``docs``.

    base_failed: fewer than 20 words, or more than 30 % of the words in
    repeated windows. kept: not base_failed, and all rules hold. Null and empty
    texts fail. Rows with one id are separate rows. Other columns are ignored.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = measures(docs, id_col, text_col).withColumn("base_failed", base)
    return df.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
