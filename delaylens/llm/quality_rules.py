"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is a table of (name, measure, comparison, bound). ``measure_columns``
gives the measures of a text as column expressions, ``compile_rules`` turns the
table into boolean columns, and ``apply_rules`` puts both into one projection.
Everything is a built-in expression; there is no user function and no shuffle.

Defined results: a null text counts as empty and has no words; it fails the
base rule (too few words). Empty tables give empty results. Rows are judged one
by one, so repeated rows get equal results; ties don't arise. Extra columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty

WORD_SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be this by are at from "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une est que pour qui dans sur par au pas avec "
    "de la que el en y los se del las un por con no una para su al es lo"
).split()


class Rule(NamedTuple):
    """A text breaks the rule if ``measure op bound`` holds."""

    name: str
    measure: str
    op: str
    bound: float


#: Judged on ratios, so that long and short texts are treated alike: every rule
#: judges every text.
RULES: tuple[Rule, ...] = (
    Rule("short_words", "mean_word_chars", "<", 2.0),
    Rule("long_words", "mean_word_chars", ">", 14.0),
    Rule("many_symbols", "symbol_ratio", ">", 0.1),
    Rule("shouting", "shout_ratio", ">", 0.5),
    Rule("few_stop_words", "stop_word_ratio", "<", 0.03),
    Rule("repeated_lines", "dup_line_ratio", ">", 0.5),
    Rule("table_lines", "bar_line_ratio", ">", 0.5),
)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than white space, in order."""
    return F.filter(F.split(text, WORD_SPACE), lambda w: w != "")


def repeated_window_words(words: Column, n_words: Column, width: int = WINDOW) -> Column:
    """Words inside ``width``-word windows that occur twice or more.

    Windows are compared by a 64-bit hash. Texts without an equal pair (most)
    stop after one hash-set pass; the others sort (hash, start) pairs, keep
    starts whose hash equals a neighbour's, and add up the overlaps of the
    covered ranges, so that the cost stays n log n for any text.
    """
    def window_hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - F.lit(width))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + F.lit(k)) for k in range(width)]))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda x, j: (F.get(p, j) ["h"] == x["h"])
            kept = F.filter(p, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
            return F.sort_array(F.transform(kept, lambda x: x["i"]))

        def total(s: Column) -> Column:
            steps = F.transform(s, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(s, j + 1) - x, F.lit(width))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, starts), total)

    def count(hashes: Column) -> Column:
        clean = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(clean, F.lit(0).cast("long")).otherwise(covered(hashes))

    return F.when(n_words <= width, F.lit(0).cast("long")).otherwise(let(window_hashes(words), count))


def with_measures(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts of each text, beside the columns in ``keep``.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are exact
    counts; n_lines, n_bar_lines, n_shouts and n_stop_words feed the ratios.
    A line counts if it has a word.
    """
    split = docs.select(*keep, text_or_empty(text_col).alias("__text"))
    split = split.select(
        *keep,
        "__text",
        words_of(F.col("__text")).alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    words, lines, text = F.col("__words"), F.col("__lines"), F.col("__text")
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    chars_without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    long = lambda c: c.cast("long")
    return split.select(
        *keep,
        long(F.size(words)).alias("n_words"),
        long(F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        long(chars_without(SYMBOLS)).alias("n_symbols"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        repeated_window_words(words, F.size(words)).alias("n_repeat_words"),
        long(F.size(lines)).alias("n_lines"),
        long(F.size(F.filter(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(" | "), F.lit("  "))) >= 3))).alias("n_bar_lines"),
        long(chars_without("!")).alias("n_shouts"),
        long(F.size(F.filter(words, lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS)))))).alias("n_stop_words"),
    )


def ratios() -> dict[str, Column]:
    """Ratios the rules speak of; null where the denominator is zero."""
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return {
        "mean_word_chars": part("word_chars", "n_words"),
        "symbol_ratio": part("n_symbols", "n_words"),
        "shout_ratio": part("n_shouts", "n_words"),
        "stop_word_ratio": part("n_stop_words", "n_words"),
        "dup_line_ratio": part("n_dup_lines", "n_lines"),
        "bar_line_ratio": part("n_bar_lines", "n_lines"),
    }


def compile_rules(rules: Sequence[Rule] = RULES) -> list[Column]:
    """One boolean column per rule; a ratio that doesn't exist breaks none."""
    have = ratios()
    compare = {"<": lambda a, b: a < b, ">": lambda a, b: a > b}
    return [F.coalesce(compare[r.op](have[r.measure], F.lit(r.bound)), F.lit(False)).alias(r.name) for r in rules]


def apply_rules(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Counts, base rule, the names of broken rules and the verdict ``kept``.

    ``base_failed``: fewer than ten words, or more than a fifth of the words
    stand in repeated windows.
    """
    counts = with_measures(docs, text_col, keep)
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    broken = F.filter(
        F.array(*[F.when(flag, F.lit(r.name)) for flag, r in zip(compile_rules(rules), rules, strict=True)]),
        lambda x: x.isNotNull(),
    )
    judged = counts.select("*", base.alias("base_failed"), broken.alias("broken_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns and no others.

    The row travels through the projection as one struct, so no column of the
    input can clash with a measure.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text_col).alias("__body"))
    judged = apply_rules(packed, rules, "__body", keep=("__row",))
    # The verdict is computed once, in the projection: a filter doesn't move
    # below one that has a non-deterministic column, where every mention of a
    # measure would become a copy of its expression.
    judged = judged.withColumn("__at", F.spark_partition_id())
    return judged.filter(F.col("kept") & (F.col("__at") >= 0)).select("__row.*")
