"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import q
from .texts import fresh

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Frequent function words of the languages the rules know.
STOP_WORDS = (
    "the of and to in a is that it for on was as be with by this are at from or an "
    "de la que el en y los del se las un por con para una no su al lo como "
    "le et les des une du est dans pour qui au sur pas plus il ne "
    "der die und das von zu den mit ist des sich auf für im dem nicht ein eine als auch").split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``least`` * of <= count <= ``most`` * of; either bound may be open, and 0 of 0 passes."""

    name: str
    count: str
    of: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Counts are columns of ``measured``.
RULES = (
    Rule("word length", "word_chars", "n_words", 1.5, 20.0),
    Rule("symbols", "n_symbols", "n_words", most=0.25),
    Rule("exclamation marks", "n_exclamations", "n_words", most=0.25),
    Rule("shouted words", "n_shouted", "n_words", most=0.4),
    Rule("stuttered words", "n_stuttered", "n_words", most=0.2),
    Rule("stop words", "n_stop_words", "n_words", least=0.03),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=0.3),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more in the text."""

    def starts(ordered: Column) -> Column:
        """Places of the windows that stand next to an equal one in the order."""
        same = lambda x, i: F.coalesce(F.get(ordered, i)["w"] == x["w"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
                           F.lit(0), lambda total, x: total + x)

    def counted(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(_let(ordered, starts), covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    return F.when(F.size(words) < WINDOW, 0).otherwise(_let(_let(hashes, windows), counted))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus the counts the rules read; a null text counts as empty, and all counts of an empty text are zero.
    Columns of ``df`` that are called like a count are replaced.

    Words are runs of other than ASCII white space; lines end at line feeds and count if they have a word.
    """
    words, lines, body = fresh(df, "_words"), fresh(df, "_lines"), F.coalesce(q(text), F.lit(""))
    without = lambda letters: F.char_length(body) - F.char_length(F.translate(body, letters, ""))
    count = lambda array, test: F.size(F.filter(array, test))
    stop_words = F.array(*map(F.lit, STOP_WORDS))
    split = df.withColumns({
        words: F.filter(F.split(body, "[ \\t-\\r]+"), lambda w: w != ""),
        lines: F.filter(F.split(body, "\n"), lambda line: F.translate(line, BLANKS, "") != "")})
    bare = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))
    return split.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.translate(body, BLANKS, "")).cast("long"),
        "n_symbols": without(SYMBOLS).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(F.col(words)).cast("long"),
        "n_exclamations": without("!").cast("long"),
        "n_shouted": count(words, lambda w: (F.char_length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)).cast("long"),
        "n_stuttered": count(words, lambda w, i: F.coalesce(F.get(F.col(words), i + 1) == w, F.lit(False))).cast("long"),
        "n_stop_words": count(words, lambda w: F.array_contains(stop_words, bare(w))).cast("long"),
    }).drop(words, lines)


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One condition for a whole threshold table."""
    passed = F.lit(True)
    for rule in rules:
        count, of = q(rule.count), q(rule.of)
        if rule.least is not None:
            passed &= count >= F.lit(rule.least) * of
        if rule.most is not None:
            passed &= count <= F.lit(rule.most) * of
    return passed


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, least_words: int = 20,
           most_repeated: int = 30) -> DataFrame:
    """``measured`` plus base_failed (too few words, or over ``most_repeated`` per cent of them repeated) and kept."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return measured(df, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))
