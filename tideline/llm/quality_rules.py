"""Quality rules: a table of thresholds compiled into one projection.

A rule bounds one measured count, or its percentage of another count. ``verdict`` turns a table of rules into a single
Boolean column, ``measures`` gives the counts; both are Spark expressions, so a text is read once, in the task that
scans it, and nothing is shuffled. The words of a text are made once and handed to every measure.

Repeated words: a window of three words is looked up among the windows of the same text by sorting their hashes and
places, then those of equal hash by their words, so the work for w words is w log w however often a window repeats and
a hash never decides. Texts whose windows all have different hashes skip both.

Edge cases: a null text counts as empty. Texts without words have all counts 0 and fail. Lines without a word are no
lines here. Rows are judged one by one, so repeated rows and ties of any kind are equal rows with equal verdicts. An
empty table gives no rows. ``judge`` returns its own columns only, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import BLANK, words

WINDOW = 3
#: Texts with fewer words, or with more than this percentage of words in repeated windows, fail before any rule.
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it that this be are was for on with as by an or not "
    "der die das und ist ein eine in den von zu mit auf sich für im nicht als auch des "
    "le la les de des du un une et est que qui pour dans par sur au en ne pas "
    "el los las del y que en una por con para es se su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``least`` and ``most`` bound ``part``: in percent of ``whole``, or as a count where that is None."""

    name: str
    part: str
    whole: str | None = None
    least: int | None = None
    most: int | None = None

    def holds(self) -> Column:
        """Whole numbers only, so no rounding decides."""
        value, unit = (F.col(self.part), F.lit(1)) if self.whole is None else (100 * F.col(self.part), F.col(self.whole))
        bounds = [value >= self.least * unit] if self.least is not None else []
        bounds += [value <= self.most * unit] if self.most is not None else []
        return reduce(and_, bounds, F.lit(True))


RULES = (
    Rule("word count", "n_words", least=50, most=200_000),
    Rule("mean word length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("words with a letter", "n_letter_words", "n_words", least=70),
    Rule("words in capitals", "n_capital_words", "n_words", most=50),
    Rule("stop words", "n_stop_words", "n_words", least=2),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=50),
    Rule("repeated words", "n_repeat_words", "n_words", most=50),
    Rule("bullet lines", "n_bullet_lines", "n_lines", most=90),
    Rule("cut lines", "n_cut_lines", "n_lines", most=30),
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def window_starts(ws: Column) -> Column:
    return F.sequence(F.lit(0), F.size(ws) - WINDOW)


def covered(starts: Column) -> Column:
    """Words that windows at these ascending places cover."""
    steps = F.transform(starts, lambda s, k: F.least(F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def with_equals(at: Column, name: Callable[[Column], Column]) -> Column:
    """Those of the places, ascending, whose name another one of them has too."""

    def sharing(sorted_names: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce(x["name"] == y["name"], F.lit(False))

        def near(x: Column, k: Column) -> Column:
            return same(x, F.get(sorted_names, k - 1)) | same(x, F.get(sorted_names, k + 1))

        return F.sort_array(F.transform(F.filter(sorted_names, near), lambda x: x["i"]))

    return bound(F.sort_array(F.transform(at, lambda i: F.struct(name(i).alias("name"), i.alias("i")))), sharing)


def repeated_words(ws: Column) -> Column:
    """Words in windows that occur more than once in the text."""
    near = lambda i: [F.get(ws, i + j) for j in range(WINDOW)]
    hashed = lambda i: F.xxhash64(*near(i))
    joined = lambda i: F.concat_ws(" ", *near(i))

    def compared(at: Column) -> Column:
        return bound(with_equals(at, hashed), lambda some: bound(with_equals(some, joined), covered))

    def count(at: Column) -> Column:
        different = F.size(F.array_distinct(F.transform(at, hashed))) == F.size(at)
        return F.when(different, F.lit(0)).otherwise(compared(at))

    return F.when(F.size(ws) <= WINDOW, F.lit(0)).otherwise(bound(window_starts(ws), count))


def _count(holds: Column) -> Column:
    return F.size(holds).cast("long")


def word_measures(text: Column, ws: Column) -> dict[str, Column]:
    capital = lambda w: w.rlike(r"^\P{Ll}*\p{Lu}\P{Ll}*$")
    bare = lambda w: F.lower(F.trim(w, F.lit(".,;:!?\"'()")))
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_letter_words": _count(F.filter(ws, lambda w: w.rlike(r"\p{L}"))),
        "n_capital_words": _count(F.filter(ws, capital)),
        "n_stop_words": _count(F.filter(ws, lambda w: bare(w).isin(STOP_WORDS))),
        "n_repeat_words": repeated_words(ws).cast("long"),
    }


def line_measures(lines: Column) -> dict[str, Column]:
    cut = lambda x: x.endswith("...") | x.endswith("…")
    return {
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_bullet_lines": _count(F.filter(lines, lambda x: x.rlike(f"^(?:{BLANK})?[-*•‣◦]"))),
        "n_cut_lines": _count(F.filter(lines, lambda x: cut(F.rtrim(x, F.lit(" \t\x0b\x0c\r"))))),
    }


def measures(text: Column) -> Column:
    """A struct of all counts of a text."""
    filled = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(filled, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def struct(found: dict[str, Column]) -> Column:
        return F.struct(*[c.alias(n) for n, c in found.items()])

    by_word = bound(words(text), lambda ws: struct(word_measures(filled, ws)))
    by_line = bound(lines, lambda ls: struct(line_measures(ls)))
    return F.struct(by_word.alias("w"), by_line.alias("l"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def verdict(rules: Sequence[Rule] = RULES) -> Column:
    """Whether every rule holds, over the columns that ``measures`` gives."""
    return reduce(and_, [r.holds() for r in rules], F.lit(True))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, all counts, base_failed, failed (names of broken rules, in their order) and kept."""
    # A generator of one row: what comes after reads the counts and does not make them again.
    counted = docs.select(F.col(key).alias("doc_id"), F.inline(F.array(measures(F.col(text))))).select("doc_id", "w.*", "l.*")
    broken = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]))
    return counted.withColumns({"base_failed": base_failed(), "failed": broken, "kept": ~base_failed() & verdict(rules)})
