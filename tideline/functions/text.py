"""Keyword tagging of recommendation texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_text(c: Column, words: dict[str, list[str]], none: str) -> Column:
    """Sorted distinct tags whose words occur in the text, joined by '; '.

    The text is searched once per word, as bytes; pass a column, not a long
    expression, since each search names it again.
    """
    hits = [F.when(reduce(or_, [c.contains(w) for w in words[tag]]), F.lit(tag)) for tag in sorted(words)]
    joined = F.concat_ws("; ", *hits)
    return F.when(joined != "", joined).otherwise(F.lit(none))
