"""Stage codes, flags and labels as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.fixed_values import STAGE_CODES, STAGE_CUTS, TOP_STAGE_WORD


def stage_from_value(v: Column, cuts: Sequence[float] = STAGE_CUTS) -> Column:
    """Number of cut points reached; a missing value is stage 0."""
    code = F.lit(0)
    for i, cut in enumerate(sorted(cuts), start=1):
        code = F.when(v >= cut, i).otherwise(code)
    return code


def stage_from_label(
    c: Column, codes: dict[str, int] | None = None, contains: dict[str, int] | None = None
) -> Column:
    """Trimmed label to code, then a substring fallback, then 0."""
    codes = STAGE_CODES if codes is None else codes
    contains = {TOP_STAGE_WORD: 3} if contains is None else contains
    pairs = [x for k, v in codes.items() for x in (F.lit(k), F.lit(v))]
    text = F.trim(c)
    found = F.create_map(*pairs)[text]
    partial = [F.when(text.contains(word), F.lit(code)) for word, code in contains.items()]
    return F.coalesce(found, *partial, F.lit(0))


def label_from_code(c: Column, names: Sequence[str]) -> Column:
    """Name of a code, clamped to the list; a missing code has no name."""
    inside = F.least(F.greatest(c.cast("int"), F.lit(0)), F.lit(len(names) - 1))
    return F.when(c.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in names]), inside + 1))


def exceeds(v: Column, cut: float) -> Column:
    return F.coalesce(v >= cut, F.lit(False))


def clamp(c: Column, lo: int, hi: int) -> Column:
    """Clamped value; null stays null (``least`` alone would return the bound)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def at_least(c: Column, n: int) -> Column:
    return (c >= n).cast("int")


def prob_band(p: Column, cuts: Sequence[float], names: Sequence[str]) -> Column:
    """Names of the bands below, between and above the cuts."""
    band = F.lit(names[0])
    for cut, name in zip(cuts, names[1:]):
        band = F.when(p >= cut, name).otherwise(band)
    return F.when(p.isNotNull(), band)
