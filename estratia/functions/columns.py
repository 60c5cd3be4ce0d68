"""Scalar recodes, classes, keys, intervals and text formats as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _chain(cases: Iterable[tuple[Column, object]], other=None) -> Column:
    expr = None
    for condition, value in cases:
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    return expr.otherwise(other)


def clean(c: str | Column) -> Column:
    """Double with NaN turned into NULL, so that one test covers every missing number."""
    value = _col(c).cast("double")
    return F.when(~F.isnan(value), value)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def in_set(c: str | Column, values: Sequence) -> Column:
    """Membership that is FALSE, never NULL, for a missing value."""
    return F.coalesce(_col(c).isin(*values), F.lit(False))


def recode(c: str | Column, groups: Mapping[str, Sequence], other: str | None = None) -> Column:
    """Label whose list holds the value; ``other`` for any value in no list."""
    return _chain([(_col(c).isin(*values), F.lit(label)) for label, values in groups.items()], F.lit(other))


def band_by_edition(c: str | Column, year: str | Column, scales: Mapping[int, Mapping[str, Sequence]]) -> Column:
    """Ordinal code to band, with the scale that belongs to the row's edition."""
    return _chain([(_col(year) == edition, recode(c, bands)) for edition, bands in scales.items()])


def normalise_enum(c: str | Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """Trimmed, lower-case text matched against lists of synonyms."""
    return recode(F.lower(F.trim(_col(c).cast("string"))), synonyms)


def coalesce_optional(df: DataFrame, names: Sequence[str], fn, type_name: str = "string") -> Column:
    """First non-null ``fn(column)`` over the names that the frame has."""
    present = [fn(F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast(type_name)


def matching_columns(df: DataFrame, pattern: str, expected: int | None = None) -> list[str]:
    """Column names that match the whole pattern, checked against an expected number."""
    names = [c for c in df.columns if re.fullmatch(pattern, c)]
    if expected is not None and len(names) != expected:
        raise ValueError(f"{len(names)} columns match {pattern!r}, expected {expected}")
    return names


def row_mean(df: DataFrame, pattern: str, expected: int | None = None) -> Column:
    """Mean over the matching columns of a row, missing ones left out; NULL if all are missing.

    The values are folded from an array: written out column by column, three means of ten values make a
    generated method that the JVM no longer compiles and so interprets row by row.
    """
    names = matching_columns(df, pattern, expected)
    known = F.filter(F.array(*[F.col(f"`{c}`").cast("double") for c in names]), lambda x: x.isNotNull() & ~F.isnan(x))
    return _let(known, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda s, x: s + x) / F.size(k)))


def composite_key(parts: Sequence[str | Column], sep: str = "_", defaults: Mapping[int, str] | None = None) -> Column:
    """Joined text key; a missing part becomes its default or the text ``NA``."""
    defaults = defaults or {}
    return F.concat_ws(
        sep, *[F.coalesce(_col(p).cast("string"), F.lit(defaults.get(i, "NA"))) for i, p in enumerate(parts)]
    )


def strip_suffix(c: str | Column, pattern: str) -> Column:
    return F.regexp_replace(_col(c), pattern, "")


def collapse(c: str | Column, groups: Mapping[str, Sequence[str]], other: str) -> Column:
    """Recode where every value outside the lists is ``other`` and NULL stays NULL; the value is worked out once."""
    return _let(_col(c), lambda x: F.when(x.isNotNull(), recode(x, groups, other)))


def pair_class(a: str | Column, b: str | Column, table: Mapping[tuple[str, str], str]) -> Column:
    return _chain([((_col(a) == x) & (_col(b) == y), F.lit(label)) for (x, y), label in table.items()])


def congruence(a: str | Column, b: str | Column, same: str, different: str) -> Column:
    """Whether two classes agree; NULL when either is missing."""
    return F.when(_col(a) == _col(b), F.lit(same)).when(_col(a) != _col(b), F.lit(different))


def threshold_class(
    dominant: str | Column, share: str | Column, threshold: float | Column, base: str, labels: Sequence[str]
) -> Column:
    """Base-dominant, other-dominant or mixed, by whether the share reaches the threshold."""
    base_label, other_label, mixed_label = labels
    reached = _col(share) >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))
    return (
        F.when(reached & (_col(dominant) == base), F.lit(base_label))
        .when(reached & (_col(dominant) != base), F.lit(other_label))
        .otherwise(F.lit(mixed_label))
    )


def strata_label(parts: Sequence[str | Column], sep: str = ".") -> Column:
    """Intersection of several categories; NULL when any of them is missing."""
    whole = reduce(lambda x, y: x & y, [_col(p).isNotNull() for p in parts])
    return F.when(whole, F.concat_ws(sep, *[_col(p) for p in parts]))


def level_index(c: str | Column, levels: Sequence[str]) -> Column:
    """1-based position in a declared level list; NULL for a value outside it."""
    return _chain([(_col(c) == level, F.lit(i + 1)) for i, level in enumerate(levels)])


def block_index(code: str | Column, block: str | Column, n_codes: int) -> Column:
    return _col(code) + (_col(block) - 1) * F.lit(n_codes)


def standardise(c: str | Column, mean: float, sd: float) -> Column:
    return (_col(c) - F.lit(float(mean))) / F.lit(float(sd))


def indicator(c: str | Column, value: str) -> Column:
    return F.when(_col(c) == value, F.lit(1)).otherwise(F.lit(0))


def significance(lo: str | Column, hi: str | Column) -> Column:
    """positivo, negativo or n.s. by the side of zero that the interval lies on."""
    return F.when(_col(lo) > 0, F.lit("positivo")).when(_col(hi) < 0, F.lit("negativo")).otherwise(F.lit("n.s."))


def excludes_zero(lo: str | Column, hi: str | Column) -> Column:
    """TRUE unless zero lies strictly inside; a bound of exactly zero counts as excluded."""
    return ~((_col(lo) < 0) & (_col(hi) > 0))


def label_by_pattern(c: str | Column, patterns: Mapping[str, str], other: str | Column | None = None) -> Column:
    """Label of the first regular expression found in the text."""
    return _chain(
        [(_col(c).rlike(p), F.lit(label)) for p, label in patterns.items()],
        other if isinstance(other, Column) else F.lit(other),
    )


def label_of(c: str | Column, labels: Mapping[str, str]) -> Column:
    return recode(c, {label: [code] for code, label in labels.items()})


def fixed_text(c: str | Column, digits: int = 1, plus: bool = False) -> Column:
    """The number with 0 or 1 decimals, rounded half-even from its exact binary value; NULL unless finite.

    Ten times the number is 8x + 2x, two exact products, so their sum and what rounding the sum lost
    tell a true half from a number beside it. ``plus`` writes the sign of positive numbers as well.
    """
    if digits not in (0, 1):
        raise ValueError("numbers are written with 0 or 1 decimals")

    def lost(x: Column, scaled: Column) -> Column:
        big, small = x * F.lit(8.0), x * F.lit(2.0)
        return _let(scaled - big, lambda part: (big - (scaled - part)) + (small - part)) if digits else F.lit(0.0)

    def whole(x: Column, scaled: Column) -> Column:
        half = F.abs(scaled - F.floor(scaled)) == 0.5
        beside = lambda off: F.when(half & (off > 0), F.ceil(scaled)).when(half & (off < 0), F.floor(scaled))
        return F.coalesce(_let(lost(x, scaled), beside), F.bround(scaled, 0).cast("long"))

    def text(x: Column) -> Column:
        size = _let(x * F.lit(8.0) + x * F.lit(2.0) if digits else x, lambda scaled: F.abs(whole(x, scaled)).cast("string"))
        if digits:
            size = _let(F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")), lambda t: F.concat(F.left(t, F.length(t) - 1), F.lit("."), F.right(t, F.lit(1))))
        sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit("+" if plus else ""))
        return F.when(F.abs(x) < float("inf"), F.concat(sign, size))

    return _let(_col(c).cast("double"), text)


def _interval_text(est: Column, lo: Column, hi: Column, after: str = "") -> Column:
    end = F.lit(after)
    return F.concat(est, end, F.lit(" ["), lo, end, F.lit(", "), hi, end, F.lit("]"))


def format_effect(est: str | Column, lo: str | Column, hi: str | Column) -> Column:
    """``+e [+lo, +hi]``, marked when zero lies strictly inside the interval."""
    text = _interval_text(*[fixed_text(x, 1, plus=True) for x in (est, lo, hi)])
    return F.concat(text, F.when(excludes_zero(lo, hi), F.lit("")).otherwise(F.lit(" (n.s.)")))


def format_percent_interval(est: str | Column, lo: str | Column, hi: str | Column, digits: int = 1) -> Column:
    return _interval_text(*[fixed_text(_col(x) * F.lit(100.0), digits) for x in (est, lo, hi)], after="%")


def format_percent(c: str | Column, digits: int = 1) -> Column:
    return F.concat(fixed_text(_col(c) * F.lit(100.0), digits), F.lit("%"))


def format_points_difference(c: str | Column) -> Column:
    return F.concat(fixed_text(c, 1, plus=True), F.lit(" pp"))


def with_points(df: DataFrame, sd: float, columns: Sequence[str] = ("estimate", "ci_low", "ci_high")) -> DataFrame:
    """Adds each column times the score standard deviation, as ``<column>_puntos``."""
    return df.select("*", *[(F.col(c) * F.lit(float(sd))).alias(f"{c}_puntos") for c in columns])


def round_columns(df: DataFrame, columns: Iterable[str], digits: int) -> DataFrame:
    wanted = set(columns)
    quoted = {c: F.col(f"`{c}`") for c in df.columns}
    return df.select(*[F.round(q, digits).alias(c) if c in wanted else q for c, q in quoted.items()])


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds every double column, leaving the others alone."""
    return round_columns(df, [n for n, t in df.dtypes if t == "double"], digits)
