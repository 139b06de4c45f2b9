"""Scalar rules of the domain as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

VALID_GRADES = ("A", "AA", "AAA", "BBB")
PENDING_GRADES = ("BB",)
DEFAULT_READ_DATE = "2022-04-19"

LOW_IMPACT = "LOW IMPACT / COMPLIANT"
MODERATE_IMPACT = "MODERATE IMPACT / ATTENTION"
CRITICAL_IMPACT = "CRITICAL IMPACT / ALERT"
# Decimals of the exact part of a sum: ten keep every cent-based value whole. What is finer, and values from LIMIT on, are
# summed as doubles beside it, so that nothing is lost and nothing overflows.
PLACES = 10
LIMIT = 1e11
NOISE = 2.0**-50


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def pseudo_tax_id(seed: Column | str) -> Column:
    """Fourteen digits of the SHA-1 of ``seed``, masked as dd.ddd.ddd/dddd-dd."""
    digits = F.rpad(F.translate(F.sha1(_col(seed)), "abcdef", ""), 14, "0")
    cut = [F.substring(digits, at, n) for at, n in ((1, 2), (3, 3), (6, 3), (9, 4), (13, 2))]
    a, b, c, d, e = cut
    return F.concat(a, F.lit("."), b, F.lit("."), c, F.lit("/"), d, F.lit("-"), e)


def status_from_grade(grade: Column | str) -> Column:
    """Letter grade to review status; an unknown or missing grade is a rejection."""
    g = F.upper(F.trim(_col(grade)))
    return F.when(g.isin(*VALID_GRADES), "VALIDATED").when(g.isin(*PENDING_GRADES), "PENDING").otherwise("REJECTED")


def processing_date(text: Column | str, default: str = DEFAULT_READ_DATE) -> Column:
    """Day-month-year text to a date; what does not parse gets ``default``."""
    return F.coalesce(F.try_to_date(_col(text), "d-M-yyyy"), F.lit(default).cast("date"))


def impact_class(value: Column | str, low: float = 100.0, moderate: float = 500.0) -> Column:
    """Three impact classes, both limits closed above; NULL falls into the last class."""
    v = _col(value)
    return F.when(v <= low, LOW_IMPACT).when(v <= moderate, MODERATE_IMPACT).otherwise(CRITICAL_IMPACT)


def blank_keeps(new: Column | str, old: Column | str) -> Column:
    """Partial update: NULL or blank text leaves the old value in place."""
    return F.coalesce(F.nullif(_col(new), F.lit("")), _col(old))


def one_place(value: Column | str) -> Column:
    """Round half to even at one decimal place."""
    return F.rint(_col(value) * 10) / 10


def month_of(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def weighted_count(weight: Column | str, when: Column | None = None) -> Column:
    w = _col(weight)
    return F.coalesce(F.sum(w if when is None else F.when(when, w)), F.lit(0)).cast("bigint")


def exact_parts(value: Column | str, weight: Column | str | None = None, places: int = PLACES) -> tuple[Column, Column]:
    """A sum in two parts; NaN counts as missing. NULL for no values is in the second part only.

    The first holds the addends below ``LIMIT`` to ``places`` as decimals, the second what that leaves of each, as doubles.
    Values of at most ``places`` decimals below ``LIMIT`` leave nothing, so their sum does not depend on the order; nor do
    those that miss such a number by the last bits of a double.
    """
    v = nan_to_null(_col(value).cast("double"))
    near = F.when(F.abs(v) < LIMIT, v).cast(f"decimal({11 + places},{places})")
    left = v - F.coalesce(near.cast("double"), F.lit(0.0))
    rest = F.when(near.isNotNull() & (F.abs(left) <= F.abs(v) * NOISE), 0.0).otherwise(left)
    if weight is not None:
        near, rest = near * _col(weight).cast("decimal(10,0)"), rest * _col(weight)
    return F.sum(near), F.sum(rest)


def whole_sum(near: Column, rest: Column) -> Column:
    """One double of the two parts of a sum; NULL if there were no values."""
    return F.coalesce(near.cast("double"), F.lit(0.0)) + rest


def weighed_parts(near: Column, rest: Column, weight: Column | str) -> tuple[Column, Column]:
    """Both parts of a sum times a weight; what would not fit a decimal goes to the second."""
    w = _col(weight)
    product = near.try_cast("decimal(30,10)") * w.try_cast("decimal(7,0)")
    beyond = F.coalesce(F.when(product.isNull(), near.cast("double") * w), F.lit(0.0))
    return product, rest * w + beyond


def exact_sum(value: Column | str, weight: Column | str | None = None, places: int = PLACES) -> Column:
    """Sum as a double, see ``exact_parts``; NULL for no values."""
    return whole_sum(*exact_parts(value, weight, places))


def exact_count(value: Column | str) -> Column:
    """How many values ``exact_sum`` adds: neither NULL nor NaN."""
    return F.count(nan_to_null(_col(value).cast("double")))


def exact_mean(
    value: Column | str, weight: Column | str | None = None, when: Column | None = None, places: int = PLACES
) -> Column:
    """Mean of the values that are neither NULL nor NaN, the same under any partitioning; NULL for no values."""
    v = nan_to_null((_col(value) if when is None else F.when(when, _col(value))).cast("double"))
    if weight is None:
        n = F.count(v)
    else:
        n = F.sum(F.when(v.isNotNull(), _col(weight)))
    return F.try_divide(exact_sum(v, weight, places), n.cast("double"))
