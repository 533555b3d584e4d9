"""Numeric expressions. All of them are native columns; doubles stay doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lowest percentiles of grades 1 to 8.
GRADE_FLOORS = (96, 89, 77, 60, 40, 23, 11, 4)


def round2(x: Column) -> Column:
    """Two decimals, halves towards plus infinity."""
    return F.floor(x * 100 + 0.5) / 100


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def grade_of_percentile(x: Column) -> Column:
    out = F.lit(9)
    for grade, floor in reversed(list(enumerate(GRADE_FLOORS, 1))):
        out = F.when(x >= floor, F.lit(grade)).otherwise(out)
    return out


def int_prefix(text: Column) -> Column:
    """The integer a text begins with, else null."""
    return F.regexp_extract(F.trim(text), r"^[+-]?[0-9]+", 0).try_cast("int")


def float_prefix(text: Column) -> Column:
    """The decimal number a text begins with, else null."""
    return F.regexp_extract(F.trim(text), r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0).try_cast("double")


def first_number(text: Column) -> Column:
    """The first numeric token once commas are gone, else null."""
    return F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def number_tokens(text: Column, most: int = 3) -> Column:
    """Up to `most` numbers of a cell; a ratio `a:b` counts as a / b, or a when b is 0."""
    plain = F.regexp_replace(text, ",", "")
    ratio = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*:\s*([0-9]+(?:\.[0-9]+)?)"
    a, b = (F.regexp_extract(plain, ratio, i).try_cast("double") for i in (1, 2))
    found = F.transform(F.regexp_extract_all(plain, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1), lambda x: x.try_cast("double"))
    return F.when(plain.rlike(ratio), F.array(F.when(b == 0, a).otherwise(a / F.nullif(b, F.lit(0.0))))).otherwise(F.slice(found, 1, most))


def less_than_score(text: Column, marker: str) -> Column:
    """struct(value, operator) of a score cell; with the marker word the operator is `lt`, else `eq`."""
    value = first_number(text)
    return F.struct(value.alias("value"), F.when(value.isNull(), F.lit(None)).when(text.contains(marker), "lt").otherwise("eq").alias("operator"))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y", "t"), F.lit(False))


# --- fixed values: the rational approximation of the normal quantile (Acklam) and of erf (Abramowitz and Stegun 7.1.26) ---
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# --- end of fixed values ---
QUANTILE_TAIL = 0.02425


def _horner(x: Column, terms) -> Column:
    out = F.lit(terms[0])
    for t in terms[1:]:
        out = out * x + t
    return out


def probit(p: Column) -> Column:
    """The normal quantile of a probability within (0, 1)."""
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    tail = lambda q: _horner(q, QUANTILE_C) / _horner(q, (*QUANTILE_D, 1.0))
    q = p - 0.5
    middle = _horner(q * q, QUANTILE_A) * q / _horner(q * q, (*QUANTILE_B, 1.0))
    return F.when(p < QUANTILE_TAIL, tail(low)).when(p > 1 - QUANTILE_TAIL, -tail(high)).otherwise(middle)


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF_P * x)
    erf = 1 - _horner(t, (*reversed(ERF_A), 0.0)) * F.exp(-x * x)
    return F.when(z < 0, 0.5 * (1 - erf)).otherwise(0.5 * (1 + erf))


def composite_percentile(parts: list[tuple[Column, float]], low: float = 0.6, high: float = 99.4) -> Column:
    """Percentiles with weights to one percentile: clamped, turned into z, averaged by weight, turned back; nulls drop out."""
    total = sum((F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for p, w in parts), F.lit(0.0))
    z = sum((F.coalesce(probit(clamp(p, low, high) / 100) * w, F.lit(0.0)) for p, w in parts), F.lit(0.0))
    return F.when(total > 0, normal_cdf(z / F.nullif(total, F.lit(0.0))) * 100)
