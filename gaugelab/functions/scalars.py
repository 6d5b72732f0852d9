"""Small Column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITESPACE = " \t\n\r\x0b\x0c"


def capitalised_label(col: Column) -> Column:
    """Trim, first letter upper, rest lower; a missing label becomes the text ``Nan``."""
    text = F.trim(F.coalesce(col.cast("string"), F.lit("nan")), F.lit(_WHITESPACE))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**30)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def clip_physical(feature: str, col: Column) -> Column:
    """Keep a perturbed reading plausible: a ceiling for humidity, a floor for light."""
    from gaugelab.fixed_values import HUMIDITY_CEILING, LIGHT_FLOOR

    if feature == "Humidity":
        return F.when(col > HUMIDITY_CEILING, HUMIDITY_CEILING).otherwise(col)
    if feature == "Light":
        return F.when(col < LIGHT_FLOOR, LIGHT_FLOOR).otherwise(col)
    return col


def digamma(col: Column) -> Column:
    """Digamma for positive arguments: shift by six, then the asymptotic series."""
    x = col.cast("double")
    shift = sum((1.0 / (x + float(i)) for i in range(1, 6)), 1.0 / x)
    z = x + 6.0
    z2 = z * z
    return (
        F.log(z) - 0.5 / z - 1.0 / (12.0 * z2) + 1.0 / (120.0 * z2 * z2)
        - 1.0 / (252.0 * z2 * z2 * z2) + 1.0 / (240.0 * z2 * z2 * z2 * z2) - shift
    )


def nan_to_null(df, columns):
    """NaN counts as missing everywhere; Spark would treat it as the largest value."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
