"""Guards against zero denominators, missing columns, missing values and out-of-range numbers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to ``[low, high]``; null stays null (``greatest``/``least`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def ratio(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """``numerator / denominator``, or ``default`` when the denominator is zero or either side is missing."""
    quotient = F.try_divide(numerator, denominator)
    return quotient if default is None else F.coalesce(quotient, F.lit(default))


def positive_or(value: Column, floor: float) -> Column:
    """Replace values that are not above zero by ``floor``."""
    return F.when(value <= 0, F.lit(floor)).otherwise(value)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def ensure_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add each missing column as a constant; columns that exist are left alone."""
    missing = {name: F.lit(v) for name, v in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def fill_columns(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.fillna(dict(values))


def drop_null_keys(df: DataFrame, keys: tuple[str, ...] = ("close_usd", "date")) -> DataFrame:
    return df.na.drop(subset=list(keys))
