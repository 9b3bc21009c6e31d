"""What the engine raises. Parameter errors come when a plan is built, never from a task."""


from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import DataFrame


class EngineError(Exception):
    """Base of the engine's own errors."""


class DataValidationError(EngineError, ValueError):
    """A frame lacks a column, or its rows cannot be used."""


class ConfigurationError(EngineError, ValueError):
    """A parameter is out of range or unknown."""


def positive(**values: float) -> None:
    for name, v in values.items():
        if not v > 0:
            raise ConfigurationError(f"{name} must be positive, got {v}")


def period(**values: int) -> None:
    for name, v in values.items():
        if isinstance(v, bool) or not isinstance(v, int) or v < 1:
            raise ConfigurationError(f"{name} must be a whole number from 1, got {v!r}")


def not_negative(**values: float) -> None:
    for name, v in values.items():
        if v < 0:
            raise ConfigurationError(f"{name} must not be negative, got {v}")


def enough_rows(df: DataFrame, keys: tuple[str, ...], least: int) -> None:
    """Raise where a series has fewer rows than ``least``, or there are none at all. One aggregation."""
    from pyspark.sql import functions as F

    short = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).orderBy("_n").first()
    if short is None or short["_n"] < least:
        raise DataValidationError(f"{least} rows are needed, a series has {0 if short is None else short['_n']}")
