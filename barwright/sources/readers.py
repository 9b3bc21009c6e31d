"""Readers of candles and ticks. All are lazy: filters and columns reach the scan."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataValidationError
from ..model import Series, without_nan

OHLCV = ("open", "high", "low", "close", "volume")
#: Columns of a trades file.
TRADES = "id long, price double, qty double, base_qty double, time long, is_buyer_maker boolean"


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Plain or partitioned by folders; ``where`` prunes partitions and row groups."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str | list[str], schema: str, rename: dict[str, str] | None = None, timestamps: dict[str, str] | None = None, header: bool = True) -> DataFrame:
    """With a given schema (never inferred); ``timestamps`` maps columns to their format."""
    df = spark.read.csv(path, schema=schema, header=header).withColumnsRenamed(rename or {})
    return df.withColumns({c: F.to_timestamp(F.col(c), form) for c, form in (timestamps or {}).items()})


def trades(spark: SparkSession, paths: str | list[str], header: bool = False) -> DataFrame:
    """Trade files (id, price, qty, base_qty, time in milliseconds, is_buyer_maker) as ticks: ts, id, price, volume."""
    return spark.read.csv(paths, schema=TRADES, header=header).select(F.timestamp_millis("time").alias("ts"), "id", "price", F.col("qty").alias("volume"))


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """``query`` runs in the database. With partitionColumn, lowerBound, upperBound and numPartitions it is read in parallel as a table."""
    where = {"dbtable": f"({query}) q"} if "partitionColumn" in options else {"query": query}
    return spark.read.format("jdbc").options(url=url, **where, **options).load()


def candles(spark: SparkSession, data: DataFrame | pd.DataFrame | dict[str, Any]) -> DataFrame:
    """Any frame with open, high, low, close in either capitalisation, other columns kept; absent volume is 1."""
    if isinstance(data, dict):
        data = pd.DataFrame(data)
    if isinstance(data, pd.DataFrame):
        named = data.index.name is not None or not isinstance(data.index, pd.RangeIndex)
        data = spark.createDataFrame(data.reset_index() if named else data)
    known = {c.lower(): c for c in data.columns}
    missing = [c for c in OHLCV[:4] if c not in known]
    if missing:
        raise DataValidationError(f"Column {', '.join(map(repr, missing))} not found in {data.columns}")
    df = data.withColumnsRenamed({known[c]: c for c in OHLCV if c in known})
    return df if "volume" in known else df.withColumn("volume", F.lit(1.0))


def moving_average(spark: SparkSession, series: pd.Series, n: int, kind: str = "sma") -> pd.Series:
    """A moving average of a pandas series, by the engine: kind is sma, ema, wma, hma, dema or tema. The index and its order stay."""
    from ..registry import operator

    if kind not in ("sma", "ema", "wma", "hma", "dema", "tema"):
        raise DataValidationError(f"kind must be sma, ema, wma, hma, dema or tema, got {kind!r}")
    values = pd.DataFrame({"at": range(len(series)), "close": series.to_numpy(dtype=float, na_value=float("nan"))})
    if values.empty:
        return pd.Series([], index=series.index, name=f"{kind}_{n}", dtype=float)
    df = without_nan(spark.createDataFrame(values), "close")
    made = operator(kind)(df, Series((), ("at",), None), n=n).orderBy("at").select(kind).toPandas()
    return pd.Series(made[kind].to_numpy(dtype=float, na_value=float("nan")), index=series.index, name=f"{kind}_{n}")


def excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet of candles. pandas reads it, for which it needs a library for such files."""
    try:
        data = pd.read_excel(path, sheet_name=sheet)
    except ImportError as e:
        raise DataValidationError(f"no library for spreadsheets is installed: {e}") from e
    return candles(spark, data)


def ticks_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as ticks: key, ts, event_id, price, volume."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"), (F.col("user_id") % 10 + 1).alias("volume"))


def klines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON candles, one a line: symbol, ts (ISO 8601), open, high, low, close, volume."""
    return spark.readStream.schema("symbol string, ts timestamp, open double, high double, low double, close double, volume double").json(path)
