"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of warm seconds."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright import queries as engine
from barwright.model import Series
from barwright.operators import bars, bricks, long, recursive, rolling, totals

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LONG = Series(("key",), ("ts", "a", "b"))


def long_series(spark: SparkSession) -> DataFrame:
    """lineitem as candles: price = extendedprice / quantity, series by return flag (600,000 rows at sf0.1)."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.col("l_returnflag").alias("key"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"),
        price.alias("close"), (price * 1.01).alias("high"), (price * 0.99).alias("low"), F.col("l_quantity").alias("volume"),
    )


def ticks(spark: SparkSession) -> DataFrame:
    return engine.ticks(spark, SF)


T = engine.TICKS
#: Those that run on the long series.
LONG_QUERIES = ("atr", "rsi", "stochastic", "cci", "tsi", "roc", "aroon", "elder_ray", "hma", "obv", "vwap", "batch", "rsi_blocked")
QUERIES = {
    "atr": lambda s: recursive.atr(long_series(s), LONG),
    "rsi": lambda s: recursive.rsi(long_series(s), LONG),
    "stochastic": lambda s: rolling.stochastic(long_series(s), LONG),
    "cci": lambda s: rolling.cci(long_series(s), LONG),
    "tsi": lambda s: recursive.tsi(long_series(s), LONG),
    "roc": lambda s: rolling.roc(long_series(s), LONG),
    "aroon": lambda s: rolling.aroon(long_series(s), LONG),
    "elder_ray": lambda s: recursive.elder_ray(long_series(s), LONG),
    "hma": lambda s: rolling.hma(long_series(s), LONG),
    "obv": lambda s: totals.obv(long_series(s), LONG),
    "vwap": lambda s: totals.vwap(long_series(s), LONG),
    "batch": lambda s: recursive.indicators_batch(long_series(s), LONG),
    "rsi_blocked": lambda s: long.rsi(long_series(s), LONG, rows=50_000),
    "time_bars": lambda s: bars.time_bars(ticks(s), T, "1h"),
    "tick_bars": lambda s: bars.tick_bars(ticks(s), T, 100),
    "volume_bars": lambda s: bars.volume_bars(ticks(s), T, 5000),
    "range_bars": lambda s: bars.range_bars(ticks(s), T, 60.0),
    "kagi": lambda s: bars.kagi(ticks(s), T, amount=40.0),
    "line_break": lambda s: bars.three_line_break(ticks(s), T),
    "renko": lambda s: bricks.renko(engine.candles(s, SF), engine.BARS),
    "volume_profile": lambda s: engine.queries()["volume_profile"](s, SF),
    "daily_sma": lambda s: engine.daily_sma(s, SF),
    "dashboard": lambda s: engine.queries()["dashboard"](s, SF),
    "charts_png": lambda s: engine.queries()["charts_png"](s, SF),
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, made in QUERIES.items():
        took = []
        for _ in range(2):
            began = time.perf_counter()
            made(spark).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(min(took), 3)
    rows = long_series(spark).count()
    on_long = [name for name in LONG_QUERIES if name in seconds]
    speed = {name: round(rows / seconds[name]) for name in on_long}
    print(json.dumps({"metric": "total of warm query times", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF, "long_series_rows": rows, "rows_per_second": speed}))
    spark.stop()


if __name__ == "__main__":
    main()
