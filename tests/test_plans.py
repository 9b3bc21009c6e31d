"""The plans are the ones meant: few exchanges, narrow scans, pushed filters."""

import re

from pyspark.sql import functions as F

from barwright.model import Series
from barwright.operators import bars, recursive, rolling
from barwright.sources import readers

SF = "/root/testdata/sf0.001"
S = Series(("l_returnflag",), ("l_shipdate", "l_orderkey", "l_linenumber"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def candles(spark):
    p = F.col("l_extendedprice")
    return readers.parquet(spark, f"{SF}/lineitem.parquet").select(*S.keys, *S.order, p.alias("close"), (p + 1).alias("high"), (p - 1).alias("low"), F.col("l_quantity").alias("volume"))


def count(what, text):
    return len(re.findall(rf"(?:^|[ +\-:|*()\d]){what}\b", text, re.M))


def test_batch_has_one_exchange_and_one_python_pass(spark):
    text = plan(recursive.indicators_batch(candles(spark), S))
    assert count("Exchange", text) == 1 and count("MapInArrow", text) == 1


def test_windows_share_an_exchange(spark):
    df = rolling.cmf(rolling.bollinger(rolling.stochastic(rolling.ichimoku(candles(spark), S), S), S), S)
    assert count("Exchange", plan(df)) == 1


def test_scan_reads_what_is_used(spark):
    text = plan(rolling.sma(candles(spark).select(*S.keys, *S.order, "close"), S))
    columns = re.search(r"FileScan parquet \[([^\]]*)\]", text)[1]
    assert {c.split("#")[0] for c in columns.split(",")} == {"l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"}


def test_filters_reach_the_scan(spark):
    text = plan(readers.parquet(spark, f"{SF}/lineitem.parquet", ["l_orderkey"], "l_quantity > 10"))
    assert "GreaterThan(l_quantity,10.0)" in text


def test_resampling_aggregates_before_it_moves_rows(spark):
    df = candles(spark).withColumn("open", F.col("close"))
    text = plan(bars.ohlc_resample(df, S, "1d"))
    assert count("Exchange", text) == 1 and "partial_min_by" in text
