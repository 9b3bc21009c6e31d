"""Hand-computed values and properties of the operators."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright import registry
from barwright.charts import draw, geometry
from barwright.charts.style import Style
from barwright.errors import ConfigurationError, DataValidationError
from barwright.functions import rowwise, tables
from barwright.model import Series, without_nan
from barwright.operators import bars, bricks, recursive, rolling, summaries, totals
from barwright.plans import recipes
from barwright.sources import readers, writers

S = Series((), ("idx",), None)


def frame(spark, /, **columns):
    n = len(next(iter(columns.values())))
    return spark.createDataFrame(pd.DataFrame({"idx": range(n), **columns}))


def column(df, name):
    return [None if r[0] is None else r[0] for r in df.orderBy("idx").select(name).collect()]


def close(got, wanted, tolerance=1e-8):
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted):
        assert (a is None) == (b is None), (got, wanted)
        assert a is None or math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance), (got, wanted)


H, L, C = [10.0, 12, 11, 13, 14], [8.0, 9, 10, 11, 12], [9.0, 11, 10, 12, 13]


def test_atr(spark):
    close(column(recursive.atr(frame(spark, high=H, low=L, close=C), S, 3), "atr"), [2.0, 2.33333333, 1.88888889, 2.25925926, 2.17283951], 1e-6)


def test_averages(spark):
    df = frame(spark, close=[1.0, 2, 3, 4, 5])
    close(column(rolling.sma(df, S, 3), "sma"), [None, None, 2, 3, 4])
    close(column(rolling.wma(df, S, 5), "wma")[-1:], [11 / 3])
    close(column(rolling.wma(frame(spark, close=[10.0, 20, 30, 40, 50, 60]), S, 3), "wma"), [None, None, 140 / 6, 200 / 6, 260 / 6, 320 / 6])


def test_long_wma_agrees_with_lags(spark):
    x = np.random.default_rng(1).normal(100, 5, 200)
    made = column(rolling.wma(frame(spark, close=x), S, 80), "wma")
    weights = np.arange(1, 81)
    close(made, [None] * 79 + [float(x[i - 79 : i + 1] @ weights / weights.sum()) for i in range(79, 200)])


def test_stochastic_and_williams(spark):
    df = frame(spark, high=H, low=L, close=[9.0, 11, 10.5, 12, 13])
    assert math.isclose(column(rolling.stochastic(df, S, 3), "stoch_k")[2], 62.5, rel_tol=1e-8)
    df = frame(spark, high=[110.0, 115, 120, 125, 130], low=[100.0, 105, 110, 115, 120], close=[105.0, 110, 115, 120, 125])
    close(column(rolling.williams_r(df, S, 3), "williams_r"), [None, None, -25, -25, -25])


def test_roc_and_swings(spark):
    p = [100.0, 102, 104, 106, 108, 110, 108, 106, 104, 102, 100]
    made = column(rolling.roc(frame(spark, close=p), S, 2), "roc")
    close([made[2], made[3], made[7]], [4.0, 400 / 102, -400 / 110])
    df = frame(spark, high=[10.0, 12, 11, 13, 14, 13, 12, 15, 14, 13, 12, 11], low=[8.0, 9, 10, 11, 12, 11, 10, 9, 8, 9, 10, 9])
    made = rolling.swing_points(df, S, 2)
    assert [i for i, x in enumerate(column(made, "swing_high")) if x] == [4, 7]
    assert [i for i, x in enumerate(column(made, "swing_low")) if x] == [8]


def test_vwap_and_obv(spark):
    df = frame(spark, high=[102.0, 103, 104, 105], low=[98.0, 99, 100, 101], close=[100.0, 101, 102, 103], volume=[1000] * 4)
    close(column(totals.vwap(df, S), "vwap"), [100, 100.5, 101, 101.5])
    df = frame(spark, close=[100.0, 101, 102, 101, 100], volume=[1000, 1500, 2000, 1800, 1200])
    close(column(totals.obv(df, S), "obv"), [0, 1500, 3500, 1700, 500])
    flags = frame(spark, high=[2.0] * 6, low=[1.0] * 6, close=[1.0, 2, 1, 2, 1, 2], volume=[1] * 6, a=[1, 0, 0, 0, 1, 0])
    assert math.isclose(column(totals.vwap_anchored(flags, S, "a"), "vwap")[4], 4 / 3)


def test_pivots_and_fibonacci(spark):
    r = frame(spark, high=[120.0, 120.0, 1.0], low=[110.0, 110.0, 2.0], close=[120.0, 110.0, 1.5]).withColumns(rowwise.pivot_points("high", "low", "close")).orderBy("idx").collect()
    close([r[0]["pp"], r[1]["pp"], r[2]["pp"]], [116 + 2 / 3, 113 + 1 / 3, None])
    row = frame(spark, high=[150.0], low=[100.0]).select(*rowwise.fibonacci_retracement("high", "low").values()).first()
    close(list(row), [150, 138.2, 130.9, 125, 119.1, 100])


def test_parabolic_sar(spark):
    df = frame(spark, high=[11.0, 12, 13, 12, 10], low=[9.0, 10, 11, 10, 8])
    close(column(recursive.parabolic_sar(df, S), "sar"), [9, 9, 9, 9.24, 13])


TICKS = Series((), ("ts",), None)


def ticks(spark, price, volume):
    ts = pd.date_range("2025-01-01 09:30", periods=len(price), freq="s")
    return spark.createDataFrame(pd.DataFrame({"ts": ts, "price": np.array(price, float), "volume": volume}))


def table(df):
    return [tuple(r) for r in df.orderBy("ts").select("open", "high", "low", "close", "volume").collect()]


def test_path_bars(spark):
    assert table(bars.range_bars(ticks(spark, [100, 101, 102.5, 102, 100, 99], [1] * 6), TICKS, 2.0)) == [(100, 102.5, 100, 102.5, 3), (102, 102, 100, 100, 2), (99, 99, 99, 99, 1)]
    assert table(bars.kagi(ticks(spark, [100, 101, 103, 102, 100, 101, 99], [1] * 7), TICKS, amount=2.0)) == [(100, 103, 100, 103, 4), (103, 103, 99, 99, 3)]
    assert table(bars.kagi(ticks(spark, [100] * 5, [1] * 5), TICKS, amount=2.0)) == []


def test_volume_bars_open_with_the_tick_that_crosses(spark):
    made = table(bars.volume_bars(ticks(spark, range(100, 110), [50] * 10), TICKS, 100))
    assert [r[4] for r in made] == [50, 100, 100, 100, 100, 50]


@pytest.mark.parametrize("chunk", [None, "minute"])
def test_tick_bars_conserve_volume(spark, chunk):
    df = ticks(spark, np.random.default_rng(3).normal(100, 1, 1000).tolist(), list(range(1000)))
    for size, count in ((100, 10), (7, 143), (10000, 1)):
        made = table(bars.tick_bars(df, Series((), ("ts",), chunk), size))
        assert len(made) == count and sum(r[4] for r in made) == sum(range(1000))
        assert all(r[1] >= max(r[0], r[3]) and r[2] <= min(r[0], r[3]) for r in made)


def test_line_break_conserves_volume(spark):
    df = ticks(spark, np.cumsum(np.random.default_rng(5).normal(0, 1, 500)).tolist(), [2] * 500)
    made = table(bars.three_line_break(df, TICKS))
    assert len(made) > 5 and sum(r[4] for r in made) == 1000
    assert len(table(bars.three_line_break(df, TICKS, compat=True))) == 1


def test_renko_and_point_and_figure(spark):
    df = frame(spark, high=[101.0, 104, 107, 104, 101, 99], low=[99.0, 101, 104, 102, 99, 97], close=[100.0, 103, 106, 103, 100, 98])
    made = bricks.renko(df, S, box=2.0).orderBy("brick").collect()
    assert [(r["price"], r["direction"]) for r in made] == [(102, 1), (104, 1), (106, 1), (104, -1), (102, -1), (100, -1), (98, -1)]
    df = frame(spark, high=[101.0, 104, 107, 110, 109, 106, 103, 100], low=[99.0, 102, 105, 108, 106, 103, 100, 97], close=[100.0, 103, 106, 109, 107, 104, 101, 98])
    made = bricks.point_and_figure(df, S, box=2.0).orderBy("column").collect()
    assert [(r["type"], r["start_idx"], r["boxes"]) for r in made] == [("X", 1, [102, 104, 106, 108, 110]), ("O", 5, [108, 106, 104, 102, 100, 98])]


def test_scan_is_the_same_in_any_batch_size(spark):
    rng = np.random.default_rng(9)
    close_ = 100 + np.cumsum(rng.normal(0, 0.5, 997))
    df = spark.createDataFrame(pd.DataFrame({"k": ["a", "b"] * 498 + ["a"], "idx": range(997), "high": close_ + 0.3, "low": close_ - 0.3, "close": close_, "volume": 1.0}))
    s = Series(("k",), ("idx",), None)

    def made():
        return recursive.adx(recursive.supertrend(recursive.indicators_batch(df, s), s), s).orderBy("idx").toPandas()

    one = made()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        pd.testing.assert_frame_equal(one, made(), rtol=1e-12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_missing_values_and_flat_prices(spark):
    df = without_nan(frame(spark, high=[1.0, math.nan, 1, 1, 1], low=[1.0] * 5, close=[1.0, math.nan, 1, 1, 1], volume=[0.0] * 5))
    assert column(rolling.sma(df, S, 2), "sma") == [None, None, None, 1, 1]
    assert column(totals.vwap(df, S), "vwap") == [None] * 5
    close(column(recursive.ema(df, S, 2), "ema"), [None, None, 1, 1, 1])
    assert column(rolling.stochastic(df, S, 2, 1), "stoch_k")[-1] == 0
    assert geometry.candles(df.withColumn("open", F.col("close")), S).count() == 5
    assert recursive.indicators_batch(df.where("idx < 0"), S).count() == 0


def test_statistics(spark):
    x = np.arange(20.0)
    df = frame(spark, x=x, y=3 * x**2 - 2 * x + 1)
    coefficients, fitted = summaries.polynomial_fit(df, "x", "y", 2)
    close(coefficients, [3, -2, 1], 1e-7)
    close(column(fitted, "fitted"), (3 * x**2 - 2 * x + 1).tolist(), 1e-7)
    fit = summaries.least_squares_fit(df, "x", "y").first()
    close([fit["slope"], fit["intercept"]], list(np.polyfit(x, 3 * x**2 - 2 * x + 1, 1)))
    profile = summaries.volume_profile(frame(spark, price=[5.0, 5, 5], volume=[1, 2, 3])).collect()
    assert [(r["level"], r["volume"], r["poc"]) for r in profile] == [(5, 6, 5)]


def test_errors_come_with_the_plan(spark):
    df = frame(spark, close=[1.0])
    for call in (
        lambda: rolling.sma(df, S, 0),
        lambda: bars.time_bars(df, S, "7m"),
        lambda: bars.kagi(df, S),
        lambda: bars.kagi(df, S, amount=1, share=0.1),
        lambda: recursive.parabolic_sar(df, S, start=2),
        lambda: recursive.keltner(df, S, 20, -1.0),
        lambda: summaries.group_aggregation(df, "idx", "close", "mode"),
        lambda: Style(width=5),
        lambda: Style(theme="pink"),
        lambda: rowwise.rgba("#12"),
        lambda: draw.render({}, "pie"),
        lambda: draw.checked_path("../../../b"),
        lambda: draw.checked_path("/etc/x"),
        lambda: draw.checked_path("/tmp/x", ("/srv/charts",)),
        lambda: draw.render({c: np.empty(0) for c in ("open", "high", "low", "close")}, speed="slow"),
        lambda: recipes.charts(df, S, panels=("tea",)),
        lambda: Style.from_settings({"colour": "#fff"}),
        lambda: registry.apply("tea", df, S),
        lambda: registry.apply("sma", df, S, m=3),
        lambda: draw.checked_path(""),
    ):
        with pytest.raises(ConfigurationError):
            call()
    with pytest.raises(DataValidationError, match="not found"):
        recursive.ema(df, S, 3, "price")


def test_readers_and_writers(spark, tmp_path):
    df = readers.candles(spark, {"Open": [1.0, 2], "High": [2.0, 3], "Low": [0.5, 1], "Close": [1.5, 2.5]})
    assert set(df.columns) == {"open", "high", "low", "close", "volume"} and df.first()["volume"] == 1
    (tmp_path / "t.csv").write_text("1,10.0,2.0,20,1700000000000,true\n2,11.0,1.0,11,1700000060000,false\n")
    made = bars.time_bars(readers.trades(spark, str(tmp_path / "t.csv")), TICKS, "1m")
    assert table(made) == [(10, 10, 10, 10, 2), (11, 11, 11, 11, 1)]
    writers.parquet(df.selectExpr("*", "'a' AS symbol"), str(tmp_path / "p"), ("symbol",))
    assert readers.parquet(spark, str(tmp_path / "p"), ["close"], "symbol = 'a' AND close > 2").count() == 1


@pytest.mark.parametrize("kind", ["candle", "hollow", "ohlc", "line", "renko", "pnf"])
def test_charts(kind):
    rng = np.random.default_rng(2)
    c = 100 + np.cumsum(rng.normal(0, 2, 80))
    rows = {"open": c + 0.5, "high": c + 1.5, "low": c - 1.5, "close": c, "volume": rng.integers(1, 100, 80)}
    svg = draw.render(rows, kind, "svg", Style(400, 300, fill_area=True), box=1.0).decode()
    assert svg.startswith("<svg") and svg.endswith("</svg>") and svg.count("<") > 80
    png = draw.render(rows, kind, "png", Style(400, 300, fill_area=True))
    assert png.startswith(b"\x89PNG") and len(png) > 300
    assert draw.render(rows, kind, "svgz", Style(400, 300, fill_area=True))[:2] == b"\x1f\x8b"


def test_overlays_panels_and_arrays():
    rng = np.random.default_rng(4)
    c = 100 + np.cumsum(rng.normal(0, 2, 60))
    rows = {"open": c + 0.5, "high": c + 1.5, "low": c - 1.5, "close": c}
    gappy = np.where(np.arange(60) < 10, np.nan, c)
    panel = draw.Panel({"rsi": np.clip(c, 0, 100)}, levels=(30.0, 70.0), bounds=(0.0, 100.0))
    plain = draw.render(rows, "candle", "svg", Style(400, 300, show_volume=False)).decode()
    made = draw.render(rows, "candle", "svg", Style(400, 300, show_volume=False), overlays={"sma": gappy}, panels=[panel, draw.Panel({}, c - 100)]).decode()
    assert made.count("<line ") - plain.count("<line ") == 49 + 1 + 2 + 59 + 1
    assert made.count("<rect ") - plain.count("<rect ") == 60
    pixels = draw.to_array(rows, "candle", Style(400, 300), overlays={"sma": gappy}, panels=[panel])
    assert pixels.shape == (300, 400, 3) and pixels.dtype == np.uint8 and len(np.unique(pixels.reshape(-1, 3), axis=0)) > 5
    small, large = (len(draw.render(rows, style=Style(400, 300), speed=x)) for x in ("best", "fast"))
    assert small <= large
    with pytest.raises(ConfigurationError):
        draw.render(rows, "renko", overlays={"sma": gappy})


def test_registry(spark):
    df = frame(spark, close=[1.0, 2, 3, 4], high=[2.0, 3, 4, 5], low=[0.0, 1, 2, 3], volume=[1.0, 1, 1, 1], open=[1.0, 2, 3, 4])
    assert len(registry.OPERATORS) > 40
    for name, o in registry.OPERATORS.items():
        needed = {n: {"window": 2, "timeframe": "1d", "size": 2, "anchor": "close", "span": 2, "n": 2, "x": "close", "amount": 1.0}[n] for n, v in o.parameters.items() if v is registry.inspect.Parameter.empty}
        if o.kind != "bars":
            made = o(df, S, **needed)
            assert set(o.outputs) <= set(made.columns), name
    with pytest.raises(DataValidationError, match="5 rows are needed, a series has 4"):
        registry.apply("sma", df, S, strict=True, n=5)
    assert [r["sma"] for r in registry.apply("sma", df, S, strict=True, n=4).orderBy("idx").collect()] == [None, None, None, 2.5]


def test_pandas_series(spark):
    x = pd.Series([1.0, 2, np.nan, 4, 5, 6], index=list("abcdef"))
    made = readers.moving_average(spark, x, 2)
    assert list(made.index) == list(x.index) and np.allclose(made, x.rolling(2).mean(), equal_nan=True)
    assert readers.moving_average(spark, x[:0], 2, "ema").empty
    with pytest.raises(DataValidationError):
        readers.moving_average(spark, x, 2, "tea")


def test_table_functions(spark):
    tables.register(spark)
    p = [100.0, 101, 102.5, 102, 100, 99]
    spark.createDataFrame(pd.DataFrame({"k": "a", "ts": pd.date_range("2025-01-01", periods=6, freq="s", tz="UTC"), "price": p, "volume": 1.0})).createOrReplaceTempView("ticks_of_a")
    made = spark.sql("SELECT key, unix_micros(ts) AS t, open, high, low, close, volume FROM range_bars(TABLE(ticks_of_a) PARTITION BY (k) ORDER BY (ts), 2.0D)").collect()
    whole = bars.range_bars(spark.table("ticks_of_a"), Series(("k",), ("ts",)), 2.0).selectExpr("k", "unix_micros(ts)", "open", "high", "low", "close", "volume").collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, whole)) and len(made) == 3


def test_charts_by_series(spark, tmp_path):
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * 5 + ["b"] * 5, "idx": list(range(5)) * 2, "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 3.0}))
    made = recipes.charts(df, Series(("k",), ("idx",), None), "svg")
    paths = [r["path"] for r in writers.images(made, str(tmp_path / "out"), "svg", ("k",)).collect()]
    assert sorted(os.path.basename(p) for p in paths) == ["a.svg", "b.svg"] and all(os.path.getsize(p) for p in paths)
