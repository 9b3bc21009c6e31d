"""Streams against the batch operators on the same rows."""

import pandas as pd

from pyspark.sql import functions as F

from barwright import queries as engine
from barwright.model import Series
from barwright.operators import bars, kernels, recursive, rolling
from barwright.streaming import live

SF = "/root/testdata/sf0.001"
S = Series(("key",), ("ts", "event_id"))


def drained(stream, name):
    query = stream.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return stream.sparkSession.table(name)


def source(spark, tmp_path, parts=3):
    """The ticks in files of ascending time, one a trigger."""
    rows = engine.ticks(spark, SF).toPandas().sort_values(["ts", "event_id"])
    size = -(-len(rows) // parts)
    for n in range(parts):
        rows.iloc[n * size : (n + 1) * size].to_parquet(tmp_path / f"{n}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    schema = engine.ticks(spark, SF).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_time_bars(spark, tmp_path):
    made = drained(live.time_bars(source(spark, tmp_path), S, "1h"), "time_bars_stream").toPandas()
    whole = bars.time_bars(engine.ticks(spark, SF), S, "1h").toPandas()
    both = made.merge(whole, on=["key", "ts"], suffixes=("", "_w"))
    assert 0 < len(made) == len(both)
    for c in ("open", "high", "low", "close", "volume"):
        pd.testing.assert_series_equal(both[c], both[c + "_w"], check_names=False)


def test_indicators_keep_their_state(spark, tmp_path):
    stream = live.indicators(source(spark, tmp_path), S, ["price"], [kernels.ema("price", 12, "ema"), kernels.rsi("price", 14)])
    made = drained(stream, "indicators_stream").toPandas().sort_values("event_id").reset_index(drop=True)
    df = engine.ticks(spark, SF)
    whole = recursive.rsi(recursive.ema(df, S, 12, "price"), S, 14, "price").orderBy("event_id").toPandas()
    assert len(made) == len(whole) and made["late"].max() == 0
    for c in ("ema", "rsi"):
        pd.testing.assert_series_equal(made[c], whole[c], rtol=1e-10)


def test_path_bars(spark, tmp_path):
    made = drained(live.bars(source(spark, tmp_path), S, ["ts", "price", "volume"], bars.RangeBars(60.0, "ts", "price", "volume")), "range_stream")
    whole = bars.range_bars(engine.ticks(spark, SF), S, 60.0)
    a = {tuple(r) for r in made.select("key", F.unix_micros("ts"), "open", "close", "volume").collect()}
    b = {tuple(r) for r in whole.select("key", F.unix_micros("ts"), "open", "close", "volume").collect()}
    assert a and a <= b and len(b) - len(a) <= 5  # the bars in the making stay in the state


def test_windows_of_rows(spark, tmp_path):
    made = live.indicators(source(spark, tmp_path), S, ["price"], [kernels.sma("price", 5), kernels.rolling_extreme("price", 5, True, "top"), kernels.rolling_std("price", 5, "sd"), kernels.wma("price", 4), kernels.roc("price", 3)])
    assert live.indicators(source(spark, tmp_path), S, ["price"], [kernels.sma("price", 5)], forget="6 hours").isStreaming
    made = drained(made, "windows_stream").toPandas().sort_values("event_id").reset_index(drop=True)
    df = engine.ticks(spark, SF)
    df = rolling.roc(rolling.wma(rolling.sma(df, S, 5, "price"), S, 4, "price"), S, 3, "price").withColumns({"top": rolling.rolling_max("price", S, 5), "sd": rolling.rolling_std("price", S, 5)})
    whole = df.orderBy("event_id").toPandas()
    for c in ("sma", "wma", "roc", "top", "sd"):
        pd.testing.assert_series_equal(made[c], whole[c], rtol=1e-9)


def test_tick_and_volume_bars(spark, tmp_path):
    for n, (by_volume, size, batch) in enumerate(((False, 20, bars.tick_bars), (True, 100.0, bars.volume_bars))):
        folder = tmp_path / str(n)
        folder.mkdir()
        made = drained(live.bars(source(spark, folder), S, ["ts", "price", "volume"], bars.CountBars(size, by_volume, "ts", "price", "volume")), f"count_stream_{n}")
        shown = lambda d: {tuple(r) for r in d.selectExpr("key", "bar", "unix_micros(ts)", "open", "high", "low", "close", "double(volume)").collect()}
        a, b = shown(made), shown(batch(engine.ticks(spark, SF), S, size))
        assert a and a <= b and len(b) - len(a) <= 5


def test_last_rows_are_redrawn(spark, tmp_path):
    drawn = []
    query = live.last_rows(source(spark, tmp_path), S, 30, lambda key, rows: drawn.append((key, rows)), every=10, checkpoint=str(tmp_path / "at"))
    query.processAllAvailable()
    query.stop()
    whole = engine.ticks(spark, SF).toPandas().sort_values(["ts", "event_id"])
    assert drawn and all(len(rows) <= 30 and rows["ts"].is_monotonic_increasing for _, rows in drawn)
    last = dict(drawn)
    for key, rows in last.items():
        assert rows["event_id"].tolist() == whole[whole["key"] == key[0]]["event_id"].tail(30).tolist()
