"""Series in blocks against the same series in one piece."""

import numpy as np
import pandas as pd
import pytest

from barwright.errors import ConfigurationError
from barwright.model import Series
from barwright.operators import long, recursive, rolling

S = Series(("k",), ("ts", "i"), "hour")


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(12)
    n = 1500
    x = 100 + np.cumsum(rng.normal(0, 1, n))
    x[rng.random(n) < 0.03] = np.nan
    ts = pd.Timestamp("2025-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 90_000, n)), unit="s")
    df = spark.createDataFrame(pd.DataFrame({"k": np.where(rng.random(n) < 0.8, "hot", "cold"), "ts": ts, "i": range(n), "close": x, "high": x + 1, "low": x - 1}))
    return df.selectExpr("k", "ts", "i", *[f"if(isnan({c}), null, {c}) AS {c}" for c in ("close", "high", "low")])


def same(a, b):
    a, b = (x.toPandas().sort_values("i").reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-9)


def test_windows(series):
    add = lambda df, s: rolling.swing_points(rolling.hma(rolling.bollinger(df, s), s, 16), s, 4)
    same(add(series, S), long.blocked(series, S, 20, add, ahead=4, rows=97))


@pytest.mark.parametrize("rows", [40, 5000])
def test_smoothing(series, rows):
    same(recursive.ema(series, S, 12), long.ema(series, S, 12, rows=rows))


def test_blocks_must_hold_the_windows(series):
    with pytest.raises(ConfigurationError):
        long.blocked(series, S, 50, lambda df, s: df, rows=50)
