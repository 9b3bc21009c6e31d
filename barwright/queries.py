"""The registered queries of the time-series engine, each with the same thing in SQL.

Ticks are the rows of ``events``: series by event_type, price = value, volume = 1 + user_id % 10, order by
(ts, event_id). Indicators run on their four-hour bars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rowwise
from .model import EPSILON, Series, without_nan
from .operators import bars, bricks, long, recursive, rolling, summaries, totals
from .sources.readers import ticks_from_events

TICKS, BARS = Series(("key",), ("ts", "event_id")), Series(("key",), ("ts",))
Query = Callable[[SparkSession, str], DataFrame]

TICKS_SQL = """WITH RECURSIVE ticks AS MATERIALIZED (SELECT event_type AS key, ts, event_id, value AS price, 1 + user_id % 10 AS volume FROM events),
hb AS MATERIALIZED (SELECT key, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, row(ts, event_id)) AS close, sum(volume)::BIGINT AS volume FROM ticks GROUP BY 1, 2)"""
W = "(PARTITION BY key ORDER BY ts)"
RUNNING = "(PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING)"
DIGITS = 6


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_nan(ticks_from_events(spark, sf_dir), "price")


def candles(spark: SparkSession, sf_dir: str, timeframe: str = "4h") -> DataFrame:
    return bars.time_bars(ticks(spark, sf_dir), TICKS, timeframe)


def _shown(c: str) -> Column:
    return (F.round(F.col(c).cast("double"), DIGITS) + 0.0).alias(c)


def _result(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("key", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), *[_shown(c) for c in columns])


def _result_sql(source: str, *columns: str) -> str:
    return "SELECT key, (epoch_us(ts) // 1000000)::BIGINT AS t, " + ", ".join(f"round({c}::DOUBLE, {DIGITS}) + 0.0 AS {c}" for c in columns) + f" FROM {source}"


def _last(n: int) -> str:
    return f"(PARTITION BY key ORDER BY ts ROWS {n - 1} PRECEDING)"


def _full(n: int, how: str, c: str) -> str:
    return f"(CASE WHEN count({c}) OVER {_last(n)} >= {n} THEN {how}({c}) OVER {_last(n)} END)"


def _lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER {W}"


def _ewm(name: str, source: str, x: str, alpha: float, least: int = 1) -> str:
    """A smoother over the rows of ``source`` where x is present: (key, ts, y), null for the first least - 1."""
    return f"""{name}_s AS MATERIALIZED (SELECT key, ts, ({x})::DOUBLE AS x, row_number() OVER {W} AS i FROM {source} WHERE ({x}) IS NOT NULL),
{name}_r AS (SELECT key, ts, i, x AS y FROM {name}_s WHERE i = 1 UNION ALL SELECT s.key, s.ts, s.i, {alpha!r} * s.x + (1 - {alpha!r}) * e.y FROM {name}_r e JOIN {name}_s s ON s.key = e.key AND s.i = e.i + 1),
{name} AS MATERIALIZED (SELECT key, ts, CASE WHEN i >= {least} THEN y END AS y FROM {name}_r)"""


def _seeded(name: str, source: str, x: str, alpha: float, p: int) -> str:
    """A smoother seeded at row p with the mean of what is present in the first p rows."""
    return f"""{name}_s AS MATERIALIZED (SELECT key, ts, ({x})::DOUBLE AS x, row_number() OVER {W} AS i FROM {source}),
{name}_r AS (SELECT key, {p}::BIGINT AS i, avg(x) AS y FROM {name}_s WHERE i <= {p} GROUP BY key HAVING count(*) = {p} UNION ALL SELECT s.key, s.i, {alpha!r} * s.x + (1 - {alpha!r}) * e.y FROM {name}_r e JOIN {name}_s s ON s.key = e.key AND s.i = e.i + 1),
{name} AS MATERIALIZED (SELECT s.key, s.ts, r.y FROM {name}_s s LEFT JOIN {name}_r r ON r.key = s.key AND r.i = s.i)"""


RANGE = f"greatest(high - low, abs(high - {_lag('close')}), abs(low - {_lag('close')}))"
ALL: dict[str, tuple[Query, str | None]] = {}


def _on_candles(name: str, made: Callable[[DataFrame], DataFrame], columns: tuple[str, ...], sql: str | None) -> None:
    """sql: common table expressions after ``hb``, the last of them ``o``."""
    ALL[name] = (lambda spark, d: _result(made(candles(spark, d)), *columns), None if sql is None else f"{TICKS_SQL},\n{sql}\n{_result_sql('o', *columns)}")


def _windowed(name: str, made: Callable[[DataFrame], DataFrame], **columns: str) -> None:
    _on_candles(name, made, tuple(columns), "o AS (SELECT key, ts, " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + " FROM hb)")


def _register() -> None:
    tp = "((high + low + close) / 3)"
    s = BARS
    # one row at a time
    _windowed("typical_price", lambda d: d.withColumn("v", rowwise.typical_price("high", "low", "close")), v=tp)
    _windowed("median_price", lambda d: d.withColumn("v", rowwise.median_price("high", "low")), v="(high + low) / 2")
    _windowed("weighted_close", lambda d: d.withColumn("v", rowwise.weighted_close("high", "low", "close")), v="(high + low + close * 2) / 4")
    _windowed("money_flow", lambda d: d.withColumn("v", rowwise.money_flow("high", "low", "close", "volume")), v=f"{tp} * volume")
    _windowed("pivot_points", lambda d: d.withColumns(rowwise.pivot_points("high", "low", "close")), pp=tp, r1=f"2 * {tp} - low", r2=f"{tp} + high - low", r3=f"high + 2 * ({tp} - low)", s1=f"2 * {tp} - high", s2=f"{tp} - high + low", s3=f"low - 2 * (high - {tp})")
    _windowed("fibonacci", lambda d: d.withColumns(rowwise.fibonacci_retracement("high", "low")), **{f"fib_{round(x * 1000)}": f"CASE WHEN high > low THEN high - (high - low) * {x}::DOUBLE END" for x in rowwise.FIBONACCI})
    _windowed("normalize_clip", lambda d: d.withColumns({"n": rowwise.normalize("close", "low", "high"), "c": rowwise.clip("close", 20, 80)}), n="CASE WHEN high = low THEN 0 ELSE (close - low) / (high - low) END", c="least(greatest(close, 20), 80)")
    gappy = "CASE WHEN volume % 3 != 0 THEN close END"
    _windowed(
        "fill_and_difference",
        lambda d: d.withColumn("g", F.expr(gappy)).withColumns({"f": rowwise.fill_forward("g", s), "b": rowwise.fill_backward("g", s), "r": rowwise.replace_missing("g", -1.0), "d": rowwise.difference("close", s, 2)}),
        f=f"last_value({gappy} IGNORE NULLS) OVER {RUNNING}", b=f"first_value({gappy} IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", r=f"coalesce({gappy}, -1)", d=f"close - {_lag('close', 2)}",
    )
    # rolling kernels
    _windowed(
        "rolling_kernels",
        lambda d: d.withColumns({"hi": rolling.rolling_max("close", s, 5), "lo": rolling.rolling_min("close", s, 5), "me": rolling.rolling_mean("close", s, 5), "sd": rolling.rolling_std("close", s, 5), "su": rolling.rolling_sum("close", s, 5, 2)}),
        hi=_full(5, "max", "close"), lo=_full(5, "min", "close"), me=_full(5, "avg", "close"), sd=_full(5, "stddev_samp", "close"), su=f"CASE WHEN count(close) OVER {_last(5)} >= 2 THEN sum(close) OVER {_last(5)} END",
    )
    _windowed("percentage_change", lambda d: d.withColumn("v", rolling.percentage_change("close", s, 3)), v=f"(close / nullif({_lag('close', 3)}, 0) - 1) * 100")
    _windowed("true_range", lambda d: d.withColumn("v", rolling.true_range(s, first=False)), v=f"CASE WHEN {_lag('close')} IS NOT NULL THEN {RANGE} END")
    _windowed("gain_loss", lambda d: d.withColumns(dict(zip(("gain", "loss"), rolling.gain_loss("close", s)))), gain=f"CASE WHEN {_lag('close')} IS NOT NULL THEN greatest(close - {_lag('close')}, 0) END", loss=f"CASE WHEN {_lag('close')} IS NOT NULL THEN greatest({_lag('close')} - close, 0) END")
    up, down = f"(high - {_lag('high')})", f"({_lag('low')} - low)"
    plus, minus = f"CASE WHEN {up} IS NULL THEN NULL WHEN {up} > {down} AND {up} > 0 THEN {up} ELSE 0 END", f"CASE WHEN {up} IS NULL THEN NULL WHEN {down} > {up} AND {down} > 0 THEN {down} ELSE 0 END"
    _windowed("directional_movement", lambda d: d.withColumns(dict(zip(("plus_dm", "minus_dm"), rolling.directional_movement(s)))), plus_dm=plus, minus_dm=minus)
    step = f"({tp} - lag({tp}) OVER {W})"
    flow_up, flow_down = f"CASE WHEN {step} IS NULL THEN NULL WHEN {step} > 0 THEN {tp} * volume ELSE 0 END", f"CASE WHEN {step} IS NULL THEN NULL WHEN {step} < 0 THEN {tp} * volume ELSE 0 END"
    _windowed("signed_money_flow", lambda d: d.withColumns(dict(zip(("pos", "neg"), rolling.signed_money_flow(s)))), pos=flow_up, neg=flow_down)
    # averages and trend
    wma = lambda n, x: "(" + " + ".join([f"{n} * {x}", *[f"{n - k} * {_lag(x, k)}" for k in range(1, n)]]) + f") / {n * (n + 1) / 2}"
    _windowed("sma", lambda d: rolling.sma(d, s, 20), sma=_full(20, "avg", "close"))
    _windowed("wma", lambda d: rolling.wma(d, s, 20), wma=wma(20, "close"))
    _windowed("vwma", lambda d: rolling.vwma(d, s, 20), vwma=f"{_full(20, 'sum', '(close * volume)')} / sum(volume) OVER {_last(20)}")
    _on_candles("hma", lambda d: rolling.hma(d, s, 20), ("hma",), f"a AS (SELECT key, ts, 2 * ({wma(10, 'close')}) - {wma(20, 'close')} AS x FROM hb), o AS (SELECT key, ts, {wma(4, 'x')} AS hma FROM a)")
    _on_candles(
        "aroon", lambda d: rolling.aroon(d, s, 25), ("aroon_up", "aroon_down"),
        f"a AS (SELECT key, ts, high, low, row_number() OVER {W} AS i FROM hb), o AS (SELECT key, ts, CASE WHEN i >= 25 THEN 100.0 * (25 - (i - arg_max(i, row(high, i)) OVER {_last(25)})) / 25 END AS aroon_up, CASE WHEN i >= 25 THEN 100.0 * (25 - (i - arg_min(i, row(low, -i)) OVER {_last(25)})) / 25 END AS aroon_down FROM a)",
    )
    middle = lambda n: f"({_full(n, 'max', 'high')} + {_full(n, 'min', 'low')}) / 2"
    _on_candles(
        "ichimoku", lambda d: rolling.ichimoku(d, s), ("tenkan", "kijun", "senkou_a", "senkou_b", "chikou"),
        f"a AS (SELECT key, ts, close, {middle(9)} AS tenkan, {middle(26)} AS kijun, {middle(52)} AS b FROM hb), o AS (SELECT key, ts, tenkan, kijun, lag((tenkan + kijun) / 2, 26) OVER {W} AS senkou_a, {_lag('b', 26)} AS senkou_b, lead(close, 26) OVER {W} AS chikou FROM a)",
    )
    # momentum and channels
    k = lambda n: f"100 * (close - {_full(n, 'min', 'low')}) / ({_full(n, 'max', 'high')} - {_full(n, 'min', 'low')} + {EPSILON!r})"
    _on_candles("stochastic", lambda d: rolling.stochastic(d, s, 14, 3), ("stoch_k", "stoch_d"), f"a AS (SELECT key, ts, {k(14)} AS stoch_k FROM hb), o AS (SELECT key, ts, stoch_k, {_full(3, 'avg', 'stoch_k')} AS stoch_d FROM a)")
    _windowed("williams_r", lambda d: rolling.williams_r(d, s, 14), williams_r=f"-100 * ({_full(14, 'max', 'high')} - close) / ({_full(14, 'max', 'high')} - {_full(14, 'min', 'low')} + {EPSILON!r})")
    _on_candles("cci", lambda d: rolling.cci(d, s, 20), ("cci",), f"a AS (SELECT key, ts, {tp} - {_full(20, 'avg', tp)} AS x FROM hb), b AS (SELECT key, ts, x, abs(x) AS y FROM a), o AS (SELECT key, ts, x / ({_full(20, 'avg', 'y')} * 0.015::DOUBLE + {EPSILON!r}) AS cci FROM b)")
    _windowed("roc", lambda d: rolling.roc(d, s, 12), roc=f"100 * (close - {_lag('close', 12)}) / nullif({_lag('close', 12)}, 0)")
    _on_candles(
        "mfi", lambda d: rolling.mfi(d, s, 14), ("mfi",),
        f"a AS (SELECT key, ts, {flow_up} AS u, {flow_down} AS d FROM hb), b AS (SELECT key, ts, {_full(14, 'sum', 'u')} AS u, {_full(14, 'sum', 'd')} AS d FROM a), o AS (SELECT key, ts, CASE WHEN u < {EPSILON!r} THEN 0 WHEN d < {EPSILON!r} THEN 100 ELSE 100 - 100 / (1 + u / (d + {EPSILON!r})) END AS mfi FROM b)",
    )
    mid, off = _full(20, "avg", "close"), _full(20, "stddev_samp", "close")
    _windowed("bollinger", lambda d: rolling.bollinger(d, s), bb_upper=f"{mid} + 2 * {off}", bb_middle=mid, bb_lower=f"{mid} - 2 * {off}")
    _windowed("donchian", lambda d: rolling.donchian(d, s), dc_upper=_full(20, "max", "high"), dc_middle=middle(20), dc_lower=_full(20, "min", "low"))
    flow = f"((close * 2 - high - low) / (high - low + {EPSILON!r}) * volume)"
    _windowed("cmf", lambda d: rolling.cmf(d, s), cmf=f"{_full(20, 'sum', flow)} / (sum(volume) OVER {_last(20)} + {EPSILON!r})")
    obv = f"coalesce(sign(close - {_lag('close')}) * volume, 0)"
    _on_candles("obv", lambda d: totals.obv(d, s), ("obv",), f"a AS (SELECT key, ts, {obv} AS x FROM hb), o AS (SELECT key, ts, sum(x) OVER {RUNNING} AS obv FROM a)")
    _windowed("vwap", lambda d: totals.vwap(d, s), vwap=f"sum({tp} * volume) OVER {RUNNING} / sum(volume) OVER {RUNNING}")
    _on_candles(
        "vwap_anchored", lambda d: totals.vwap_anchored(d.withColumn("a", F.hour("ts") == 0), s, "a"), ("vwap",),
        f"a AS (SELECT *, sum(CASE WHEN hour(ts) = 0 THEN 1 ELSE 0 END) OVER {RUNNING} AS g FROM hb), o AS (SELECT key, ts, sum({tp} * volume) OVER (PARTITION BY key, g ORDER BY ts ROWS UNBOUNDED PRECEDING) / sum(volume) OVER (PARTITION BY key, g ORDER BY ts ROWS UNBOUNDED PRECEDING) AS vwap FROM a)",
    )
    _windowed("cumulative_sum", lambda d: totals.cumulative_sum(d, s, "close"), cumulative=f"sum(close) OVER {RUNNING}")
    sides = [f"(PARTITION BY key ORDER BY ts ROWS BETWEEN {x})" for x in ("5 PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND 5 FOLLOWING")]
    whole = " AND ".join(f"count(*) OVER {x} = 5" for x in sides)
    _windowed("swing_points", lambda d: rolling.swing_points(d, s, 5).withColumns({"sh": F.col("swing_high").cast("int"), "sl": F.col("swing_low").cast("int")}), sh=f"coalesce({whole} AND high >= max(high) OVER {sides[0]} AND high > max(high) OVER {sides[1]}, false)::INT", sl=f"coalesce({whole} AND low <= min(low) OVER {sides[0]} AND low < min(low) OVER {sides[1]}, false)::INT")
    _on_candles(
        "moving_linear_fit", lambda d: rolling.moving_linear_fit(d, s, 10), ("fit_slope", "fit_intercept"),
        f"a AS (SELECT key, ts, close, row_number() OVER {W} AS i FROM hb), b AS (SELECT key, ts, CASE WHEN i >= 10 THEN regr_slope(close, i) OVER {_last(10)} END AS fit_slope, avg(close) OVER {_last(10)} AS m FROM a), o AS (SELECT key, ts, fit_slope, m - fit_slope * 4.5 AS fit_intercept FROM b)",
    )
    # recurrences
    alpha = lambda p: 2 / (p + 1)
    ema = lambda name, p, src="hb", x="close", least=None: _ewm(name, src, x, alpha(p), p if least is None else least)
    _on_candles("ema", lambda d: recursive.ema(d, s, 12), ("ema",), f"{ema('e', 12)}, o AS (SELECT key, ts, y AS ema FROM e)")
    _on_candles("ewm_mean", lambda d: recursive.ewm_mean(d, s, 10, False), ("ewm",), f"{_seeded('e', 'hb', 'close', 0.1, 10)}, o AS (SELECT key, ts, y AS ewm FROM e)")
    _on_candles("wilder_smoothing", lambda d: recursive.wilder(d, s, 14), ("wilder",), f"{_seeded('e', 'hb', 'close', 1 / 14, 14)}, o AS (SELECT key, ts, y AS wilder FROM e)")
    _on_candles("dema", lambda d: recursive.dema(d, s, 10), ("dema",), f"{ema('e', 10)}, {ema('f', 10, 'e', 'y')}, o AS (SELECT key, ts, 2 * e.y - f.y AS dema FROM e LEFT JOIN f USING (key, ts))")
    _on_candles("tema", lambda d: recursive.tema(d, s, 10), ("tema",), f"{ema('e', 10)}, {ema('f', 10, 'e', 'y')}, {ema('g', 10, 'f', 'y')}, o AS (SELECT key, ts, 3 * e.y - 3 * f.y + g.y AS tema FROM e LEFT JOIN f USING (key, ts) LEFT JOIN g USING (key, ts))")
    macd = f"{ema('e', 12)}, {ema('f', 26)}, m AS MATERIALIZED (SELECT key, ts, e.y - f.y AS macd_line FROM e JOIN f USING (key, ts)), {ema('g', 9, 'm', 'macd_line')}, mm AS (SELECT key, ts, macd_line, g.y AS macd_signal, macd_line - g.y AS macd_histogram FROM m LEFT JOIN g USING (key, ts))"
    _on_candles("macd", lambda d: recursive.macd(d, s), ("macd_line", "macd_signal", "macd_histogram"), f"{macd}, o AS (SELECT * FROM mm)")
    change = f"(close - coalesce({_lag('close')}, close))"
    rsi = lambda p: f"ch AS MATERIALIZED (SELECT key, ts, greatest({change}, 0) AS u, greatest(-{change}, 0) AS d FROM hb), {_ewm('ru', 'ch', 'u', 1 / p)}, {_ewm('rd', 'ch', 'd', 1 / p)}, rr AS MATERIALIZED (SELECT key, ts, 100 - 100 / (1 + ru.y / (rd.y + {EPSILON!r})) AS rsi FROM ru JOIN rd USING (key, ts))"
    _on_candles("rsi", lambda d: recursive.rsi(d, s), ("rsi",), f"{rsi(14)}, o AS (SELECT * FROM rr)")
    low, high = _full(14, "min", "rsi"), _full(14, "max", "rsi")
    _on_candles(
        "stochastic_rsi", lambda d: recursive.stochastic_rsi(d, s), ("stoch_rsi_k", "stoch_rsi_d"),
        f"{rsi(14)}, a AS (SELECT key, ts, 100 * (rsi - {low}) / ({high} - {low} + {EPSILON!r}) AS x FROM rr), b AS (SELECT key, ts, {_full(3, 'avg', 'x')} AS stoch_rsi_k FROM a), o AS (SELECT key, ts, stoch_rsi_k, {_full(3, 'avg', 'stoch_rsi_k')} AS stoch_rsi_d FROM b)",
    )
    ranged = f"tr AS MATERIALIZED (SELECT key, ts, high, low, close, {RANGE} AS r, CASE WHEN {_lag('close')} IS NOT NULL THEN {RANGE} END AS r1 FROM hb)"
    _on_candles("atr", lambda d: recursive.atr(d, s), ("atr",), f"{ranged}, {_ewm('a', 'tr', 'r', 1 / 14)}, o AS (SELECT key, ts, y AS atr FROM a)")
    _on_candles("atr_wilder", lambda d: recursive.atr_wilder(d, s), ("atr_wilder",), f"{ranged}, {_seeded('a', 'tr', 'r1', 1 / 14, 14)}, o AS (SELECT key, ts, y AS atr_wilder FROM a)")
    moved = f"ch AS MATERIALIZED (SELECT key, ts, close - {_lag('close')} AS m, abs(close - {_lag('close')}) AS a FROM hb)"
    _on_candles(
        "tsi", lambda d: recursive.tsi(d, s), ("tsi",),
        f"{moved}, {ema('m1', 25, 'ch', 'm')}, {ema('m2', 13, 'm1', 'y')}, {ema('a1', 25, 'ch', 'a')}, {ema('a2', 13, 'a1', 'y')}, o AS (SELECT key, ts, 100 * m2.y / (a2.y + {EPSILON!r}) AS tsi FROM hb LEFT JOIN m2 USING (key, ts) LEFT JOIN a2 USING (key, ts))",
    )
    _on_candles("elder_ray", lambda d: recursive.elder_ray(d, s), ("bull_power", "bear_power"), f"{ema('e', 13)}, o AS (SELECT key, ts, high - y AS bull_power, low - y AS bear_power FROM hb JOIN e USING (key, ts))")
    _on_candles("keltner", lambda d: recursive.keltner(d, s), ("kc_upper", "kc_middle", "kc_lower"), f"{ranged}, {ema('e', 20, least=1)}, {_ewm('a', 'tr', 'r', 1 / 20)}, o AS (SELECT key, ts, e.y + 2 * a.y AS kc_upper, e.y AS kc_middle, e.y - 2 * a.y AS kc_lower FROM e JOIN a USING (key, ts))")
    _on_candles(
        "adx", lambda d: recursive.adx(d, s), ("adx", "plus_di", "minus_di"),
        f"""dm AS MATERIALIZED (SELECT key, ts, {plus} AS p, {minus} AS m, CASE WHEN {_lag('close')} IS NOT NULL THEN {RANGE} END AS r FROM hb), {_seeded('sp', 'dm', 'p', 1 / 14, 14)}, {_seeded('sm', 'dm', 'm', 1 / 14, 14)}, {_seeded('sr', 'dm', 'r', 1 / 14, 14)},
di AS MATERIALIZED (SELECT key, ts, 100 * sp.y / (sr.y + {EPSILON!r}) AS p, 100 * sm.y / (sr.y + {EPSILON!r}) AS m FROM sp JOIN sm USING (key, ts) JOIN sr USING (key, ts)),
dx AS MATERIALIZED (SELECT key, ts, coalesce(CASE WHEN p + m > {EPSILON!r} THEN 100 * abs(p - m) / (p + m + {EPSILON!r}) END, 0) AS x FROM di), {_seeded('ax', 'dx', 'x', 1 / 14, 14)},
o AS (SELECT key, ts, ax.y AS adx, p AS plus_di, m AS minus_di FROM ax JOIN di USING (key, ts))""",
    )
    _on_candles(
        "parabolic_sar", lambda d: recursive.parabolic_sar(d, s), ("sar",),
        f"""b AS MATERIALIZED (SELECT key, ts, high, low, row_number() OVER {W} AS i, {_lag('high')} AS h1, {_lag('low')} AS l1, {_lag('high', 2)} AS h2, {_lag('low', 2)} AS l2 FROM hb),
r AS (SELECT key, ts, i, low AS sar, high AS ep, true AS up, 0.02::DOUBLE AS af FROM b WHERE i = 1
    UNION ALL SELECT key, ts, i, CASE WHEN turn THEN ep ELSE nxt END, CASE WHEN turn THEN (CASE WHEN up THEN low ELSE high END) WHEN up THEN greatest(ep, high) ELSE least(ep, low) END, up != turn,
        CASE WHEN turn THEN 0.02::DOUBLE WHEN (up AND high > ep) OR (NOT up AND low < ep) THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END
    FROM (SELECT *, CASE WHEN up THEN low < nxt ELSE high > nxt END AS turn FROM (SELECT b.key, b.ts, b.i, b.high, b.low, r.ep, r.up, r.af,
        CASE WHEN r.up THEN least(r.sar + r.af * (r.ep - r.sar), b.l1, coalesce(b.l2, b.l1)) ELSE greatest(r.sar + r.af * (r.ep - r.sar), b.h1, coalesce(b.h2, b.h1)) END AS nxt
        FROM r JOIN b ON b.key = r.key AND b.i = r.i + 1))),
o AS (SELECT key, ts, sar FROM r)""",
    )
    _on_candles(
        "supertrend", lambda d: recursive.supertrend(d, s), ("supertrend", "trend"),
        f"""{ranged}, {_ewm('a', 'tr', 'r', 0.1)}, b AS MATERIALIZED (SELECT key, ts, close, (high + low) / 2 + 3 * y AS bu, (high + low) / 2 - 3 * y AS bl, row_number() OVER {W} AS i FROM tr JOIN a USING (key, ts)),
r AS (SELECT key, ts, i, close, bu AS fu, bl AS fl, CASE WHEN close <= bu THEN -1 ELSE 1 END AS dir FROM b WHERE i = 11
    UNION ALL SELECT key, ts, i, close, fu, fl, CASE WHEN dir = 1 AND close <= fl THEN -1 WHEN dir = -1 AND close >= fu THEN 1 ELSE dir END
    FROM (SELECT b.key, b.ts, b.i, b.close, r.dir, CASE WHEN b.bu < r.fu OR r.close > r.fu THEN b.bu ELSE r.fu END AS fu, CASE WHEN b.bl > r.fl OR r.close < r.fl THEN b.bl ELSE r.fl END AS fl FROM r JOIN b ON b.key = r.key AND b.i = r.i + 1)),
o AS (SELECT b.key, b.ts, CASE WHEN dir = 1 THEN fl ELSE fu END AS supertrend, dir AS trend FROM b LEFT JOIN r ON r.key = b.key AND r.i = b.i)""",
    )
    _on_candles(
        "multiple_averages", lambda d: recursive.multiple_averages(d, s, sma=(5, 20), ema=(5, 20), sma_shift={20: 2}), ("sma_5", "sma_20", "ema_5", "ema_20"),
        f"{ema('e', 5, least=1)}, {ema('f', 20, least=1)}, a AS (SELECT key, ts, {_full(5, 'avg', 'close')} AS sma_5, {_full(20, 'avg', 'close')} AS x FROM hb), o AS (SELECT key, ts, sma_5, {_lag('x', 2)} AS sma_20, e.y AS ema_5, f.y AS ema_20 FROM a JOIN e USING (key, ts) JOIN f USING (key, ts))",
    )
    # the same over series cut in blocks of rows
    _on_candles("ema_blocked", lambda d: long.ema(d, s, 12, rows=50), ("ema",), f"{ema('e', 12)}, o AS (SELECT key, ts, y AS ema FROM e)")
    _windowed("bollinger_blocked", lambda d: long.blocked(d, s, 19, rolling.bollinger, rows=50), bb_upper=f"{mid} + 2 * {off}", bb_middle=mid, bb_lower=f"{mid} - 2 * {off}")
    _on_candles("rsi_blocked", lambda d: long.rsi(d, s, rows=50), ("rsi",), f"{rsi(14)}, o AS (SELECT * FROM rr)")
    _on_candles("atr_blocked", lambda d: long.atr(d, s, rows=50), ("atr",), f"{ranged}, {_ewm('a', 'tr', 'r', 1 / 14)}, o AS (SELECT key, ts, y AS atr FROM a)")
    for name in ("macd", "keltner", "tsi"):
        made, columns = {"macd": (long.macd, ("macd_line", "macd_signal", "macd_histogram")), "keltner": (long.keltner, ("kc_upper", "kc_middle", "kc_lower")), "tsi": (long.tsi, ("tsi",))}[name]
        ALL[f"{name}_blocked"] = (lambda spark, d, made=made, columns=columns: _result(made(candles(spark, d), s, rows=50), *columns), ALL[name][1])
    _on_candles("ewm_mean_adjusted", lambda d: recursive.ewm_mean(d, s, 10, True), ("ewm",), f"{_seeded('e', 'hb', 'close', 2 / 11, 10)}, o AS (SELECT key, ts, y AS ewm FROM e)")
    _on_candles("wma_long", lambda d: rolling.wma(d, s, 70), ("wma",), f"o AS (SELECT key, ts, {wma(70, 'close')} AS wma FROM hb)")
    batch = ("atr", "rsi", "stoch_k", "stoch_d", "bb_upper", "bb_middle", "bb_lower", "obv", "macd_line", "macd_signal", "macd_histogram")
    batch_sql = f"""{rsi(14)}, {ranged}, {_ewm('ra', 'tr', 'r', 1 / 14)}, {macd},
w1 AS (SELECT key, ts, {k(14)} AS stoch_k, {mid} + 2 * {off} AS bb_upper, {mid} AS bb_middle, {mid} - 2 * {off} AS bb_lower, {obv} AS x FROM hb),
w2 AS (SELECT *, {_full(3, 'avg', 'stoch_k')} AS stoch_d, sum(x) OVER {RUNNING} AS obv FROM w1),
o AS (SELECT w2.*, ra.y AS atr, rsi, macd_line, macd_signal, macd_histogram FROM w2 JOIN ra USING (key, ts) JOIN rr USING (key, ts) LEFT JOIN mm USING (key, ts))"""
    _on_candles("indicators_batch", lambda d: recursive.indicators_batch(d, s), batch, batch_sql)


_register()


def _bars(name: str, made: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    shown = ("open", "high", "low", "close", "volume")
    ALL[name] = (lambda spark, d: _result(made(ticks(spark, d)), *shown), None if sql is None else f"{TICKS_SQL},\n{sql}\n{_result_sql('o', *shown)}")


def _summed(group: str, source: str) -> str:
    return f"SELECT key, min(ts) AS ts, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS close, sum(volume) AS volume FROM {source} GROUP BY key, {group}"


def _register_bars() -> None:
    by_order = "(PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
    _bars("time_bars", lambda d: bars.time_bars(d, TICKS, "1h"), "o AS (SELECT key, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2)")
    _bars("ohlc_resample", lambda d: bars.ohlc_resample(bars.time_bars(d, TICKS, "1h"), BARS, "1d"), "o AS (SELECT key, time_bucket(INTERVAL '1 day', ts) AS ts, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2)")
    _bars("tick_bars", lambda d: bars.tick_bars(d, TICKS, 50), f"a AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY ts, event_id) - 1) // 50 AS g FROM ticks), o AS ({_summed('g', 'a')})")
    _bars("volume_bars", lambda d: bars.volume_bars(d, TICKS, 250), f"a AS (SELECT *, sum(volume) OVER {by_order} // 250 AS g FROM ticks), o AS ({_summed('g', 'a')})")
    _bars(
        "range_bars", lambda d: bars.range_bars(d, TICKS, 60.0),
        f"""n AS MATERIALIZED (SELECT key, ts, event_id, price, volume, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS i FROM ticks),
r AS (SELECT key, i, 1 AS g, price AS h, price AS l, false AS done FROM n WHERE i = 1 UNION ALL
    SELECT key, i, g, h, l, h - l >= 60 FROM (SELECT n.key, n.i, CASE WHEN r.done THEN r.g + 1 ELSE r.g END AS g, CASE WHEN r.done THEN n.price ELSE greatest(r.h, n.price) END AS h, CASE WHEN r.done THEN n.price ELSE least(r.l, n.price) END AS l FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1)),
a AS (SELECT n.*, g FROM n JOIN r USING (key, i)), o AS ({_summed('g', 'a')})""",
    )
    numbered = "n AS MATERIALIZED (SELECT key, ts, event_id, price, volume, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS i FROM ticks)"
    _bars(
        "kagi", lambda d: bars.kagi(d, TICKS, amount=40.0),
        f"""{numbered},
r AS (SELECT key, i, 0 AS g, price AS p0, price AS p1, 0 AS way FROM n WHERE i = 1 UNION ALL
    SELECT key, i, g + turn, CASE WHEN turn = 1 THEN p1 ELSE p0 END, CASE WHEN turn = 1 OR way = 0 OR (p - p1) * way > 0 THEN p ELSE p1 END, CASE WHEN way = 0 THEN sign(p - p0)::INT WHEN turn = 1 THEN -way ELSE way END
    FROM (SELECT n.key, n.i, r.g, r.p0, r.p1, r.way, n.price AS p, CASE WHEN r.way != 0 AND (r.p1 - n.price) * r.way >= 40 THEN 1 ELSE 0 END AS turn FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1)),
a AS (SELECT key, g, min(ts) AS ts, arg_min(p0, i) AS open, max(price) AS high, min(price) AS low, arg_max(p1, i) AS close, sum(volume) AS volume, arg_min(price, i) AS head, arg_max(way, i) AS way FROM r JOIN n USING (key, i) GROUP BY key, g),
b AS (SELECT *, lead(head) OVER (PARTITION BY key ORDER BY g) AS turned FROM a),
o AS (SELECT key, ts, open, greatest(high, open, turned) AS high, least(low, open, turned) AS low, close, volume FROM b WHERE way != 0)""",
    )
    _bars(
        "kagi_share", lambda d: bars.kagi(d, TICKS, share=0.5),
        f"""{numbered},
r AS (SELECT key, i, 0 AS g, price AS p0, price AS p1, 0 AS way FROM n WHERE i = 1 UNION ALL
    SELECT key, i, g + turn, CASE WHEN turn = 1 THEN p1 ELSE p0 END, CASE WHEN turn = 1 OR way = 0 OR (p - p1) * way > 0 THEN p ELSE p1 END, CASE WHEN way = 0 THEN sign(p - p0)::INT WHEN turn = 1 THEN -way ELSE way END
    FROM (SELECT n.key, n.i, r.g, r.p0, r.p1, r.way, n.price AS p, CASE WHEN r.way != 0 AND (r.p1 - n.price) * r.way > 0 AND (r.p1 - n.price) * r.way >= abs(r.p1) * 0.5::DOUBLE THEN 1 ELSE 0 END AS turn FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1)),
a AS (SELECT key, g, min(ts) AS ts, arg_min(p0, i) AS open, max(price) AS high, min(price) AS low, arg_max(p1, i) AS close, sum(volume) AS volume, arg_min(price, i) AS head, arg_max(way, i) AS way FROM r JOIN n USING (key, i) GROUP BY key, g),
b AS (SELECT *, lead(head) OVER (PARTITION BY key ORDER BY g) AS turned FROM a),
o AS (SELECT key, ts, open, greatest(high, open, turned) AS high, least(low, open, turned) AS low, close, volume FROM b WHERE way != 0)""",
    )
    _bars(
        "three_line_break", lambda d: bars.three_line_break(d, TICKS, 3),
        f"""{numbered},
r AS (SELECT key, i, -1 AS g, price AS a, price AS b, [price] AS hi, [price] AS lo, 0 AS way FROM n WHERE i = 1 UNION ALL
    SELECT key, i, CASE WHEN base IS NULL THEN g ELSE g + 1 END, coalesce(base, a), CASE WHEN base IS NULL THEN b ELSE p END,
        CASE WHEN base IS NULL THEN hi WHEN way = 0 THEN [greatest(base, p)] ELSE list_append(hi, greatest(base, p))[-3:] END,
        CASE WHEN base IS NULL THEN lo WHEN way = 0 THEN [least(base, p)] ELSE list_append(lo, least(base, p))[-3:] END,
        CASE WHEN base IS NULL THEN way WHEN way = 0 THEN sign(p - base)::INT WHEN base = b AND (p - b) * way > 0 THEN way ELSE -way END
    FROM (SELECT n.key, n.i, n.price AS p, r.g, r.a, r.b, r.hi, r.lo, r.way, CASE
        WHEN r.way = 0 THEN CASE WHEN n.price != r.a THEN r.a END
        WHEN r.way = 1 AND n.price > r.hi[-1] THEN r.b WHEN r.way = -1 AND n.price < r.lo[-1] THEN r.b
        WHEN r.way = 1 AND n.price <= list_min(r.lo) AND n.price < r.lo[-1] THEN r.a
        WHEN r.way = -1 AND n.price >= list_max(r.hi) AND n.price > r.hi[-1] THEN r.a END AS base FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1)),
o AS (SELECT key, min(ts) AS ts, arg_max(a, i) AS open, arg_max(hi[-1], i) AS high, arg_max(lo[-1], i) AS low, arg_max(b, i) AS close, sum(volume) AS volume FROM r JOIN n USING (key, i) GROUP BY key, greatest(g, 0) HAVING max(g) >= 0)""",
    )
    boxed = lambda share: f"""tr AS MATERIALIZED (SELECT key, ts, {RANGE} AS r FROM hb), {_ewm('ra', 'tr', 'r', 1 / 14)},
x AS MATERIALIZED (SELECT key, median(y) * {share} AS box FROM ra GROUP BY key), c AS MATERIALIZED (SELECT key, high, low, close, box, row_number() OVER {W} AS i FROM hb JOIN x USING (key))"""  # noqa: E731
    ALL["renko"] = (
        lambda spark, d: bricks.renko(candles(spark, d), BARS).select("key", "brick", _shown("price"), F.col("direction").cast("long").alias("direction"), "row"),
        f"""{TICKS_SQL}, {boxed('0.75::DOUBLE')},
r AS (SELECT key, 0::BIGINT AS i, close AS was, close AS level, 0 AS side, 0::BIGINT AS n, box FROM c WHERE i = 1 UNION ALL
    SELECT key, i, level, level + side * n * box, side, n, box FROM (SELECT *, CASE WHEN up >= 1 THEN 1 ELSE -1 END AS side, CASE WHEN up >= 1 THEN up ELSE greatest(down, 0) END AS n
        FROM (SELECT c.key, c.i, c.box, r.level, trunc((c.high - r.level) / c.box)::BIGINT AS up, trunc((r.level - c.low) / c.box)::BIGINT AS down FROM r JOIN c ON c.key = r.key AND c.i = r.i + 1))),
e AS (SELECT key, i, was, side, box, unnest(range(n)) AS j FROM r WHERE n > 0)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY i, j) - 1 AS brick, round(was + side * box * (j + 1), {DIGITS}) + 0.0 AS price, side::BIGINT AS direction, i - 1 AS row FROM e""",
    )
    ALL["point_and_figure"] = (
        lambda spark, d: bricks.exploded(bricks.point_and_figure(candles(spark, d), BARS), BARS).select("key", "column", "type", "start_idx", F.col("position").cast("long").alias("position"), _shown("price")),
        f"""{TICKS_SQL}, {boxed('1::DOUBLE')},
r AS (SELECT key, 0::BIGINT AS i, 0::DOUBLE AS was, round_even(close / box, 0) * box AS level, 0 AS way, 0::BIGINT AS n, -1::BIGINT AS col, 0::BIGINT AS first, box FROM c WHERE i = 1 UNION ALL
    SELECT key, i, level, level + side * n * box, CASE WHEN n > 0 THEN side ELSE way END, n, CASE WHEN n > 0 AND side != way THEN col + 1 ELSE col END, CASE WHEN n > 0 AND side != way THEN i - 1 ELSE first END, box
    FROM (SELECT *, CASE WHEN ahead > 0 THEN w ELSE -w END AS side, CASE WHEN ahead > 0 THEN ahead WHEN back >= 3 THEN back ELSE 0 END AS n
        FROM (SELECT *, CASE WHEN w > 0 THEN up ELSE down END AS ahead, CASE WHEN w > 0 THEN down ELSE up END AS back
            FROM (SELECT c.key, c.i, c.box, r.level, r.way, r.col, r.first, CASE WHEN r.way = 0 THEN 1 ELSE r.way END AS w, trunc((c.high - r.level) / c.box)::BIGINT AS up, trunc((r.level - c.low) / c.box)::BIGINT AS down FROM r JOIN c ON c.key = r.key AND c.i = r.i + 1)))),
e AS (SELECT *, unnest(range(n)) AS j FROM r WHERE n > 0)
SELECT key, col AS "column", CASE WHEN way > 0 THEN 'X' ELSE 'O' END AS type, first AS start_idx, row_number() OVER (PARTITION BY key, col ORDER BY i, j) - 1 AS position, round(was + way * box * (j + 1), {DIGITS}) + 0.0 AS price FROM e""",
    )


_register_bars()


def _register_summaries() -> None:
    shown = lambda df, *c: df.select("key", *[_shown(x) for x in c])
    sql = lambda made, *c: f"{TICKS_SQL}, o AS ({made}) SELECT key, " + ", ".join(f"round({x}::DOUBLE, {DIGITS}) + 0.0 AS {x}" for x in c) + " FROM o"
    ALL["volume_sum"] = (lambda spark, d: shown(summaries.volume_sum(ticks(spark, d), keys=("key",)), "volume_sum"), sql("SELECT key, sum(volume) AS volume_sum FROM ticks GROUP BY key", "volume_sum"))
    ALL["volume_weighted_price"] = (lambda spark, d: shown(summaries.volume_weighted_price(ticks(spark, d), keys=("key",)), "vwp"), sql("SELECT key, sum(price * volume) / sum(volume) AS vwp FROM ticks GROUP BY key", "vwp"))
    ALL["nan_bounds"] = (lambda spark, d: shown(rowwise.nan_bounds(candles(spark, d), keys=("key",)), "min_low", "max_high"), sql("SELECT key, min(low) AS min_low, max(high) AS max_high FROM hb GROUP BY key", "min_low", "max_high"))
    for how, name in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max"), ("count", "count")):
        ALL[f"group_{how}"] = (lambda spark, d, how=how: shown(summaries.group_aggregation(ticks(spark, d), "key", "price", how), "price"), sql(f"SELECT key, {name}(price) AS price FROM ticks GROUP BY key", "price"))
    ALL["nan_indices"] = (
        lambda spark, d: rowwise.missing_positions(candles(spark, d).withColumn("x", F.when(F.col("volume") % 3 != 0, F.col("close"))), "x", BARS).select("key", F.col("position").cast("long").alias("position")),
        f"{TICKS_SQL}, o AS (SELECT key, volume, row_number() OVER {W} - 1 AS position FROM hb) SELECT key, position FROM o WHERE volume % 3 = 0",
    )
    ALL["volume_profile"] = (
        lambda spark, d: summaries.volume_profile(ticks(spark, d), 20, keys=("key",)).select("key", F.col("bin").cast("long").alias("bin"), _shown("level"), _shown("volume"), _shown("poc")),
        f"""{TICKS_SQL}, b AS (SELECT key, min(price) AS lo, max(price) AS hi FROM ticks GROUP BY key),
p AS (SELECT key, least(floor((price - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, sum(volume)::DOUBLE AS v FROM ticks JOIN b USING (key) GROUP BY 1, 2),
g AS (SELECT key, lo, hi, unnest(range(20)) AS bin FROM b), f AS (SELECT g.key, g.bin, lo + (hi - lo) / 20 * (g.bin + 0.5::DOUBLE) AS level, coalesce(v, 0) AS volume FROM g LEFT JOIN p ON p.key = g.key AND p.bin = g.bin)
SELECT key, bin, round(level, {DIGITS}) + 0.0 AS level, volume, round(first_value(level) OVER (PARTITION BY key ORDER BY volume DESC, bin), {DIGITS}) + 0.0 AS poc FROM f""",
    )
    orders = lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"), "o_orderkey")
    o_sql = "SELECT o_orderpriority AS key, o_custkey::DOUBLE AS x, o_totalprice AS y, o_orderkey FROM orders"
    ALL["least_squares_fit"] = (lambda spark, d: shown(summaries.least_squares_fit(orders(spark, d), "x", "y", ("key",)), "slope", "intercept"), f"SELECT key, round(regr_slope(y, x), {DIGITS}) AS slope, round(regr_intercept(y, x), {DIGITS}) AS intercept FROM ({o_sql}) GROUP BY key")
    ALL["correlation"] = (lambda spark, d: shown(summaries.correlation(orders(spark, d), "x", "y", ("key",)), "correlation"), f"SELECT key, round(corr(y, x), {DIGITS}) AS correlation FROM ({o_sql}) GROUP BY key")
    ALL["trend_line"] = (
        lambda spark, d: summaries.trend_line(orders(spark, d), "x", "y", ("key",)).select("o_orderkey", F.round("trend", 4).alias("trend")),
        f"WITH o AS ({o_sql}), f AS (SELECT key, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM o GROUP BY key) SELECT o_orderkey, round(a * x + b, 4) AS trend FROM o JOIN f USING (key)",
    )
    powers = ", ".join([f"sum(z ** {k}) AS m{k}" for k in range(5)] + [f"sum(z ** {k} * y) AS r{k}" for k in range(3)])
    det = lambda a, b, c, d, e, f, g, h, i: f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"
    whole = det("m0", "m1", "m2", "m1", "m2", "m3", "m2", "m3", "m4")
    solved = (det("r0", "m1", "m2", "r1", "m2", "m3", "r2", "m3", "m4"), det("m0", "r0", "m2", "m1", "r1", "m3", "m2", "r2", "m4"), det("m0", "m1", "r0", "m1", "m2", "r1", "m2", "m3", "r2"))
    ALL["polynomial_fit_quadratic"] = (
        lambda spark, d: _polynomial(orders(spark, d), 2),
        f"WITH o AS ({o_sql}), c AS (SELECT avg(x) AS a, stddev_pop(x) AS b FROM o), p AS (SELECT o_orderkey, y, (x - a) / b AS z FROM o, c), m AS (SELECT {powers} FROM p), s AS (SELECT {', '.join(f'{d} / {whole} AS c{i}' for i, d in enumerate(solved))} FROM m) SELECT o_orderkey, round(c0 + c1 * z + c2 * z * z, 4) AS fitted FROM p, s",
    )
    ALL["polynomial_fit"] = (lambda spark, d: _polynomial(orders(spark, d)), f"WITH o AS ({o_sql}), m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM o) SELECT o_orderkey, round(a * x + b, 4) AS fitted FROM o, m")


def _polynomial(df: DataFrame, degree: int = 1) -> DataFrame:
    return summaries.polynomial_fit(df, "x", "y", degree)[1].select("o_orderkey", F.round("fitted", 4).alias("fitted"))


_register_summaries()


def daily_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: daily candles by series with their three-day average."""
    return _result(rolling.sma(candles(spark, sf_dir, "1d"), BARS, 3), "open", "high", "low", "close", "volume", "sma")


def _register_recipes() -> None:
    from .charts import geometry
    from .functions import tables
    from .plans import recipes

    ALL["daily_sma"] = (daily_sma, f"{TICKS_SQL}, a AS (SELECT key, time_bucket(INTERVAL '1 day', ts) AS ts, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2), o AS (SELECT *, {_full(3, 'avg', 'close')} AS sma FROM a) {_result_sql('o', 'open', 'high', 'low', 'close', 'volume', 'sma')}")
    ALL["last_rows"] = (lambda spark, d: _result(recipes.last_rows(candles(spark, d), BARS, 10), "close"), f"{TICKS_SQL}, o AS (SELECT * FROM hb QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC) <= 10) {_result_sql('o', 'close')}")
    ALL["dashboard"] = (
        lambda spark, d: recipes.dashboard(candles(spark, d), BARS).select("key", *[_shown(c) for c in recipes.DASHBOARD]),
        f"WITH x AS ({ALL['indicators_batch'][1]}) SELECT key, " + ", ".join(f"arg_max({c}, t) AS {c}" for c in recipes.DASHBOARD) + " FROM x GROUP BY key",
    )
    ALL["broken_candles"] = (lambda spark, d: _result(recipes.broken_rows(candles(spark, d).withColumn("high", F.when(F.col("volume") % 5 == 0, F.col("low") - 1).otherwise(F.col("high")))), "close"), f"{TICKS_SQL}, o AS (SELECT * FROM hb WHERE volume % 5 = 0) {_result_sql('o', 'close')}")
    x = "floor((i * slot) + slot * 0.2 / 2)"
    ALL["candle_geometry"] = (
        lambda spark, d: geometry.candles(candles(spark, d), BARS, 1280, 720).select("key", "row", "x_start", "x_end", "x_center", "y_high", "y_low", "y_open", "y_close", "volume_height", F.col("bullish").cast("int").alias("bullish")),
        f"""{TICKS_SQL}, a AS (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY key) AS n, min(low) OVER (PARTITION BY key) AS lo, max(high) OVER (PARTITION BY key) AS hi, max(volume) OVER (PARTITION BY key) AS top FROM hb),
b AS (SELECT *, 1280.0::DOUBLE / (n + 1) AS slot FROM a)
SELECT key, i AS row, {x}::BIGINT AS x_start, floor({x} + slot * 0.8)::BIGINT AS x_end, floor({x} + slot * 0.8 / 2)::BIGINT AS x_center,
    {', '.join(f'floor({int(720 * 0.7)} - ({c} - lo) / (hi - lo) * {int(720 * 0.7)})::BIGINT AS y_{c}' for c in ('high', 'low', 'open', 'close'))}, floor(volume / top::DOUBLE * 216)::BIGINT AS volume_height, (close >= open)::INT AS bullish FROM b""",
    )
    image = lambda spark, d, form, **more: recipes.charts(candles(spark, d), BARS, form, rows=None, **more)
    marks = lambda name: F.regexp_count(F.col("image").cast("string"), F.lit(f"<{name} ")).cast("long").alias(f"{name}s")
    counted = f"{TICKS_SQL}, a AS (SELECT key, count(*) AS n, count(*) FILTER (volume IS NOT NULL) AS v FROM hb GROUP BY key), g AS (SELECT *, 9 + (n + greatest(1, n // 20) - 1) // greatest(1, n // 20) AS grid FROM a)"
    ALL["charts_svg"] = (lambda spark, d: image(spark, d, "svg").select("key", marks("rect"), marks("line")), f"{counted} SELECT key, 1 + 2 * n AS rects, n + grid AS lines FROM g")
    # prices, averages of 5 and 10 rows, RSI with two levels, MACD: each line has a piece less than values
    ALL["charts_panels"] = (
        lambda spark, d: image(spark, d, "svg", sma=(5,), ema=(10,), panels=("rsi", "macd")).select("key", marks("rect"), marks("line")),
        f"{counted} SELECT key, 1 + n + greatest(n - 33, 0) AS rects, n + grid + greatest(n - 5, 0) + (n - 1) + 1 + 2 + (n - 1) + 1 + greatest(n - 26, 0) + greatest(n - 34, 0) AS lines FROM g",
    )
    head = lambda at: F.conv(F.hex(F.substring("image", at, 4)), 16, 10).cast("long")
    ALL["charts_png"] = (lambda spark, d: image(spark, d, "png").select("key", head(17).alias("width"), head(21).alias("height"), F.hex(F.substring("image", 2, 3)).alias("kind")), f"{TICKS_SQL} SELECT DISTINCT key, 640::BIGINT AS width, 360::BIGINT AS height, '504E47' AS kind FROM hb")
    placed = f"""{TICKS_SQL}, a AS (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY key) AS n, min(low) OVER (PARTITION BY key) AS lo, max(high) OVER (PARTITION BY key) AS hi,
    min(close) OVER (PARTITION BY key) AS clo, max(close) OVER (PARTITION BY key) AS chi, max(volume) OVER (PARTITION BY key) AS top FROM hb), b AS (SELECT *, 1280.0::DOUBLE / (n + 1) AS slot FROM a)"""
    mid = "floor((i + 0.5::DOUBLE) * slot)"
    ALL["ohlc_geometry"] = (
        lambda spark, d: geometry.ohlc_bars(candles(spark, d), BARS, 1280, 720).select("key", "row", "x_center", "x_left", "x_right", "y_high", "y_low", "y_open", "y_close", "volume_start", "volume_end", "volume_height", F.col("bullish").cast("int").alias("bullish")),
        f"""{placed} SELECT key, i AS row, {mid}::BIGINT AS x_center, trunc({mid} - slot * 0.4::DOUBLE)::BIGINT AS x_left, trunc({mid} + slot * 0.4::DOUBLE)::BIGINT AS x_right,
    {', '.join(f'floor({int(720 * 0.7)} - ({c} - lo) / (hi - lo) * {int(720 * 0.7)})::BIGINT AS y_{c}' for c in ('high', 'low', 'open', 'close'))},
    floor((i + 0.25::DOUBLE) * slot)::BIGINT AS volume_start, floor((i + 0.75::DOUBLE) * slot)::BIGINT AS volume_end, floor(volume / top::DOUBLE * 216)::BIGINT AS volume_height, (close >= open)::INT AS bullish FROM b""",
    )
    ALL["line_geometry"] = (
        lambda spark, d: geometry.line(candles(spark, d), BARS, 1280, 720),
        f"""{placed} SELECT key, i AS row, {mid}::BIGINT AS x, floor({int(720 * 0.7)} - (close - clo) / (chi - clo) * {int(720 * 0.7)})::BIGINT AS y, {x}::BIGINT AS volume_start, floor({x} + slot * 0.8::DOUBLE)::BIGINT AS volume_end, floor(volume / top::DOUBLE * 216)::BIGINT AS volume_height FROM b""",
    )
    ALL["grid_geometry"] = (
        lambda spark, d: geometry.grid(candles(spark, d), BARS, 1280, 720),
        f"""{TICKS_SQL}, a AS (SELECT key, count(*) AS n FROM hb GROUP BY key), h AS (SELECT key, unnest(range(1, 10)) AS i FROM a), v AS (SELECT key, n, unnest(range(0, n, greatest(1, n // 20))) AS i FROM a)
SELECT key, 0::BIGINT AS x1, (i * {int(720 * 0.7)} // 10)::BIGINT AS y1, 1280::BIGINT AS x2, (i * {int(720 * 0.7)} // 10)::BIGINT AS y2 FROM h UNION ALL
SELECT key, floor(i * (1280.0::DOUBLE / (n + 1)))::BIGINT, 0, floor(i * (1280.0::DOUBLE / (n + 1)))::BIGINT, {int(720 * 0.7)} FROM v""",
    )
    bricked = lambda spark, d: bricks.renko(candles(spark, d), BARS, 8.0).withColumn("price", _shown("price"))
    renko = ALL["renko"][1].replace("median(y) * 0.75::DOUBLE AS box", "8.0::DOUBLE AS box")
    ALL["renko_geometry"] = (
        lambda spark, d: geometry.renko_boxes(bricked(spark, d), BARS, 8.0, 1280, 720).withColumn("direction", F.col("direction").cast("long")),
        f"""WITH z AS ({renko}), b AS (SELECT *, 1280.0::DOUBLE / (count(*) OVER (PARTITION BY key) + 1) AS slot, min(price) OVER (PARTITION BY key) - 8 AS lo, max(price) OVER (PARTITION BY key) + 8 AS hi FROM z),
c AS (SELECT *, floor(brick * slot + slot * 0.2::DOUBLE / 2)::BIGINT AS x_start, floor({int(720 * 0.7)} - (price - lo) / (hi - lo) * {int(720 * 0.7)})::BIGINT AS y_start, greatest(floor(8::DOUBLE / (hi - lo) * {int(720 * 0.7)}), 1)::BIGINT AS deep FROM b)
SELECT key, brick, x_start, floor(x_start + slot * 0.8::DOUBLE)::BIGINT AS x_end, y_start, y_start + direction * deep AS y_end, direction FROM c""",
    )
    figure = ALL["point_and_figure"][1].replace("median(y) * 1::DOUBLE AS box", "8.0::DOUBLE AS box")
    ALL["point_and_figure_geometry"] = (
        lambda spark, d: geometry.point_and_figure_boxes(bricks.exploded(bricks.point_and_figure(candles(spark, d), BARS, 8.0), BARS), BARS, 8.0, 1280, 720),
        f"""WITH z AS ({figure}), b AS (SELECT *, 1280.0::DOUBLE / (max("column") OVER (PARTITION BY key) + 2) AS slot, min(price) OVER (PARTITION BY key) - 8 AS lo, max(price) OVER (PARTITION BY key) + 8 AS hi FROM z)
SELECT key, "column", position, type, floor(floor("column" * slot) + slot / 2)::BIGINT AS x_center, floor(720 - (price - lo) / (hi - lo) * 720)::BIGINT AS y_center, floor(slot * 0.8::DOUBLE)::BIGINT // 2 AS half_width, greatest(floor(8::DOUBLE / (hi - lo) * 720), 10)::BIGINT // 2 AS half_height FROM b""",
    )

    def by_table_function(spark: SparkSession, d: str) -> DataFrame:
        tables.register(spark)
        candles(spark, d).createOrReplaceTempView("barwright_candles")
        made = spark.sql("SELECT * FROM renko(TABLE(SELECT key, ts, high, low, close FROM barwright_candles) PARTITION BY (key) ORDER BY (ts), 8.0D, 1)")
        return made.select("key", "brick", _shown("price"), F.col("direction").cast("long").alias("direction"), "row")

    ALL["renko_table_function"] = (by_table_function, renko)
    enriched = ("atr", "rsi", "macd_line", "sma_5")
    ALL["chart_indicators"] = (
        lambda spark, d: _result(recipes.with_indicators(candles(spark, d), BARS, sma=(5,), panels=("rsi", "macd", "atr")), *enriched),
        f"WITH x AS ({ALL['indicators_batch'][1]}), y AS ({ALL['multiple_averages'][1]}) SELECT key, t, atr, rsi, macd_line, sma_5 FROM x JOIN y USING (key, t)",
    )


_register_recipes()


def queries() -> dict[str, Query]:
    return {name: made for name, (made, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
