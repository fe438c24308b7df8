"""Windowed indicators over candles (symbol, timeframe, ts, open, high, low, close, volume): each function adds columns.

All of them are Spark windows over the series, so Catalyst plans them as one sort and shuffle by series;
recursive ones are in `recursive`. What one function needs at several depths is staged in helper columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.scalars import clip, div, session_of
from .price import flag, warm_flag

DAYS = 252.0


def _typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def crossing(df: DataFrame, fast: str, slow: str, name: str) -> DataFrame:
    """State of fast against slow, crossings up and down between adjacent rows, and their relative spread; null in warm-up."""
    df = df.withColumn("_gap", F.col(fast) - F.col(slow))
    before, gap = W.lag("_gap"), F.col("_gap")
    known = before.isNotNull() & gap.isNotNull()
    return df.withColumns(
        {
            f"{name}_state": F.signum(gap), f"{name}_up": F.when(known, warm_flag((before <= 0) & (gap > 0))), f"{name}_down": F.when(known, warm_flag((before >= 0) & (gap < 0))),
            f"{name}_spread": div(gap, F.col(slow)),
        }
    ).drop("_gap")


def moving_averages(candles: DataFrame, periods=(10, 20, 50), vwaps=(20,)) -> DataFrame:
    """Simple averages with distance, slope and side; cumulative and rolling VWAP; crossings of neighbouring periods."""
    df = candles.withColumn("_pv", _typical() * F.col("volume")).withColumn("_cv", F.col("close") * F.col("volume"))
    for n in periods:
        df = df.withColumn(f"sma_{n}", W.mean("close", n))
        df = df.withColumns(
            {
                f"sma_distance_{n}": div(F.col("close") - F.col(f"sma_{n}"), F.col(f"sma_{n}")), f"sma_slope_{n}": F.col(f"sma_{n}") - W.lag(f"sma_{n}"),
                f"sma_close_above_{n}": warm_flag(F.col("close") > F.col(f"sma_{n}")),
            }
        )
    df = df.withColumn("vwap_cumulative", div(F.sum("_pv").over(W.so_far()), F.sum("volume").over(W.so_far())))
    df = df.withColumn("vwap_cumulative_distance", div(F.col("close") - F.col("vwap_cumulative"), F.col("vwap_cumulative")))
    for n in vwaps:
        df = df.withColumn(f"vwap_{n}", div(W.total("_pv", n), W.total("volume", n)))
        df = df.withColumns({f"vwap_distance_{n}": div(F.col("close") - F.col(f"vwap_{n}"), F.col(f"vwap_{n}")), f"volume_weighted_price_{n}": div(W.total("_cv", n), W.total("volume", n))})
    for fast, slow in zip(periods, periods[1:], strict=False):
        df = crossing(df, f"sma_{fast}", f"sma_{slow}", f"sma_cross_{fast}_{slow}")
    return df.drop("_pv", "_cv")


def momentum(candles: DataFrame, cci: int = 20, roc: int = 12, mom: int = 10, williams: int = 14, k: int = 14, d: int = 3) -> DataFrame:
    """CCI, rate of change, momentum, Williams %R and the stochastic oscillator."""
    df = candles.withColumn("_tp", _typical())
    df = df.withColumns({"_tpm": W.mean("_tp", cci), "_tps": F.collect_list("_tp").over(W.last(cci))})
    deviation = F.aggregate("_tps", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_tpm"))) / cci
    high, low = W.highest("high", williams), W.lowest("low", williams)
    kh, kl = W.highest("high", k), W.lowest("low", k)
    df = df.withColumns(
        {
            f"cci_{cci}": div(F.col("_tp") - F.col("_tpm"), 0.015 * deviation), f"roc_{roc}": 100 * div(F.col("close") - W.lag("close", roc), W.lag("close", roc)),
            f"momentum_{mom}": F.col("close") - W.lag("close", mom), f"williams_r_{williams}": -100 * div(high - F.col("close"), high - low),
            f"stochastic_k_{k}": 100 * div(F.col("close") - kl, kh - kl),
        }
    )
    return df.withColumn(f"stochastic_d_{d}", W.mean(f"stochastic_k_{k}", d)).drop("_tp", "_tpm", "_tps")


def channels(candles: DataFrame, bollinger: int = 20, width: float = 2.0, donchian: int = 20) -> DataFrame:
    """Bollinger bands (population deviation) and Donchian channels."""
    df = candles.withColumns({f"bollinger_mid_{bollinger}": W.mean("close", bollinger), "_sd": W.std("close", bollinger), f"donchian_high_{donchian}": W.highest("high", donchian), f"donchian_low_{donchian}": W.lowest("low", donchian)})
    mid, sd, top, bottom, c = F.col(f"bollinger_mid_{bollinger}"), F.col("_sd"), F.col(f"donchian_high_{donchian}"), F.col(f"donchian_low_{donchian}"), F.col("close")
    return df.withColumns(
        {
            f"bollinger_upper_{bollinger}": mid + width * sd, f"bollinger_lower_{bollinger}": mid - width * sd, f"bollinger_width_{bollinger}": div(2 * width * sd, mid),
            f"bollinger_percent_b_{bollinger}": div(c - (mid - width * sd), 2 * width * sd),
            f"donchian_mid_{donchian}": (top + bottom) / 2, f"donchian_width_{donchian}": div(top - bottom, c), f"donchian_position_{donchian}": div(c - bottom, top - bottom),
        }
    ).drop("_sd")


def volatility(candles: DataFrame, windows=(10, 20)) -> DataFrame:
    """Rolling deviations of close and log return, and the range of the window against the close."""
    df = candles.withColumn("_lr", W.log_returns("close"))
    for n in windows:
        df = df.withColumns({f"rolling_std_close_{n}": W.std("close", n), f"rolling_std_log_return_{n}": W.std("_lr", n), f"rolling_range_pct_{n}": div(W.highest("high", n) - W.lowest("low", n), F.col("close"))})
    return df.drop("_lr")


def ichimoku(candles: DataFrame, conversion: int = 9, base: int = 26, span: int = 52, shift: int = 26) -> DataFrame:
    """Ichimoku lines, all lagged so that nothing looks ahead."""
    def middle(n: int) -> Column:
        return (W.highest("high", n) + W.lowest("low", n)) / 2

    df = candles.withColumns({"ichimoku_tenkan": middle(conversion), "ichimoku_kijun": middle(base), "_b": middle(span)})
    df = df.withColumn("_a", (F.col("ichimoku_tenkan") + F.col("ichimoku_kijun")) / 2)
    df = df.withColumns({"ichimoku_senkou_a": W.lag("_a", shift), "ichimoku_senkou_b": W.lag("_b", shift), "ichimoku_chikou": W.lag("close", shift)})
    a, b, c = F.col("ichimoku_senkou_a"), F.col("ichimoku_senkou_b"), F.col("close")
    both = a.isNotNull() & b.isNotNull()
    return df.withColumns(
        {
            "ichimoku_cloud_width": F.when(both, div(F.greatest(a, b) - F.least(a, b), c)), "ichimoku_close_above_cloud": F.when(both, warm_flag(c > F.greatest(a, b))),
            "ichimoku_close_below_cloud": F.when(both, warm_flag(c < F.least(a, b))), "ichimoku_tenkan_kijun_spread": div(F.col("ichimoku_tenkan") - F.col("ichimoku_kijun"), F.col("ichimoku_kijun")),
        }
    ).drop("_a", "_b")


def volume_flow(candles: DataFrame, windows=(20,), mfi: int = 14, cmf: int = 20) -> DataFrame:
    """On-balance volume, money flow index, Chaikin money flow, signed volume and rolling volume statistics."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    df = candles.withColumns({"_tp": _typical(), "_step": F.coalesce(F.signum(c - W.lag("close")), F.lit(0.0)) * v, "volume_delta": F.signum(c - o) * v, "_mfv": div((c - l) - (h - c), h - l, 0.0) * v, "dollar_volume": c * v})
    before = W.lag("_tp")
    df = df.withColumns({"_up": F.when(F.col("_tp") > before, F.col("_tp") * v).otherwise(0.0), "_down": F.when(F.col("_tp") < before, F.col("_tp") * v).otherwise(0.0)})
    up, down = W.total("_up", mfi), W.total("_down", mfi)
    df = df.withColumns(
        {
            "obv": F.sum("_step").over(W.so_far()), "volume_delta_cumulative": F.sum("volume_delta").over(W.so_far()),
            f"mfi_{mfi}": F.when(down == 0, F.when(up > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + div(up, down))),
            f"cmf_{cmf}": div(W.total("_mfv", cmf), W.total("volume", cmf)),
            "volume_buy_ratio": F.when(c > o, 1.0).when(c < o, 0.0).otherwise(0.5),
        }
    )
    for n in windows:
        mean, total = W.mean("volume", n), W.total("volume_delta", n)
        df = df.withColumns(
            {
                f"volume_sma_{n}": mean, f"volume_ratio_{n}": div(v, mean), f"volume_zscore_{n}": div(v - mean, W.std("volume", n)),
                f"volume_delta_sum_{n}": total, f"volume_delta_ratio_{n}": div(total, W.total("volume", n)), f"dollar_volume_sma_{n}": W.mean("dollar_volume", n),
            }
        )
    return df.drop("_tp", "_step", "_mfv", "_up", "_down")


def structure(candles: DataFrame, swing: int = 10, levels: int = 20) -> DataFrame:
    """Support and resistance (extremes up to the bar before), breaks (0 in warm-up), swings, trend line and efficiency."""
    df = candles.withColumns({"_min": W.lowest("low", levels), "_max": W.highest("high", levels), "_sh": W.highest("high", swing), "_sl": W.lowest("low", swing), "_i": F.row_number().over(W.series()).cast("double"), "_step": F.abs(F.col("close") - W.lag("close"))})
    w, n = W.last(swing), F.count("close").over(W.last(swing))
    flat = F.var_pop("close").over(w) == 0
    df = df.withColumns(
        {
            "support": W.lag("_min"), "resistance": W.lag("_max"), "_slope": F.when(n == swing, F.regr_slope("close", "_i").over(w)),
            "trend_r2": F.when(n == swing, F.when(flat, 1.0).otherwise(F.regr_r2("close", "_i").over(w))),
            "efficiency": div(F.abs(F.col("close") - W.lag("close", swing)), W.total("_step", swing)),
            "_psh": W.lag("_sh"), "_psl": W.lag("_sl"),
        }
    )
    c, s, r = F.col("close"), F.col("support"), F.col("resistance")
    slope = div(F.col("_slope") * swing, c)
    return df.withColumns(
        {
            "support_distance": div(c - s, c), "resistance_distance": div(r - c, c), "channel_position": div(c - s, r - s), "break_resistance": flag(c > r), "break_support": flag(c < s),
            "swing_high": warm_flag(F.col("high") >= F.col("_sh")), "swing_low": warm_flag(F.col("low") <= F.col("_sl")),
            "higher_high": warm_flag(F.col("high") > F.col("_psh")), "lower_low": warm_flag(F.col("low") < F.col("_psl")),
            "trend_slope": slope, "trend_direction": F.signum(slope), "trend_strength": F.abs(slope) * F.col("trend_r2"),
        }
    ).drop("_min", "_max", "_sh", "_sl", "_i", "_step", "_slope", "_psh", "_psl")


def _variance_ratio(n: int) -> Column:
    """Of helper columns _lr (log return) and _lr2 (that of two bars): 1 where there is no variance."""
    width = max(n, 4)
    one, two = F.var_samp("_lr").over(W.last(width)), F.var_samp("_lr2").over(W.last(width - 1))
    return F.when(F.count("_lr").over(W.last(width)) == width, F.when(one <= 1e-16, 1.0).otherwise(two / (2 * one)))


def regime(candles: DataFrame, windows=(20,)) -> DataFrame:
    """Per window: mean and deviation of log returns, its percentile, efficiency, variance ratio, trend score and 0/1 flags."""
    df = candles.withColumns({"_lr": W.log_returns("close"), "_step": F.abs(F.col("close") - W.lag("close"))})
    df = df.withColumn("_lr2", F.col("_lr") + W.lag("_lr"))
    for n in windows:
        df = df.withColumns(
            {
                f"regime_return_mean_{n}": W.mean("_lr", n), f"regime_volatility_{n}": W.std("_lr", n), f"regime_variance_ratio_{n}": _variance_ratio(n),
                f"regime_efficiency_{n}": div(F.abs(F.col("close") - W.lag("close", n)), W.total("_step", n)),
                f"regime_range_width_{n}": div(W.highest("high", n) - W.lowest("low", n), F.col("close")), "_dir": F.signum(F.col("close") - W.lag("close", n)),
            }
        )
        e, ratio = F.col(f"regime_efficiency_{n}"), F.col(f"regime_variance_ratio_{n}")
        df = df.withColumns({f"regime_vol_percentile_{n}": W.percent_rank(f"regime_volatility_{n}", max(n, 20)), f"regime_trend_score_{n}": e * F.col("_dir")})
        score, rank = F.col(f"regime_trend_score_{n}"), F.col(f"regime_vol_percentile_{n}")
        df = df.withColumns(
            {
                f"regime_trend_up_{n}": flag(score > 0.35), f"regime_trend_down_{n}": flag(score < -0.35), f"regime_trending_{n}": flag((e >= 0.35) & (F.abs(score) >= 0.25)),
                f"regime_mean_reverting_{n}": flag(e.isNotNull() & (F.coalesce(e < 0.25, F.lit(False)) | F.coalesce(ratio < 0.85, F.lit(False)))), f"regime_range_{n}": flag(e < 0.25),
                f"regime_high_vol_{n}": flag(rank >= 0.75), f"regime_low_vol_{n}": flag(rank <= 0.25),
            }
        )
    return df.drop("_lr", "_lr2", "_step", "_dir")


def volatility_gauge(candles: DataFrame, window: int = 20, lookback: int = 252) -> DataFrame:
    """A volatility index without options: realised and Parkinson volatility, their percentile in the lookback, stress and calm."""
    n, back = max(window, 2), max(lookback, window + 2)
    year = math.sqrt(DAYS)
    ratio = div(F.col("high"), F.col("low"))
    df = candles.withColumns({"_lr": W.log_returns("close"), "_hl": F.when(ratio > 0, F.pow(F.ln(ratio), F.lit(2.0)))})
    df = df.withColumns({"gauge_realized": W.std("_lr", n) * year, "gauge_parkinson": F.sqrt(W.mean("_hl", n) / (4 * math.log(2))) * year, "_long": W.std("_lr", max(3 * n, 6)) * year})
    df = df.withColumns({"gauge_percentile": W.percent_rank("gauge_realized", back), "gauge_vol_of_vol": W.std("gauge_realized", n), "gauge_term_structure": div(F.col("gauge_realized"), F.col("_long"))})
    p = F.col("gauge_percentile")
    return df.withColumns({"gauge": 100 * clip(p, 0.0, 1.0), "gauge_stress": flag(p >= 0.8), "gauge_calm": flag(p <= 0.2)}).drop("_lr", "_hl", "_long")


#: First and last hour of each session (UTC).
SESSION_HOURS = {"asia": (0, 7), "london": (7, 12), "london_ny_overlap": (12, 17), "new_york": (17, 22), "off_hours": (22, 24)}


def calendar(candles: DataFrame) -> DataFrame:
    """Hour, weekday (Monday 0), month and day with their sines and cosines, weekend, session, minutes into it and progress."""
    ts = F.col("ts")
    hour, weekday, month, day = F.hour(ts), F.weekday(ts), F.month(ts), F.dayofmonth(ts)
    session = session_of(hour)

    def bound(k: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for name, hours in SESSION_HOURS.items() for x in (name, float(hours[k]))]), session)

    now = hour + F.minute(ts) / 60.0

    def circle(name: str, value: Column, length: float) -> dict[str, Column]:
        return {f"{name}_sin": F.sin(value * (2 * math.pi / length)), f"{name}_cos": F.cos(value * (2 * math.pi / length))}

    return candles.withColumns(
        {
            "hour": hour, "weekday": weekday, "month": month, "day_of_month": day, "is_weekend": flag(weekday >= 5), "is_month_start": flag(day <= 3), "is_month_end": flag(day >= 28),
            **circle("hour", hour.cast("double"), 24.0), **circle("weekday", weekday.cast("double"), 7.0), **circle("month", month - 1.0, 12.0), **circle("day", day - 1.0, 31.0),
            "session": session, "session_asian": flag(session == "asia"), "session_european": flag(session.isin("london", "london_ny_overlap")), "session_american": flag(session.isin("london_ny_overlap", "new_york")),
            "minutes_into_session": F.greatest(F.lit(0.0), (now - bound(0)) * 60), "session_progress": clip((now - bound(0)) / (bound(1) - bound(0)), 0.0, 1.0),
        }
    )


def sessions(candles: DataFrame) -> DataFrame:
    """Islands of equal sessions, and return, range and distances since the island's first bar."""
    df = candles.withColumn("_s", session_of(F.hour("ts")))
    df = df.withColumn("session_transition", flag(F.col("_s") != W.lag("_s")))
    df = df.withColumn("session_block", F.sum("session_transition").over(W.so_far()).cast("long"))
    w = Window.partitionBy(*W.SERIES, "session_block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_o": F.first("open").over(w), "_h": F.max("high").over(w), "_l": F.min("low").over(w)})
    o, h, l, c = F.col("_o"), F.col("_h"), F.col("_l"), F.col("close")
    return df.withColumns(
        {"session_return": div(c - o, o), "session_range_pct": div(h - l, o), "session_dist_from_high": div(h - c, o), "session_dist_from_low": div(c - l, o), "session_close_location": div(c - l, h - l, 0.5)}
    ).drop("_s", "_o", "_h", "_l")


def microstructure(candles: DataFrame, windows=(10,)) -> DataFrame:
    """Close location, book or proxy imbalance, tick-rule sign (a zero tick keeps the last sign), signed volume, spread dynamics.

    With columns bid_volume and ask_volume the book is used where both are there, else the close's place in the range.
    A missing or non-positive spread is replaced by the bar's range.
    """
    h, l, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    place = clip(div(c - l, F.greatest(h - l, F.lit(1e-12)), 0.5), 0.0, 1.0)
    book = {"bid_volume", "ask_volume"} <= set(candles.columns)
    here = (F.col("bid_volume").isNotNull() & F.col("ask_volume").isNotNull()) if book else F.lit(False)
    buy, sell = (F.when(here, F.col("bid_volume")).otherwise(place * v), F.when(here, F.col("ask_volume")).otherwise((1 - place) * v)) if book else (place * v, (1 - place) * v)
    spread = F.col("spread") if "spread" in candles.columns else F.lit(None).cast("double")
    df = candles.withColumns({"micro_clv": place, "micro_buy_volume": buy, "micro_sell_volume": sell, "micro_spread": F.when(spread > 0, spread).otherwise(h - l), "_tick": F.nullif(F.signum(c - W.lag("close")), F.lit(0.0)), "micro_has_book": flag(here)})
    df = df.withColumn("micro_tick_sign", F.coalesce(F.last("_tick", ignorenulls=True).over(W.so_far()), F.lit(0.0)))
    b, s, q = F.col("micro_buy_volume"), F.col("micro_sell_volume"), F.col("micro_spread")
    df = df.withColumns(
        {
            "micro_bid_ask_ratio": div(b, s, 1.0), "micro_imbalance": div(b - s, F.greatest(b + s, F.lit(1e-12)), 0.0), "micro_signed_volume": F.col("micro_tick_sign") * v,
            "micro_relative_spread": div(q, c), "micro_spread_change": q - W.lag("micro_spread"),
        }
    )
    for n in windows:
        mean, quoted, signed = W.mean("micro_imbalance", n), W.mean("micro_spread", n), W.total("micro_signed_volume", n)
        df = df.withColumns(
            {
                f"micro_imbalance_sma_{n}": mean, f"micro_imbalance_zscore_{n}": div(F.col("micro_imbalance") - mean, W.std("micro_imbalance", n)),
                f"micro_buy_sell_ratio_{n}": div(W.total("micro_buy_volume", n), W.total("micro_sell_volume", n), 1.0), f"micro_signed_sum_{n}": signed,
                f"micro_signed_ratio_{n}": div(signed, W.total("volume", n), 0.0), f"micro_spread_sma_{n}": quoted,
                f"micro_spread_zscore_{n}": div(q - quoted, W.std("micro_spread", n)), f"micro_spread_widening_{n}": flag(q > quoted), f"micro_spread_std_{n}": W.std("micro_spread", n),
            }
        )
    return df.drop("_tick")
