"""What a symbol is and when it trades: market type with a confidence, currency pairs, and sessions of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import symbols as Y
from ..functions import windows as W

#: Words of a symbol's path that speak for a market, with their weight.
PATHS = {"FOREX": ("forex", 0.4), "CRYPTO": ("crypto", 0.5), "INDEX": ("ind", 0.5), "COMMODITY": ("commod|metal|energ", 0.5), "STOCK": ("stock|share|equit", 0.5), "FUTURES": ("futur", 0.4)}
#: Sessions of a day by first and last hour (UTC), both included; one wraps past midnight.
SESSIONS = {"asian": (0, 9), "european": (7, 16), "us": (13, 22), "pacific": (22, 6)}


def market_type(symbol: Column, path: Column) -> Column:
    """struct(market_type, confidence): the market that speaks loudest, the first of PATHS on a tie; UNKNOWN and 0 below 0.5.

    A pair of currencies counts 0.6 for FOREX, a coin against a currency 0.5, an index or commodity name 0.5, letters and a
    number 0.3 for FUTURES and a leading slash 0.6, one to five letters that are no pair 0.4 for STOCK.
    """
    kind, where = Y.asset_class(Y.canonical(symbol)), F.lower(F.coalesce(path, F.lit("")))
    name = F.upper(F.trim(F.coalesce(symbol, F.lit(""))))
    shape = {
        "FOREX": F.when(kind == "FOREX", 0.6), "CRYPTO": F.when(kind == "CRYPTO", 0.5), "INDEX": F.when(kind == "INDEX", 0.5), "COMMODITY": F.when(kind.isin("METAL", "ENERGY"), 0.5),
        "STOCK": F.when(name.rlike("^[A-Z]{1,5}$") & (kind == "UNKNOWN"), 0.4), "FUTURES": F.when(name.startswith("/"), 0.6).when(name.rlike("^[A-Z]{1,2}[0-9]{2,4}$"), 0.3),
    }
    options = []
    for k, (market, (words, weight)) in enumerate(PATHS.items()):
        total = F.coalesce(shape[market], F.lit(0.0)) + F.when(where.rlike(words), weight).otherwise(0.0)
        options.append(F.struct(F.least(F.lit(1.0), total).alias("confidence"), F.lit(-k).alias("order"), F.lit(market).alias("market_type")))
    best = F.array_max(F.array(*options))
    sure = best["confidence"] >= 0.5
    return F.struct(F.when(sure, best["market_type"]).otherwise("UNKNOWN").alias("market_type"), F.when(sure, best["confidence"]).otherwise(0.0).alias("confidence"))


def currency_pair(symbol: Column) -> Column:
    """struct(base, quote, kind): major if one side is USD and both are among the eight most traded, cross without USD, else exotic; nulls if it is no pair."""
    majors = Y.CURRENCIES[:8]
    pair = Y.legs(Y.canonical(symbol))
    both = pair["base"].isin(*majors) & pair["quote"].isin(*majors)
    usd = (pair["base"] == "USD") | (pair["quote"] == "USD")
    return F.struct(pair["base"].alias("base"), pair["quote"].alias("quote"), F.when(pair["base"].isNull(), None).when(both & usd, "major").when(both, "cross").otherwise("exotic").alias("kind"))


def trading_sessions(candles: DataFrame) -> DataFrame:
    """Per series, day and session: bars, first and last time, and the session's open, high, low and close.

    A bar counts in each session whose hours hold it, so overlaps appear in both; on Saturday and Sunday there is one session, weekend.
    """
    hour = F.hour("ts")

    def inside(a: int, b: int) -> Column:
        now = hour + F.minute("ts") / 60.0
        return (now >= a) & (now <= b) if a < b else (now >= a) | (now <= b)

    open_ = F.array_compact(F.array(*[F.when(inside(a, b), F.lit(name)) for name, (a, b) in SESSIONS.items()]))
    named = F.when(F.weekday("ts") >= 5, F.array(F.lit("weekend"))).otherwise(open_)
    rows = candles.withColumn("session", F.explode(named))
    return rows.groupBy(*W.SERIES, F.date_trunc("day", "ts").alias("day"), "session").agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
    )


def overlaps(sessions: DataFrame) -> DataFrame:
    """Per series and day, pairs of sessions whose times overlap, and from when to when. A day has five sessions at most."""
    other = sessions.select(*W.SERIES, "day", F.col("session").alias("_s"), F.col("first_ts").alias("_f"), F.col("last_ts").alias("_l"))
    both = sessions.join(other, [*W.SERIES, "day"]).filter((F.col("session") < F.col("_s")) & (F.col("first_ts") <= F.col("_l")) & (F.col("_f") <= F.col("last_ts")))
    return both.select(*W.SERIES, "day", F.col("session").alias("session_a"), F.col("_s").alias("session_b"), F.greatest("first_ts", "_f").alias("from_ts"), F.least("last_ts", "_l").alias("to_ts"))
