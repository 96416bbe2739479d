"""Candle and tape analytics per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.errors import ContractError
from tapewright.functions.common import EPSILON, choose, clamp, or_zero, signed
from tapewright.operators.ordered import newest_per_key

# Selectable chart windows, chart cap and tail length.
CHART_WINDOWS = (1, 5, 15, 30, 60)

# Milliseconds per candle interval; the month is the shortest one.
INTERVAL_MS = {
    "1m": 60_000,
    "3m": 180_000,
    "5m": 300_000,
    "15m": 900_000,
    "30m": 1_800_000,
    "1h": 3_600_000,
    "2h": 7_200_000,
    "4h": 14_400_000,
    "8h": 28_800_000,
    "12h": 43_200_000,
    "1d": 86_400_000,
    "3d": 259_200_000,
    "1w": 604_800_000,
    "1M": 2_419_200_000,
}


def recent_candles(candles: DataFrame, interval: str = "1m", n: int = 30) -> DataFrame:
    """Newest ``n`` candles of one interval per symbol."""
    if n not in CHART_WINDOWS:
        raise ContractError(f"chart window must be one of {CHART_WINDOWS}")
    rows = candles.filter(F.col("interval") == interval)
    return newest_per_key(rows, ["symbol"], [F.col("open_ts_ms").desc()], n)


def _volume() -> Column:
    return F.greatest(F.col("volume_base"), F.lit(0.0))


def candle_summary(candles: DataFrame) -> DataFrame:
    """Move, range, trend, VWAP, range position and volume pulse of the candles in view."""
    stats = candles.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("candles"),
        F.min_by("open", "open_ts_ms").alias("first_open"),
        F.max_by("close", "open_ts_ms").alias("last_close"),
        F.max_by(_volume(), F.col("open_ts_ms")).alias("last_volume"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum(_volume()).alias("total_volume"),
        F.sum(F.col("close") * _volume()).alias("_pv"),
    )
    start, last, high, low = (F.col(c) for c in ("first_open", "last_close", "high", "low"))
    opened = F.when(F.abs(start) > EPSILON, start)
    average = F.col("total_volume") / F.col("candles")
    range_pct = F.abs(high - low) / F.abs(opened) * 100
    spread = F.when(F.abs(high - low) >= EPSILON, high - low)
    return stats.withColumns(
        {
            "move": last - start,
            "trend_pct": (last - start) / opened * 100,
            "range_pct": range_pct,
            "vwap": F.coalesce(F.col("_pv") / F.when(F.col("total_volume") > 0, F.col("total_volume")), last),
            "range_pos": F.coalesce(clamp((last - low) / spread, 0.0, 1.0), F.lit(0.5)),
            "average_volume": average,
            "volume_pulse": or_zero(F.col("last_volume") / F.when(average > 0, average)),
            "volatility": choose(
                [(range_pct >= 2.0, "hot"), (range_pct >= 0.5, "active"), (range_pct.isNotNull(), "quiet")], "unknown"
            ),
        }
    ).drop("_pv")


def candle_structure(candles: DataFrame) -> DataFrame:
    """Higher highs and lower lows between neighbouring candles."""
    order = Window.partitionBy("symbol").orderBy("open_ts_ms")
    pairs = candles.withColumns({"_h": F.lag("high").over(order), "_l": F.lag("low").over(order)})
    counts = pairs.groupBy("symbol").agg(
        F.count_if(F.col("high") > F.col("_h")).alias("higher_highs"),
        F.count_if(F.col("low") < F.col("_l")).alias("lower_lows"),
    )
    ups, downs = F.col("higher_highs"), F.col("lower_lows")
    return counts.withColumn(
        "structure", choose([(ups > downs, "up-structure"), (ups < downs, "down-structure")], "balanced-structure")
    )


def volume_profile(candles: DataFrame, buckets: int = 6) -> DataFrame:
    """Volume per close-price bucket and the point of control; higher bucket wins ties."""
    view = Window.partitionBy("symbol")
    rows = candles.withColumns({"_low": F.min("low").over(view), "_high": F.max("high").over(view)})
    flat = F.abs(F.col("_high") - F.col("_low")) < EPSILON
    width = F.col("_high") - F.col("_low")
    price = F.least(F.greatest(F.col("close"), F.col("_low")), F.col("_high"))
    index = F.least(F.floor((price - F.col("_low")) / width * buckets), F.lit(buckets - 1)).cast("int")
    rows = rows.withColumn("bucket", F.when(flat, 0).otherwise(index))
    per = rows.groupBy("symbol", "bucket").agg(
        F.sum(_volume()).alias("volume"), F.first("_low").alias("_low"), F.first("_high").alias("_high")
    )
    poc = F.max_by("bucket", F.struct("volume", "bucket")).over(view)
    step = width / buckets
    return per.withColumn("poc_bucket", poc).select(
        "symbol",
        "bucket",
        "volume",
        "poc_bucket",
        F.when(flat, F.col("_low")).otherwise(F.col("_low") + step * (F.col("poc_bucket") + 0.5)).alias("poc_price"),
    )


def orderflow_by_candle(candles: DataFrame, trades: DataFrame, bucket_ms: int) -> DataFrame:
    """Buy and sell prints inside each candle ``[open, close]``; candles without prints stay.

    Candles are spread over the time buckets they touch, trades belong to one bucket, so the range
    condition becomes an equi-join. It is an inner join reduced per candle before the candles are
    joined back, so a hot bucket can be split by adaptive execution.
    """
    spans = candles.select("symbol", "interval", "open_ts_ms", "close_ts_ms").withColumn(
        "_bucket",
        F.explode(F.sequence(F.expr(f"open_ts_ms div {bucket_ms}"), F.expr(f"close_ts_ms div {bucket_ms}"))),
    )
    prints = trades.select(
        "symbol", "exchange_ts_ms", "side", "notional", F.expr(f"exchange_ts_ms div {bucket_ms}").alias("_bucket")
    )
    inside = spans.join(prints, ["symbol", "_bucket"]).filter(
        F.col("exchange_ts_ms").between(F.col("open_ts_ms"), F.col("close_ts_ms"))
    )
    buy = F.col("side") == "buy"
    key = ["symbol", "interval", "open_ts_ms"]
    flow = inside.groupBy(*key).agg(
        F.sum(F.when(buy, F.col("notional"))).alias("buy_notional"),
        F.sum(F.when(~buy, F.col("notional"))).alias("sell_notional"),
        F.count_if(buy).alias("buy_count"),
        F.count_if(~buy).alias("sell_count"),
    )
    rows = candles.select(*key, "close_ts_ms").join(flow, key, "left")
    filled = {c: or_zero(c) for c in ("buy_notional", "sell_notional")}
    filled |= {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("buy_count", "sell_count")}
    rows = rows.withColumns(filled)
    b, s = F.col("buy_notional") > 0, F.col("sell_notional") > 0
    return rows.withColumns(
        {
            "net_notional": F.col("buy_notional") - F.col("sell_notional"),
            "marker": choose([(b & s, "X"), (b, "B"), (s, "S")], "·"),
        }
    )


def tape_velocity(trades: DataFrame) -> DataFrame:
    """Prints and notional per second, largest print and skew; the window is at least one second."""
    size = F.greatest(F.col("notional"), F.lit(0.0))
    stats = trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("prints"),
        (F.max("exchange_ts_ms") - F.min("exchange_ts_ms")).alias("_span"),
        F.sum(size).alias("total_notional"),
        F.max(size).alias("largest"),
        F.sum(signed("side", "notional")).alias("net_notional"),
    )
    seconds = F.greatest(F.greatest(F.col("_span"), F.lit(1)) / 1000, F.lit(1.0))
    total = F.when(F.col("total_notional") > 0, F.col("total_notional"))
    return stats.withColumns(
        {
            "window_secs": seconds,
            "prints_per_sec": F.col("prints") / seconds,
            "notional_per_sec": F.col("total_notional") / seconds,
            "skew": or_zero(F.col("net_notional") / total),
        }
    ).drop("_span")


def trade_pressure(trades: DataFrame) -> DataFrame:
    buy = F.col("side") == "buy"
    stats = trades.groupBy("symbol").agg(
        or_zero(F.sum(F.when(buy, F.col("notional")))).alias("buy_notional"),
        or_zero(F.sum(F.when(~buy, F.col("notional")))).alias("sell_notional"),
        F.count_if(buy).alias("buy_count"),
        F.count_if(~buy).alias("sell_count"),
    )
    b, s = F.col("buy_notional"), F.col("sell_notional")
    total = F.when(b + s > 0, b + s)
    return stats.withColumns(
        {
            "buy_share": or_zero(b / total),
            "sell_share": or_zero(s / total),
            "skew": or_zero((b - s) / total),
            "net_notional": b - s,
        }
    )


def print_ladder(trades: DataFrame, k: int = 4) -> DataFrame:
    """Notional per price level (equal to seven decimals), top ``k`` prices per symbol."""
    buy, size = F.col("side") == "buy", F.greatest(F.col("notional"), F.lit(0.0))
    levels = (
        trades.filter(F.abs("price") < float("inf"))
        .groupBy("symbol", F.round("price", 7).alias("level"))
        .agg(
            or_zero(F.sum(F.when(buy, size))).alias("buy_notional"),
            or_zero(F.sum(F.when(~buy, size))).alias("sell_notional"),
        )
        .withColumn("level_notional", F.col("buy_notional") + F.col("sell_notional"))
    )
    # The largest level per symbol is its own small aggregate, so top-k can prune before the shuffle.
    largest = levels.groupBy("symbol").agg(F.max("level_notional").alias("_max"), F.count(F.lit(1)).alias("levels"))
    top = newest_per_key(levels, ["symbol"], [F.col("level").desc()], k).join(largest, "symbol")
    ratio = clamp(F.col("level_notional") / F.when(F.col("_max") > 0, F.col("_max")), 0.0, 1.0)
    return top.withColumn("ratio", or_zero(ratio)).drop("_max")


def recent_trades(trades: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` trades per symbol by (time, trade id)."""
    if n < 1:
        raise ContractError("number of trades must be at least 1")
    order = [F.col("exchange_ts_ms").desc(), F.col("tid").desc()]
    return newest_per_key(trades, ["symbol"], order, n)


def spark_ratio(candles: DataFrame, n: int) -> DataFrame:
    """Close normalised to 0..1 over the newest ``n`` candles, with an eight-step level."""
    rows = newest_per_key(candles.filter(F.abs("close") < float("inf")), ["symbol"], [F.col("open_ts_ms").desc()], n)
    view = Window.partitionBy("symbol")
    low, high = F.min("close").over(view), F.max("close").over(view)
    rows = rows.withColumns({"_low": low, "_range": high - low})
    ratio = (F.col("close") - F.col("_low")) / F.when(F.col("_range") >= EPSILON, F.col("_range"))
    level = F.coalesce(F.round(clamp(ratio, 0.0, 1.0) * 7.0), F.lit(3.0)).cast("int")
    return rows.withColumn("ratio", ratio).withColumn("level", level).drop("_low", "_range")


def relative_volume(candles: DataFrame) -> DataFrame:
    """Volume of each candle against the largest in view."""
    most = F.max("volume_base").over(Window.partitionBy("symbol"))
    return candles.withColumn("_max", most).withColumn(
        "relative_volume", F.col("volume_base") / F.when(F.col("_max") > 0, F.col("_max"))
    ).drop("_max")


def live_tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Newest ``n`` trades or candles per symbol."""
    return newest_per_key(df, ["symbol"], [F.col(c).desc() for c in order], n)
