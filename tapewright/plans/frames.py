"""The driver's events rewritten as wire frames, including frames the decoder has to refuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.plans import views
from tapewright.session import cut_lineage


def _frame(channel: Column | str, data: Column) -> Column:
    name = F.lit(channel) if isinstance(channel, str) else channel
    return F.to_json(F.struct(name.alias("channel"), data.alias("data")), {"ignoreNullFields": "false"})


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _level(px: Column, sz: Column) -> Column:
    return F.struct(_text(px).alias("px"), _text(sz).alias("sz"), F.lit(1).alias("n"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames as a written capture, the way a recorder leaves them."""
    key = (spark.sparkContext.applicationId, sf_dir, "frames")
    if key not in views._TABLES:
        views._TABLES[key] = cut_lineage(build_frames(spark, sf_dir))
    return views._TABLES[key]


def build_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per event: which channel follows from the event type, some are broken on purpose."""
    rows = views._events(spark, sf_dir, ["purchase", "click", "view", "signup", "error"])
    k, px, seq = F.col("k"), F.col("px"), F.col("ingest_seq")
    side = F.when(k == 50, "X").when(k % 2 == 0, "B").otherwise("A")
    trade = F.struct(
        F.col("symbol").alias("coin"), side.alias("side"), F.when(k == 51, "-1").otherwise(_text(px)).alias("px"),
        _text(k % 9 + F.lit(1.0)).alias("sz"), F.concat(F.lit("0x"), F.hex(seq)).alias("hash"), F.col("ms").alias("time"), seq.alias("tid"),
    )
    trades = _frame("trades", F.array(trade, trade.withField("tid", seq + 10_000_000)))
    bid, ask = px * 0.999, F.when(k == 60, px * 0.5).otherwise(px * 1.001)
    size = (seq % 60 + 1).cast("double")
    quote = F.struct(
        F.col("symbol").alias("coin"), F.col("ms").alias("time"), F.array(_level(bid, size), F.when(seq % 5 != 0, _level(ask, size))).alias("bbo")
    )
    lower = F.when(k == 61, px * 1.5).otherwise(px * 0.99)
    book = F.struct(
        F.col("symbol").alias("coin"), F.col("ms").alias("time"),
        F.array(F.array(_level(bid, size), _level(lower, F.lit(0.0))), F.array(_level(px * 1.001, size), _level(px * 1.01, size))).alias("levels"),
    )
    mids = F.struct(F.create_map(F.col("symbol"), _text(px), F.concat(F.lit("Z"), "symbol"), F.when(k == 62, "nan").otherwise(_text(px * 2))).alias("mids"))
    context = F.struct(
        F.col("symbol").alias("coin"),
        F.struct(
            F.when(k == 63, F.lit("-5")).otherwise(_text(k * 1000)).alias("dayNtlVlm"), F.when(k % 7 == 0, "0").otherwise(_text(px)).alias("markPx"),
            F.when(k % 5 != 0, _text(px)).alias("midPx"), F.lit("").alias("circulatingSupply"),
        ).alias("ctx"),
    )
    open_ts = F.expr("ms div 60000 * 60000")
    candle = F.struct(
        _text(open_ts).alias("t"), _text(open_ts + 59_999).alias("T"), F.col("symbol").alias("s"), F.lit("1m").alias("i"), _text(px).alias("o"),
        _text(F.when(k == 64, px * 9).otherwise(px)).alias("c"), _text(px * 1.01).alias("h"), _text(px * 0.99).alias("l"), _text(k).alias("v"), _text(k + 1).alias("n"),
    )
    candles = F.when(k % 2 == 0, _frame("candle", candle)).otherwise(_frame("candle", F.array(candle)))
    other = F.when(k % 3 == 0, "pong").when(k % 3 == 1, "userFills").otherwise("l4Book")
    kind = F.col("event_type")
    value = (
        F.when(kind == "purchase", trades)
        .when((kind == "signup") & (k < 70), _frame("bbo", quote))
        .when(kind == "signup", _frame("l2Book", book))
        .when((kind == "click") & (k < 50), _frame("allMids", mids))
        .when(kind == "click", _frame(F.when(k % 2 == 0, "activeAssetCtx").otherwise("activeSpotAssetCtx"), context))
        .when(kind == "view", candles)
        .otherwise(_frame(other, F.create_map(F.lit("x"), F.lit("y"))))
    )
    return rows.select(
        value.alias("value"), (F.col("ms") * 1_000_000).alias("recv_ts_ns"), F.lit(1).cast("long").alias("conn_id"), seq.alias("seq")
    )
