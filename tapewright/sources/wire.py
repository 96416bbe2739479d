"""Wire frames to typed event tables.

A frame is one JSON envelope ``{channel, data}``. All channels are decoded in one projection; the
tables and the rejects are filters over it. ``split_events`` writes what a batch decodes to once, so that its seven
tables read columns instead of decoding every frame again. A frame with one bad element is rejected as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.session import cut_lineage

# Channels of the feed.
CONTEXT_CHANNELS = ["activeAssetCtx", "activeSpotAssetCtx"]
CONTROL_CHANNELS = ["subscriptionResponse", "pong"]
PRIVATE_CHANNELS = ["userFills", "userEvents", "orderUpdates", "openOrders", "notification"]
DATA_CHANNELS = ["trades", "bbo", "l2Book", "allMids", *CONTEXT_CHANNELS, "candle"]
MAX_BOOK_LEVELS = 20

LEVEL = "struct<px:string,sz:string,n:bigint>"
# A map, because the keys ``t`` and ``T`` differ only in case.
CANDLE = "map<string,string>"
PAYLOAD = {
    "trades": "array<struct<coin:string,side:string,px:string,sz:string,hash:string,time:bigint,tid:bigint>>",
    "bbo": f"struct<coin:string,time:bigint,bbo:array<{LEVEL}>>",
    "l2Book": f"struct<coin:string,time:bigint,levels:array<array<{LEVEL}>>>",
    "allMids": "struct<mids:map<string,string>>",
    "context": "struct<coin:string,ctx:struct<dayNtlVlm:string,prevDayPx:string,markPx:string,midPx:string,circulatingSupply:string>>",
    "candle": f"array<{CANDLE}>",
}
BUY, SELL = ["B", "buy", "Buy"], ["A", "sell", "Sell"]
# Keeps the order of the elements of one frame: up to a million per frame.
SLOT = 2**20


def number(c: Column) -> Column:
    """Finite double from text, null when it is not one."""
    value = c.try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def _positive(c: Column) -> Column:
    return F.coalesce(number(c) > 0, F.lit(False))


def _not_negative(c: Column) -> Column:
    return F.coalesce(number(c) >= 0, F.lit(False))


def _absent(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _since_epoch(c: Column) -> Column:
    return F.coalesce(c >= 0, F.lit(False))


def _good_trade(t: Column) -> Column:
    return (
        t["coin"].isNotNull()
        & t["hash"].isNotNull()
        & t["tid"].isNotNull()
        & t["side"].isin(*BUY, *SELL)
        & _since_epoch(t["time"])
        & _positive(t["px"])
        & _positive(t["sz"])
        & (number(t["px"]) * number(t["sz"]) < float("inf"))
    )


def _good_touch(level: Column) -> Column:
    return level.isNull() | (_positive(level["px"]) & _positive(level["sz"]) & level["n"].isNotNull())


def _not_crossed(bid: Column, ask: Column) -> Column:
    return F.coalesce(number(bid["px"]) <= number(ask["px"]), F.lit(True))


def _good_quote(q: Column) -> Column:
    bid, ask = F.get(q["bbo"], F.lit(0)), F.get(q["bbo"], F.lit(1))
    return (
        q["coin"].isNotNull()
        & (F.size(q["bbo"]) == 2)
        & _since_epoch(q["time"])
        & _good_touch(bid)
        & _good_touch(ask)
        & _not_crossed(bid, ask)
    )


def _good_side(levels: Column, falling: bool) -> Column:
    sane = F.forall(levels, lambda x: _positive(x["px"]) & _not_negative(x["sz"]) & x["n"].isNotNull())
    prices = F.transform(levels, lambda x: number(x["px"]))
    ordered = F.sort_array(prices, asc=not falling)
    return (F.size(levels) <= MAX_BOOK_LEVELS) & sane & (ordered == prices)


def _good_book(b: Column) -> Column:
    bids, asks = F.get(b["levels"], F.lit(0)), F.get(b["levels"], F.lit(1))
    touch = _not_crossed(F.get(bids, F.lit(0)), F.get(asks, F.lit(0)))
    return (
        b["coin"].isNotNull()
        & (F.size(b["levels"]) == 2)
        & _since_epoch(b["time"])
        & _good_side(bids, True)
        & _good_side(asks, False)
        & touch
    )


def _good_context(c: Column) -> Column:
    x = c["ctx"]
    names = ("dayNtlVlm", "prevDayPx", "markPx", "midPx", "circulatingSupply")
    return c["coin"].isNotNull() & x.isNotNull() & reduce(lambda a, b: a & b, [_absent(x[n]) | _not_negative(x[n]) for n in names])


def _good_candle(c: Column) -> Column:
    o, h, low, cl = (number(c[n]) for n in ("o", "h", "l", "c"))
    start, end = c["t"].try_cast("bigint"), c["T"].try_cast("bigint")
    ok = (
        c["s"].isNotNull()
        & c["i"].isNotNull()
        & (start >= 0)
        & (start <= end)
        & (F.least(o, h, low, cl) > 0)
        & o.isNotNull()
        & h.isNotNull()
        & low.isNotNull()
        & cl.isNotNull()
        & (h >= F.greatest(o, low, cl))
        & (low <= F.least(o, cl))
        & (number(c["v"]) >= 0)
        & (c["n"].try_cast("bigint") >= 0)
    )
    return F.coalesce(ok, F.lit(False))


def decode(frames: DataFrame) -> DataFrame:
    """Add ``channel``, the decoded payloads and ``problem``. Needs ``value``; keeps other columns."""
    envelope = F.from_json("value", "struct<channel:string>")
    data = F.get_json_object("value", "$.data")
    rows = frames.withColumn("channel", envelope["channel"]).withColumn("_data", data)
    # A single candle object becomes a list of one.
    listed = F.when(F.ltrim("_data").startswith("["), F.col("_data")).otherwise(F.concat(F.lit("["), "_data", F.lit("]")))
    is_context = F.col("channel").isin(*CONTEXT_CHANNELS)
    decoded = {
        name: F.when(F.col("channel") == name, F.from_json("_data", schema))
        for name, schema in PAYLOAD.items()
        if name not in ("context", "candle")
    }
    decoded["context"] = F.when(is_context, F.from_json("_data", PAYLOAD["context"]))
    decoded["candle"] = F.when(F.col("channel") == "candle", F.from_json(listed, PAYLOAD["candle"]))
    rows = rows.withColumns({f"_{name}": c for name, c in decoded.items()})
    good = {
        "trades": F.forall("_trades", _good_trade),
        "bbo": _good_quote(F.col("_bbo")),
        "l2Book": _good_book(F.col("_l2Book")),
        "allMids": F.forall(F.map_values("_allMids.mids"), _positive),
        "context": _good_context(F.col("_context")),
        "candle": F.forall("_candle", _good_candle),
    }
    ok = F.lit(None).cast("boolean")
    for name, check in good.items():
        mine = is_context if name == "context" else F.col("channel") == name
        ok = F.when(mine, F.coalesce(check, F.lit(False))).otherwise(ok)
    problem = (
        F.when(F.col("channel").isNull(), "invalid envelope")
        .when(F.col("channel").isin(*PRIVATE_CHANNELS), "private or trading channel")
        .when(F.col("channel").isin(*CONTROL_CHANNELS), F.lit(None))
        .when(~F.col("channel").isin(*DATA_CHANNELS), "unsupported public channel")
        .when(~ok, F.concat(F.lit("invalid payload of "), F.col("channel")))
    )
    return rows.withColumn("problem", problem)


def _accepted(decoded: DataFrame, channel: str) -> DataFrame:
    wanted = F.col("channel").isin(*CONTEXT_CHANNELS) if channel == "context" else F.col("channel") == channel
    return decoded.filter(wanted & F.col("problem").isNull())


META = ["recv_ts_ns", "seq"]


def normalize_trades(decoded: DataFrame) -> DataFrame:
    rows = _accepted(decoded, "trades").select(*META, F.posexplode("_trades").alias("_i", "t"))
    price, size = number(F.col("t.px")), number(F.col("t.sz"))
    return rows.select(
        F.col("t.coin").alias("symbol"),
        "recv_ts_ns",
        F.col("t.time").alias("exchange_ts_ms"),
        F.when(F.col("t.side").isin(*BUY), "buy").otherwise("sell").alias("side"),
        price.alias("price"),
        size.alias("size"),
        (price * size).alias("notional"),
        F.col("t.hash").alias("hash"),
        F.col("t.tid").alias("tid"),
        F.concat_ws(":", "t.coin", "t.time", "t.tid").alias("unique_trade_id"),
        (F.col("seq") * SLOT + F.col("_i")).alias("ingest_seq"),
    )


def normalize_quotes(decoded: DataFrame) -> DataFrame:
    cols = []
    for i, side in enumerate(("bid", "ask")):
        level = F.get("_bbo.bbo", F.lit(i))
        cols += [
            number(level["px"]).alias(f"{side}_price"),
            number(level["sz"]).alias(f"{side}_size"),
            level["n"].alias(f"{side}_order_count"),
        ]
    return _accepted(decoded, "bbo").select(
        F.col("_bbo.coin").alias("symbol"),
        "recv_ts_ns",
        F.col("_bbo.time").alias("exchange_ts_ms"),
        *cols,
        (F.col("seq") * SLOT).alias("ingest_seq"),
    )


def normalize_books(decoded: DataFrame) -> DataFrame:
    def side(i: int) -> Column:
        return F.transform(
            F.get("_l2Book.levels", F.lit(i)),
            lambda x: F.struct(number(x["px"]).alias("price"), number(x["sz"]).alias("size"), x["n"].alias("order_count")),
        )

    return _accepted(decoded, "l2Book").select(
        F.col("_l2Book.coin").alias("symbol"),
        "recv_ts_ns",
        F.col("_l2Book.time").alias("exchange_ts_ms"),
        side(0).alias("bids"),
        side(1).alias("asks"),
        (F.col("seq") * SLOT).alias("ingest_seq"),
    )


def normalize_mids(decoded: DataFrame) -> DataFrame:
    rows = _accepted(decoded, "allMids").select(*META, F.explode("_allMids.mids").alias("symbol", "_mid"))
    return rows.select(
        "symbol", "recv_ts_ns", number(F.col("_mid")).alias("mid"), (F.col("seq") * SLOT).alias("ingest_seq")
    )


def normalize_contexts(decoded: DataFrame) -> DataFrame:
    def price(name: str) -> Column:
        value = number(F.col(f"_context.ctx.{name}"))
        return F.when(value > 0, value)

    return _accepted(decoded, "context").select(
        F.col("_context.coin").alias("symbol"),
        "recv_ts_ns",
        number(F.col("_context.ctx.dayNtlVlm")).alias("day_ntl_vlm"),
        price("prevDayPx").alias("prev_day_px"),
        price("markPx").alias("mark_px"),
        price("midPx").alias("mid_px"),
        number(F.col("_context.ctx.circulatingSupply")).alias("circulating_supply"),
        (F.col("seq") * SLOT).alias("ingest_seq"),
    )


def _candle_columns() -> list[Column]:
    return [
        F.col("c.s").alias("symbol"),
        F.col("c.i").alias("interval"),
        F.col("c.t").try_cast("bigint").alias("open_ts_ms"),
        F.col("c.T").try_cast("bigint").alias("close_ts_ms"),
        *[number(F.col(f"c.{k}")).alias(name) for k, name in zip("ohlcv", ("open", "high", "low", "close", "volume_base"))],
        F.col("c.n").try_cast("bigint").alias("trade_count"),
    ]


def normalize_candles(decoded: DataFrame) -> DataFrame:
    rows = _accepted(decoded, "candle").select(*META, F.posexplode("_candle").alias("_i", "c"))
    return rows.select(
        *_candle_columns(),
        "recv_ts_ns",
        F.lit("web_socket").alias("provenance"),
        F.lit("open").alias("completion"),
        (F.col("seq") * SLOT + F.col("_i")).alias("ingest_seq"),
    )


def candle_snapshot(responses: DataFrame, now_ms: int) -> DataFrame:
    """Candles of REST answers (``json`` holds an array); closed when their end lies in the past.

    A response with one bad candle yields no rows here; ``rejected_responses`` has it.
    """
    rows = responses.withColumn("_c", F.from_json("json", PAYLOAD["candle"]))
    good = rows.filter(_good_response()).select(F.posexplode("_c").alias("_i", "c"))
    closed = F.col("c.T").try_cast("bigint") < now_ms
    return good.select(
        *_candle_columns(),
        F.lit(0).cast("long").alias("recv_ts_ns"),
        F.lit("rest_bootstrap").alias("provenance"),
        F.when(closed, "closed").otherwise("open").alias("completion"),
        F.col("_i").cast("long").alias("ingest_seq"),
    )


def _good_response() -> Column:
    return F.coalesce(F.forall("_c", lambda c: F.coalesce(_good_candle(c), F.lit(False))), F.lit(False))


def rejected_responses(responses: DataFrame) -> DataFrame:
    """REST answers that are no array of candles or hold a bad one, with ``problem``."""
    rows = responses.withColumn("_c", F.from_json("json", PAYLOAD["candle"]))
    problem = F.when(F.col("_c").isNull(), "unreadable answer").otherwise("invalid candle in the answer")
    return rows.filter(~_good_response()).withColumn("problem", problem).drop("_c")


def validate_candle_response(candles: DataFrame, symbol: Column, interval: Column, start_ms: Column, end_ms: Column) -> DataFrame:
    """Add ``problem`` to candles that do not belong to what was asked for."""
    outside = (F.col("close_ts_ms") < start_ms) | (F.col("open_ts_ms") > end_ms)
    return candles.withColumn(
        "problem",
        F.when(F.col("symbol") != symbol, "wrong coin")
        .when(F.col("interval") != interval, "wrong interval")
        .when(outside, "outside the requested range"),
    )


def stamp_receive_time(events: DataFrame, recv_ts_ns: Column | int) -> DataFrame:
    value = recv_ts_ns if isinstance(recv_ts_ns, Column) else F.lit(recv_ts_ns)
    return events.withColumn("recv_ts_ns", value.cast("long"))


def rejects(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("problem").isNotNull()).select(*META, "channel", "problem", "value")


NORMALIZERS = {
    "trades": normalize_trades,
    "quotes": normalize_quotes,
    "books": normalize_books,
    "mids": normalize_mids,
    "contexts": normalize_contexts,
    "candles": normalize_candles,
    "rejects": rejects,
}


def split_events(frames: DataFrame) -> dict[str, DataFrame]:
    """Every typed table and the rejects of a frame table (batch or stream); a batch is decoded once, here."""
    decoded = decode(frames)
    if not frames.isStreaming:  # only the rejects need the text of a frame
        decoded = cut_lineage(decoded.drop("_data").withColumn("value", F.when(F.col("problem").isNotNull(), F.col("value"))))
    return {name: build(decoded) for name, build in NORMALIZERS.items()}
