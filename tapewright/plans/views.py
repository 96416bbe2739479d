"""The driver's tables viewed as market data (column derivations only, no new rows).

``events`` supplies trades and quotes of about twenty symbols, ``lineitem`` a denser tape with one
symbol per supplier. Windows in these views are scaled to the data's density.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import features, state
from tapewright.operators.features import FeatureParams, Market, SnapshotOptions
from tapewright.operators.timegrid import DecisionTimes
from tapewright.session import cut_lineage

HOUR, DAY = 3_600_000, 86_400_000

SCALED = FeatureParams(
    returns_ms=(("1m", 6 * HOUR), ("5m", DAY), ("1h", 7 * DAY)),
    flow_ms=3 * DAY,
    shock_ms=7 * DAY,
    brittle_after_ms=10 * HOUR,
    vwap_ms=DAY,
    roll_ms=7 * DAY,
    retention_ms=10 * DAY,
    stale_after_ms=12 * HOUR,
)


_TABLES: dict[tuple, DataFrame] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; the reader (file listing and schema) is kept per session, never the rows."""
    key = (spark.sparkContext.applicationId, sf_dir, f"reader:{table}")
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return _TABLES[key]


def ntz(ms: int) -> Column:
    """Epoch milliseconds as a timestamp literal without time zone, so that a filter reaches the scan."""
    text = (datetime(1970, 1, 1) + timedelta(milliseconds=int(ms))).isoformat(sep=" ", timespec="milliseconds")
    return F.lit(text).cast("timestamp_ntz")


def epoch_ms(ts: str) -> Column:
    """Epoch milliseconds of a timestamp without time zone, whatever the session time zone is."""
    days = F.unix_date(F.col(ts).cast("date")).cast("long") * DAY
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    millis = F.floor(F.expr(f"extract(SECOND FROM {ts})") * 1000).cast("long")
    return days + seconds.cast("long") * 1000 + millis


def symbol_of_user() -> Column:
    return F.concat(F.lit("S"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("symbol")


def _events(spark: SparkSession, sf_dir: str, kinds: list[str], since_ms: int | None = None) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = read(spark, sf_dir, "events").filter(F.col("event_type").isin(*kinds))
    if since_ms is not None:
        rows = rows.filter(F.col("ts") >= ntz(since_ms))
    return (
        rows
        .select(
            symbol_of_user(),
            epoch_ms("ts").alias("ms"),
            F.col("event_id").alias("ingest_seq"),
            k.alias("k"),
            (F.lit(100.0) + F.col("value") / 10).alias("px"),
            "event_type",
        )
    )


def now_ms(spark: SparkSession, sf_dir: str) -> int:
    """Time of the newest event: one aggregate over one column."""
    newest = read(spark, sf_dir, "events").agg(F.max("ts").alias("ts")).select(epoch_ms("ts"))
    return int(newest.first()[0])


def first_ms(spark: SparkSession, sf_dir: str) -> int:
    return int(read(spark, sf_dir, "events").agg(F.min("ts").alias("ts")).select(epoch_ms("ts")).first()[0])


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol that ever had an event: one column of one scan."""
    return read(spark, sf_dir, "events").select(symbol_of_user()).distinct()


def active_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols whose mean price is above the mean of all events."""
    rows = read(spark, sf_dir, "events").select(symbol_of_user(), (F.lit(100.0) + F.col("value") / 10).alias("px"))
    average = rows.agg(F.avg("px")).first()[0]
    return rows.groupBy("symbol").agg(F.avg("px").alias("mean")).filter(F.col("mean") > average).select("symbol")


def trades(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    size = (F.col("k") % 9) + F.lit(1.0)
    rows = _events(spark, sf_dir, ["purchase", "click", "view"], since_ms)
    return rows.select(
        "symbol",
        (F.col("ms") * 1_000_000).alias("recv_ts_ns"),
        F.col("ms").alias("exchange_ts_ms"),
        F.when(F.col("k") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.col("px").alias("price"),
        size.alias("size"),
        (F.col("px") * size).alias("notional"),
        F.col("ingest_seq").alias("tid"),
        F.concat_ws(":", "symbol", "ms", "ingest_seq").alias("unique_trade_id"),
        "ingest_seq",
    )


def trades_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape with a late second copy of every twentieth trade."""
    tape = trades(spark, sf_dir)
    late = tape.filter(F.col("tid") % 20 == 0).withColumn("ingest_seq", F.col("tid") + 1_000_000_000)
    return tape.unionByName(late)


def trades_once(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    """The clean tape in deduplicated form."""
    return trades(spark, sf_dir, since_ms).withColumn("copies", F.lit(0).cast("long"))


def quotes(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    k = F.col("k")
    rows = _events(spark, sf_dir, ["signup", "error"], since_ms).withColumn(
        "s", F.when(k % 10 == 7, (k + 1) * 5).otherwise(k % 10 + 2)
    )
    return rows.select(
        "symbol",
        (F.col("ms") * 1_000_000).alias("recv_ts_ns"),
        F.col("ms").alias("exchange_ts_ms"),
        (F.col("px") * (1 - F.col("s") / 20000)).alias("bid_price"),
        (F.col("ingest_seq") % 60 + 1).cast("double").alias("bid_size"),
        (F.col("px") * (1 + F.col("s") / 20000)).alias("ask_price"),
        (F.col("ingest_seq") * 7 % 60 + 1).cast("double").alias("ask_size"),
        "ingest_seq",
        "k",
        "px",
    )


def quotes_onesided(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    gone = F.col("ingest_seq") % 50 == 0
    rows = quotes(spark, sf_dir, since_ms)
    return rows.withColumns({c: F.when(~gone, F.col(c)) for c in ("ask_price", "ask_size")})


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One context per quote, one millisecond after it."""
    k, px = F.col("k"), F.col("px")
    return quotes(spark, sf_dir).select(
        "symbol",
        "recv_ts_ns",
        (F.lit(10_000.0) * (k + 1)).alias("day_ntl_vlm"),
        px.alias("prev_day_px"),
        (px * (1 + ((F.col("ingest_seq") % 11) - 5) / 10000.0)).alias("mark_px"),
        F.when(k % 5 != 0, px).alias("mid_px"),
        F.lit(None).cast("double").alias("circulating_supply"),
        "ingest_seq",
    )


def mids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mid with every view, received 500 ms later."""
    return _events(spark, sf_dir, ["view"]).select(
        "symbol", ((F.col("ms") + 500) * 1_000_000).alias("recv_ts_ns"), F.col("px").alias("mid"), "ingest_seq"
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-level book per quote; every seventh arrives with an old receive time."""
    late = F.when(F.col("ingest_seq") % 7 == 0, F.lit(2 * DAY)).otherwise(F.lit(0))
    level = lambda p, s: F.array(F.struct(F.col(p).alias("price"), F.col(s).alias("size"), F.lit(1).cast("long").alias("order_count")))
    return quotes(spark, sf_dir).select(
        "symbol",
        ((F.col("exchange_ts_ms") - late) * 1_000_000).alias("recv_ts_ns"),
        "exchange_ts_ms",
        level("bid_price", "bid_size").alias("bids"),
        level("ask_price", "ask_size").alias("asks"),
        "ingest_seq",
    )


def candles_from(tape: DataFrame, interval_ms: int, interval: str) -> DataFrame:
    """OHLCV per symbol and interval bucket, open and close by (time, trade id)."""
    order = F.struct("exchange_ts_ms", "tid")
    open_ts = F.expr(f"exchange_ts_ms div {interval_ms}") * interval_ms
    return (
        tape.withColumn("open_ts_ms", open_ts)
        .groupBy("symbol", "open_ts_ms")
        .agg(
            F.max("recv_ts_ns").alias("recv_ts_ns"),
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("size").alias("volume_base"),
            F.count(F.lit(1)).alias("trade_count"),
            F.max("ingest_seq").alias("ingest_seq"),
        )
        .select(
            "symbol",
            F.lit(interval).alias("interval"),
            "open_ts_ms",
            (F.col("open_ts_ms") + interval_ms - 1).alias("close_ts_ms"),
            "recv_ts_ns",
            "open",
            "high",
            "low",
            "close",
            "volume_base",
            "trade_count",
            F.lit("web_socket").alias("provenance"),
            F.lit("open").alias("completion"),
            "ingest_seq",
        )
    )


def candles(spark: SparkSession, sf_dir: str, interval: str = "6h") -> DataFrame:
    return candles_from(trades(spark, sf_dir), 6 * HOUR, interval)


def candle_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running updates of the 6h candles: one row per trade day and candle half, so keys repeat."""
    half = candles_from(trades(spark, sf_dir), 3 * HOUR, "6h")
    parent = F.expr(f"open_ts_ms div {6 * HOUR}") * (6 * HOUR)
    return half.withColumn("open_ts_ms", parent).withColumn("close_ts_ms", parent + 6 * HOUR - 1)


def lineitem_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("symbol"),
        epoch_ms("l_shipdate").alias("exchange_ts_ms"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        F.col("l_extendedprice").alias("notional"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tid"),
        F.col("l_partkey").alias("ingest_seq"),
        (epoch_ms("l_shipdate") * 1_000_000).alias("recv_ts_ns"),
    )


def lineitem_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a tape whose ids repeat with other payloads: the large duplicate input."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(
        F.concat(F.lit("O"), (F.col("l_orderkey") % 50).cast("string")).alias("symbol"),
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("unique_trade_id"),
        epoch_ms("l_shipdate").alias("exchange_ts_ms"),
        F.col("l_extendedprice").alias("notional"),
        F.struct(
            epoch_ms("l_shipdate").alias("ts"), "l_suppkey", "l_partkey", F.col("l_extendedprice").alias("px")
        ).alias("ingest_seq"),
    )


def lineitem_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly candles per supplier; labelled as the one-minute interval the index works on."""
    rows = lineitem_trades(spark, sf_dir)
    order = F.struct("exchange_ts_ms", "tid", "ingest_seq", "notional")
    week = 7 * DAY
    return (
        rows.withColumn("open_ts_ms", F.expr(f"exchange_ts_ms div {week}") * week)
        .groupBy("symbol", "open_ts_ms")
        .agg(
            F.max("recv_ts_ns").alias("recv_ts_ns"),
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("size").alias("volume_base"),
            F.count(F.lit(1)).alias("trade_count"),
        )
        .withColumn("interval", F.lit("1m"))
        .withColumn("close_ts_ms", F.col("open_ts_ms") + week - 1)
        .withColumn("ingest_seq", F.col("open_ts_ms"))
    )


def liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_trades(spark, sf_dir).groupBy("symbol").agg(F.sum("notional").alias("liquidity"))


def metadata_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One public-metadata input row per supplier."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    supply = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.min("l_shipdate").alias("first_ship"),
            F.sum("l_quantity").alias("max_supply"),
            F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("circulating_supply"),
        )
        .withColumn("deploy_time_ms", epoch_ms("first_ship"))
    )
    rows = read(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(supply, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    feed = F.concat(F.lit("P"), F.col("s_suppkey").cast("string"))
    return rows.select(
        feed.alias("symbol"),
        F.concat_ws("/", "n_name", "r_name").alias("display_name"),
        feed.alias("feed_identifier"),
        F.col("s_suppkey").cast("int").alias("spot_index"),
        F.col("n_nationkey").cast("int").alias("base_token_index"),
        F.col("r_regionkey").cast("int").alias("quote_token_index"),
        F.lit("driver_tables").alias("metadata_source"),
        F.col("deploy_time_ms"),
        F.when(F.col("s_suppkey") % 7 != 0, F.col("s_name")).alias("deployer"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("seeded_usdc"),
        "max_supply",
        "circulating_supply",
    )


def market(spark: SparkSession, sf_dir: str, params: FeatureParams = SCALED) -> Market:
    """State tables for one decision time: deduplicated, retained trades and their duplicate counts."""
    accepted = cut_lineage(state.dedup_trades(state.arrived_in_time(trades_dup(spark, sf_dir), params.retention_ms)))
    return Market(
        trades=state.keep_newest(accepted, params.retention_ms),
        symbols=symbols(spark, sf_dir),
        quotes=quotes_onesided(spark, sf_dir),
        contexts=contexts(spark, sf_dir),
        mids=mids(spark, sf_dir),
        candles=candles(spark, sf_dir),
        duplicates=state.duplicate_counts(accepted),
    )


def market_history(spark: SparkSession, sf_dir: str) -> Market:
    """Whole tape for a grid of decision times."""
    return Market(
        trades=cut_lineage(state.dedup_trades(trades_dup(spark, sf_dir))),
        symbols=symbols(spark, sf_dir),
        quotes=cut_lineage(quotes_onesided(spark, sf_dir)),
        contexts=contexts(spark, sf_dir),
        mids=mids(spark, sf_dir),
        candles=candles(spark, sf_dir),
    )


OPTIONS = SnapshotOptions(params=SCALED)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.snapshot(market(spark, sf_dir), now_ms(spark, sf_dir), OPTIONS)


def daily_times(spark: SparkSession, sf_dir: str) -> DecisionTimes:
    """Midnights from the day after the first event to the day after the last one."""
    first, last = first_ms(spark, sf_dir), now_ms(spark, sf_dir)
    start = (first // DAY + 1) * DAY
    return DecisionTimes.covering(start, last, DAY)


def daily_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.snapshots_at(market_history(spark, sf_dir), daily_times(spark, sf_dir), OPTIONS)


def feature_table(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Snapshots written once to the shared checkpoint folder and read by every screen and board.

    Keyed by application, so a new session builds its own; ``kind`` is ``now`` or ``daily``.
    """
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _TABLES:
        build = {"now": snapshots, "daily": daily_snapshots, "listed": listed_snapshots}[kind]
        _TABLES[key] = cut_lineage(build(spark, sf_dir))
    return _TABLES[key]


def listed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current snapshots with listing metadata attached."""
    from tapewright.operators import metadata

    now = now_ms(spark, sf_dir)
    details = metadata.enrich_metadata(event_metadata_inputs(spark, sf_dir), now, now)
    return metadata.attach_metadata(feature_table(spark, sf_dir, "now"), details)


def event_metadata_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata inputs derived from each symbol's first event and value counts.

    Only symbols with an above-average price are listed, and some of those lack a field, so that
    every metadata state occurs.
    """
    i = F.substring("symbol", 2, 2).cast("int")
    rows = read(spark, sf_dir, "events").select(
        symbol_of_user(), epoch_ms("ts").alias("ms"), (F.lit(100.0) + F.col("value") / 10).alias("px")
    )
    per = rows.groupBy("symbol").agg(
        F.min("ms").alias("first_ms"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("px") - 100 < 4).alias("m")
    )
    n, m = F.col("n"), F.col("m")
    return per.join(active_symbols(spark, sf_dir), "symbol").select(
        F.col("symbol"),
        F.concat(F.col("symbol"), F.lit("/USD")).alias("display_name"),
        F.col("symbol").alias("feed_identifier"),
        i.alias("spot_index"),
        i.alias("base_token_index"),
        F.lit(0).alias("quote_token_index"),
        F.lit("driver_tables").alias("metadata_source"),
        (F.col("first_ms") + i * DAY).alias("deploy_time_ms"),
        F.when(m >= n * 0.535, F.concat(F.lit("d"), i)).alias("deployer"),
        F.when(m >= n * 0.55, (n * 10).cast("double")).alias("seeded_usdc"),
        n.cast("double").alias("max_supply"),
        (m * 0.45).cast("double").alias("circulating_supply"),
    )


def skewed_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier liquidity with differences blown up, so that the weight cap binds."""
    rows = liquidity(spark, sf_dir)
    average = rows.agg(F.avg("liquidity")).first()[0]
    return rows.select("symbol", F.pow(F.col("liquidity") / average, F.lit(30)).alias("liquidity"))
