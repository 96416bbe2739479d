"""Point-in-time state per symbol: dedup, retention, latest values, candle upserts, change detection.

Every "latest" is an aggregate (``max_by``/``max``), so it combines map-side and a hot symbol costs
one row per map task. Order-dependent rules (what was acceptable when it arrived) use the chunked
``ordered_scan`` along ``ingest_seq``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.errors import ContractError
from tapewright.operators.ordered import lookup_join, newest_per_key, ordered_scan

HOUR_MS = 3_600_000
STALE_AFTER_MS = 10_000


# --- trades -----------------------------------------------------------------------------------

def arrived_in_time(trades: DataFrame, retention_ms: int = HOUR_MS) -> DataFrame:
    """Drop a trade that was older than (newest time seen so far - retention) when it arrived."""
    scanned = ordered_scan(
        trades, ["symbol"], "ingest_seq", "ingest_seq", running_max={"_newest": "exchange_ts_ms"}
    )
    return scanned.filter(F.col("exchange_ts_ms") >= F.col("_newest") - retention_ms).drop("_newest")


def dedup_trades(trades: DataFrame) -> DataFrame:
    """First arrival per (symbol, unique_trade_id), with ``copies`` = later arrivals of the same id.

    An aggregate rather than a window: a group of copies collapses before the shuffle.
    """
    payload = [c for c in trades.columns if c not in ("symbol", "unique_trade_id")]
    return (
        trades.groupBy("symbol", "unique_trade_id")
        .agg(
            F.min_by(F.struct(*payload), F.col("ingest_seq")).alias("_first"),
            (F.count(F.lit(1)) - 1).alias("copies"),
        )
        .select("symbol", "unique_trade_id", "_first.*", "copies")
    )


def duplicate_counts(deduped: DataFrame) -> DataFrame:
    return deduped.groupBy("symbol").agg(F.sum("copies").alias("duplicate_trade_count"))


def _capped(df: DataFrame, keys: list[str], order: list[Column], cap: int | None) -> DataFrame:
    """The newest ``cap`` rows per key; all of them without a cap."""
    return df if cap is None else newest_per_key(df, keys, order, cap)


def keep_newest(deduped: DataFrame, retention_ms: int = HOUR_MS, cap: int | None = None) -> DataFrame:
    """Trades within ``retention_ms`` of the symbol's newest trade; at most ``cap`` only where the caller asks for it."""
    newest = deduped.groupBy("symbol").agg(F.max("exchange_ts_ms").alias("_last_ts"))
    recent = lookup_join(deduped, newest, ["symbol"], "inner").filter(
        F.col("exchange_ts_ms") >= F.col("_last_ts") - retention_ms
    )
    order = [F.col("exchange_ts_ms").desc(), F.col("ingest_seq").desc()]
    return _capped(recent.drop("_last_ts"), ["symbol"], order, cap)


def retain_recent(trades: DataFrame, retention_ms: int = HOUR_MS, cap: int | None = None) -> DataFrame:
    """The retained tape of a state: acceptable on arrival, deduplicated and recent."""
    return keep_newest(dedup_trades(arrived_in_time(trades, retention_ms)), retention_ms, cap)


def last_trade(trades: DataFrame) -> DataFrame:
    order = F.struct("exchange_ts_ms", "ingest_seq")
    return trades.groupBy("symbol").agg(
        F.max_by("price", order).alias("last_trade_price"),
        F.max("exchange_ts_ms").alias("last_trade_ts_ms"),
    )


# --- quotes, books, contexts, mids ------------------------------------------------------------

def _latest(df: DataFrame, order: list[str], fields: dict[str, str], keys: list[str]) -> DataFrame:
    row = F.struct(*[F.col(source).alias(name) for name, source in fields.items()])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select(*keys, "_row.*")


QUOTE_FIELDS = {
    "quote_ts_ms": "exchange_ts_ms",
    "bid_px": "bid_price",
    "bid_sz": "bid_size",
    "ask_px": "ask_price",
    "ask_sz": "ask_size",
}


def latest_quote(quotes: DataFrame) -> DataFrame:
    return _latest(quotes, ["exchange_ts_ms", "ingest_seq"], QUOTE_FIELDS, ["symbol"])


def quote_history(quotes: DataFrame, cap: int | None = None) -> DataFrame:
    order = [F.col("exchange_ts_ms").desc(), F.col("ingest_seq").desc()]
    return _capped(quotes, ["symbol"], order, cap)


def current_on_arrival(df: DataFrame, time_col: str, all_small: bool = False) -> DataFrame:
    """Rows that were not older than anything seen before them (ties count as current)."""
    scanned = ordered_scan(df, ["symbol"], "ingest_seq", "ingest_seq", running_max={"_newest": time_col}, all_small=all_small)
    return scanned.filter(F.col(time_col) == F.col("_newest")).drop("_newest")


def latest_book(books: DataFrame) -> DataFrame:
    fields = {"book_ts_ms": "exchange_ts_ms", "book_recv_ts_ns": "recv_ts_ns", "bids": "bids", "asks": "asks"}
    return _latest(books, ["recv_ts_ns", "ingest_seq"], fields, ["symbol"])


CONTEXT_FIELDS = {
    "context_recv_ts_ns": "recv_ts_ns",
    "day_ntl_vlm": "day_ntl_vlm",
    "prev_day_px": "prev_day_px",
    "mark_px": "mark_px",
    "context_mid_px": "mid_px",
    "circulating_supply": "circulating_supply",
}


def latest_context(contexts: DataFrame) -> DataFrame:
    """Newest context replaces the older one as a whole, missing fields included."""
    return _latest(contexts, ["recv_ts_ns", "ingest_seq"], CONTEXT_FIELDS, ["symbol"])


def latest_mids(mids: DataFrame) -> DataFrame:
    fields = {"mids_recv_ts_ns": "recv_ts_ns", "all_mids_px": "mid"}
    return _latest(mids, ["recv_ts_ns", "ingest_seq"], fields, ["symbol"])


def mid_updates(quotes: DataFrame | None, mids: DataFrame | None, all_small: bool = False) -> DataFrame:
    """Every accepted mid update in one stream: two-sided current quotes and current all-mids rows."""
    parts = []
    if quotes is not None:
        parts.append(
            current_on_arrival(quotes, "exchange_ts_ms", all_small)
            .filter(F.col("bid_price").isNotNull() & F.col("ask_price").isNotNull())
            .select(
                "symbol",
                "ingest_seq",
                F.col("exchange_ts_ms").alias("visible_ms"),
                ((F.col("bid_price") + F.col("ask_price")) / 2).alias("mid"),
            )
        )
    if mids is not None:
        parts.append(
            current_on_arrival(mids, "recv_ts_ns", all_small).select(
                "symbol", "ingest_seq", F.expr("recv_ts_ns div 1000000").alias("visible_ms"), "mid"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def first_context_mid(contexts: DataFrame, all_small: bool = False) -> DataFrame:
    """The first accepted non-null context mid: the fallback while no quote or all-mids set one."""
    return (
        current_on_arrival(contexts, "recv_ts_ns", all_small)
        .filter(F.col("mid_px").isNotNull())
        .groupBy("symbol")
        .agg(
            F.min_by("mid_px", "ingest_seq").alias("fallback_mid"),
            F.min_by(F.expr("recv_ts_ns div 1000000"), "ingest_seq").alias("fallback_ms"),
        )
    )


def merged_mid(quotes: DataFrame | None, mids: DataFrame | None, contexts: DataFrame | None) -> DataFrame:
    """Mid after all events: the last accepted quote or all-mids update by arrival, else the fallback."""
    latest = mid_updates(quotes, mids).groupBy("symbol").agg(F.max_by("mid", "ingest_seq").alias("mid_px"))
    if contexts is None:
        return latest
    fallback = first_context_mid(contexts).select("symbol", "fallback_mid")
    return latest.join(fallback, "symbol", "full").select(
        "symbol", F.coalesce("mid_px", "fallback_mid").alias("mid_px")
    )


# --- candles ----------------------------------------------------------------------------------

CANDLE_KEY = ["symbol", "interval", "open_ts_ms"]


def upsert_candles(candles: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per (symbol, interval, open): newest receive time wins, later arrival on ties.

    A candle is closed when it says so itself or when a candle with a later open arrived after the
    winning update. Updates collapse to one row per candle first, so the window below sees only the
    distinct candles of one symbol and interval.
    """
    payload = [c for c in candles.columns if c not in CANDLE_KEY]
    merged = (
        candles.groupBy(*CANDLE_KEY)
        .agg(
            F.max_by(F.struct(*payload), F.struct("recv_ts_ns", "ingest_seq")).alias("_win"),
            F.min("ingest_seq").alias("_first_seq"),
            F.max("ingest_seq").alias("_last_seq"),
        )
        .select(*CANDLE_KEY, "_win.*", "_first_seq", "_last_seq")
    )
    newer = (
        Window.partitionBy("symbol", "interval")
        .orderBy(F.col("open_ts_ms").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    closed_later = F.max("_last_seq").over(newer) > F.col("ingest_seq")
    marked = merged.withColumn("_closed_later", closed_later).withColumn(
        "completion",
        F.when((F.col("completion") == "closed") | F.col("_closed_later"), "closed").otherwise("open"),
    )
    order = [F.col("open_ts_ms").desc(), F.col("_first_seq").desc()]
    return _capped(marked, ["symbol"], order, cap).drop("_first_seq", "_last_seq", "_closed_later")


def invalid_candle() -> Column:
    """True for a candle that may not enter the cache."""
    prices = ["open", "high", "low", "close"]
    numbers = [*prices, "volume_base"]
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() | ~(F.abs(c) < float("inf")) for c in numbers])
    return (
        F.coalesce(F.trim("symbol") == "", F.lit(True))
        | F.coalesce(F.trim("interval") == "", F.lit(True))
        | (F.col("open_ts_ms") < 0)
        | (F.col("close_ts_ms") < F.col("open_ts_ms"))
        | missing
        | (F.least(*prices) <= 0)
        | (F.col("volume_base") < 0)
        | (F.col("high") < F.greatest(*prices))
        | (F.col("low") > F.least(*prices))
    )


def candle_cache_upsert(table: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge a batch into the cache; one invalid row rejects the batch.

    Returns (merged table, one-row frame ``changed_rows``): a batch row counts as a change when it is
    at least as new as what is stored at its turn.
    """
    if batch.filter(invalid_candle()).limit(1).count():
        raise ContractError("candle batch contains an invalid row; nothing was written")
    both = table.withColumn("_origin", F.lit(0).cast("long")).unionByName(
        batch.withColumn("_origin", F.lit(1).cast("long"))
    )
    payload = [c for c in table.columns if c not in CANDLE_KEY]
    merged = (
        both.groupBy(*CANDLE_KEY)
        .agg(F.max_by(F.struct(*payload), F.struct("recv_ts_ns", "_origin", "ingest_seq")).alias("_win"))
        .select(*CANDLE_KEY, "_win.*")
    )
    scanned = ordered_scan(both, CANDLE_KEY, "_origin", "ingest_seq", running_max={"_newest": "recv_ts_ns"})
    changed = scanned.agg(
        F.count_if((F.col("_origin") == 1) & (F.col("recv_ts_ns") == F.col("_newest"))).alias("changed_rows")
    )
    return merged, changed


def candle_cache_recent(table: DataFrame, interval: str, n: int, symbols: DataFrame | None = None) -> DataFrame:
    """Newest ``n`` candles per symbol of one interval, ascending by (open, symbol, receive time)."""
    if not interval.strip():
        raise ContractError("candle cache interval must not be empty")
    if n < 1:
        raise ContractError("candle cache row limit must be at least 1")
    rows = table.filter(F.col("interval") == interval)
    if symbols is not None:
        rows = filter_universe(rows, symbols)
    newest = newest_per_key(rows, ["symbol"], [F.col("open_ts_ms").desc()], n)
    return newest.orderBy("open_ts_ms", "symbol", "recv_ts_ns")


# --- clocks and freshness ---------------------------------------------------------------------

def last_update(
    trades: DataFrame | None = None,
    quotes: DataFrame | None = None,
    books: DataFrame | None = None,
    contexts: DataFrame | None = None,
    mids: DataFrame | None = None,
    candles: DataFrame | None = None,
) -> DataFrame:
    """Newest update per symbol over all streams; an ignored book does not advance the clock."""
    recv_ms = F.expr("recv_ts_ns div 1000000")
    parts = []
    for df in (trades, quotes):
        if df is not None:
            parts.append(df.select("symbol", F.col("exchange_ts_ms").alias("ms")))
    if books is not None:
        parts.append(current_on_arrival(books, "recv_ts_ns").select("symbol", F.col("exchange_ts_ms").alias("ms")))
    for df in (contexts, mids):
        if df is not None:
            parts.append(df.select("symbol", recv_ms.alias("ms")).filter("ms > 0"))
    if candles is not None:
        parts.append(candles.select("symbol", F.col("close_ts_ms").alias("ms")))
    streams = reduce(DataFrame.unionByName, parts)
    return streams.groupBy("symbol").agg(F.max("ms").alias("last_update_ms"))


def replay_clock_ms(updates: DataFrame) -> int:
    """Global clock: one number, 0 when nothing was seen."""
    value = updates.agg(F.max("last_update_ms")).first()[0]
    return int(value or 0)


def with_staleness(df: DataFrame, now_ms: Column | int, stale_after_ms: int = STALE_AFTER_MS) -> DataFrame:
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    age = F.when(F.col("last_update_ms").isNotNull(), F.greatest(now - F.col("last_update_ms"), F.lit(0)))
    return df.withColumn("updated_ms_ago", age.cast("long")).withColumn(
        "staleness_state",
        F.when(F.col("updated_ms_ago").isNull(), "incomplete")
        .when(F.col("updated_ms_ago") <= stale_after_ms, "fresh")
        .otherwise("stale"),
    )


# --- universe and change detection ------------------------------------------------------------

def filter_universe(events: DataFrame, symbols: DataFrame) -> DataFrame:
    return lookup_join(events, symbols.select("symbol").distinct(), ["symbol"], "left_semi")


def observed_symbols(events: DataFrame, top: int | None = None) -> DataFrame:
    found = events.select("symbol").filter(F.col("symbol").isNotNull()).distinct().orderBy("symbol")
    return found.limit(top) if top is not None else found


# The fields an alert rule can look at, besides the symbol.
ALERT_OBSERVATION = [
    "confidence_score",
    "spread_bps",
    "spread_shock_bps",
    "tob_depth_usd",
    "tob_imbalance",
    "signed_notional_flow_30s",
    "bbo_ofi_proxy_30s",
    "rv_1m",
    "rv_5m",
    "day_ntl_vlm",
]


def detect_changed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Symbols whose alert-relevant fields differ, appeared or vanished between two snapshot sets."""
    def observe(df: DataFrame) -> DataFrame:
        cols = [F.col(c) for c in ALERT_OBSERVATION]
        return df.select("symbol", F.struct(*cols).alias("seen"))

    before = observe(previous).withColumnRenamed("seen", "before")
    after = observe(current).withColumnRenamed("seen", "after")
    joined = before.join(after, "symbol", "full")
    return joined.filter(~F.col("before").eqNullSafe(F.col("after"))).select(
        "symbol",
        F.when(F.col("before").isNull(), "appeared")
        .when(F.col("after").isNull(), "vanished")
        .otherwise("changed")
        .alias("change"),
    )
