"""Registered queries: universe, state reconstruction, event counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import state
from tapewright.plans import oracle_base as ob
from tapewright.plans import views
from tapewright.plans.oracle_base import DAY, HOUR, r6
from tapewright.plans.registry import joined, register, rounded

register(
    "S13_filter_universe",
    lambda s, d: state.filter_universe(views.trades(s, d), views.active_symbols(s, d)).select(
        "symbol", "exchange_ts_ms", "tid", "side", *rounded("notional")
    ),
    ob.base(
        f"SELECT symbol, ts AS exchange_ts_ms, tid, side, {r6('notional')} AS notional FROM tr "
        "WHERE symbol IN (SELECT symbol FROM ev GROUP BY 1 HAVING avg(px) > (SELECT avg(px) FROM ev))"
    ),
)
register(
    "S14_observed_symbols",
    lambda s, d: state.observed_symbols(views.lineitem_trades(s, d), top=25),
    "SELECT DISTINCT 'P' || l_suppkey AS symbol FROM lineitem ORDER BY 1 LIMIT 25",
)
register(
    "S19_event_counts",
    lambda s, d: views.read(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events")),
    "SELECT event_type, count(*) AS events FROM events GROUP BY 1",
)

_DEDUP = "symbol, ts AS exchange_ts_ms, tid, seq AS ingest_seq, side, copies"
register(
    "D1_dedup_trades",
    lambda s, d: state.dedup_trades(views.trades_dup(s, d)).select(
        "symbol", "exchange_ts_ms", "tid", "ingest_seq", "side", "copies", *rounded("price")
    ),
    ob.base(
        f", {ob.ONCE} SELECT {_DEDUP}, {r6('price')} AS price FROM kept"
    ),
)
register(
    "D1_dedup_order_lines",
    lambda s, d: state.dedup_trades(views.lineitem_dups(s, d)).select(
        "symbol", "unique_trade_id", "exchange_ts_ms", "copies", *rounded("notional", digits=2)
    ),
    """
    SELECT symbol, unique_trade_id, arg_min(ts, o) AS exchange_ts_ms, count(*) - 1 AS copies,
           round(arg_min(notional, o), 2) + 0 AS notional
    FROM (SELECT 'O' || l_orderkey % 50 AS symbol, l_orderkey || ':' || l_linenumber AS unique_trade_id,
                 epoch_us(l_shipdate) // 1000 AS ts, l_extendedprice AS notional,
                 (epoch_us(l_shipdate), l_suppkey, l_partkey, l_extendedprice) AS o FROM lineitem)
    GROUP BY 1, 2""",
)
register(
    "D1_duplicate_trade_count",
    lambda s, d: state.duplicate_counts(
        state.dedup_trades(state.arrived_in_time(views.trades_dup(s, d), 10 * DAY))
    ),
    ob.base(f", {ob.ACCEPTED} SELECT symbol, CAST(sum(copies) AS BIGINT) AS duplicate_trade_count FROM acc GROUP BY 1"),
)
register(
    "D2_retain_recent",
    lambda s, d: state.retain_recent(views.trades_dup(s, d), 10 * DAY).select(
        "symbol", "exchange_ts_ms", "tid", "copies", *rounded("price")
    ),
    ob.base(
        f", {ob.ACCEPTED} SELECT symbol, ts AS exchange_ts_ms, tid, copies, {r6('price')} AS price FROM kept"
    ),
)
register(
    "D3_last_trade",
    lambda s, d: state.last_trade(views.trades_dup(s, d)).select(
        "symbol", "last_trade_ts_ms", *rounded("last_trade_price")
    ),
    ob.base(
        f"SELECT symbol, max(ts) AS last_trade_ts_ms, {r6('arg_max(price, (ts, seq))')} AS last_trade_price FROM trd GROUP BY 1"
    ),
)
register(
    "D4_latest_quote",
    lambda s, d: state.latest_quote(views.quotes_onesided(s, d)).select(
        "symbol", "quote_ts_ms", *rounded("bid_px", "bid_sz", "ask_px", "ask_sz")
    ),
    ob.base(
        f"SELECT symbol, ts AS quote_ts_ms, {r6('bid')} AS bid_px, {r6('bsz')} AS bid_sz, {r6('ask')} AS ask_px, {r6('asz')} AS ask_sz "
        "FROM qt QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) = 1"
    ),
)
register(
    "D4_quote_history",
    lambda s, d: state.quote_history(views.quotes_onesided(s, d)).select(
        "symbol", "exchange_ts_ms", "ingest_seq", *rounded("bid_price", "ask_price", digits=4)
    ),
    ob.base(
        "SELECT symbol, ts AS exchange_ts_ms, seq AS ingest_seq, round(bid, 4) + 0 AS bid_price, round(ask, 4) + 0 AS ask_price "
        "FROM qt"
    ),
)
_BOOK_SQL = f"""
, bk AS (SELECT symbol, ts, seq, ts - CASE WHEN seq % 7 = 0 THEN {2 * DAY} ELSE 0 END AS recv, bid, bsz FROM qfull)"""
register(
    "D5_latest_book",
    lambda s, d: state.latest_book(views.books(s, d)).select(
        "symbol",
        "book_ts_ms",
        F.expr("book_recv_ts_ns div 1000000").alias("book_recv_ms"),
        (F.round(F.col("bids")[0]["price"], 6) + 0).alias("best_bid"),
    ),
    ob.base(
        f"{_BOOK_SQL} SELECT symbol, ts AS book_ts_ms, recv AS book_recv_ms, {r6('bid')} AS best_bid FROM bk "
        "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY recv DESC, seq DESC) = 1"
    ),
)
register(
    "D6_latest_context",
    lambda s, d: state.latest_context(views.contexts(s, d)).select(
        "symbol", *rounded("day_ntl_vlm", "prev_day_px", "mark_px", "context_mid_px")
    ),
    ob.base(
        f"SELECT symbol, {r6('day_ntl_vlm')} AS day_ntl_vlm, {r6('prev_day_px')} AS prev_day_px, {r6('mark_px')} AS mark_px, "
        f"{r6('mid_px')} AS context_mid_px FROM cx QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) = 1"
    ),
)
register(
    "D7_latest_mids",
    lambda s, d: state.latest_mids(views.mids(s, d)).select("symbol", *rounded("all_mids_px")),
    ob.base(f"SELECT symbol, {r6('arg_max(mid, (ts, seq))')} AS all_mids_px FROM md GROUP BY 1"),
)
register(
    "D7_merged_mid",
    lambda s, d: state.merged_mid(views.quotes_onesided(s, d), views.mids(s, d), views.contexts(s, d)).select(
        "symbol", *rounded("mid_px")
    ),
    # All events count here, also a mid received just after the newest event time.
    ob.single(
        f"SELECT symbol, {r6('coalesce(x.mid, fm.mid)')} AS mid_px FROM sy LEFT JOIN (SELECT symbol, arg_max(mid, seq) AS mid FROM mu GROUP BY 1) x USING (symbol) "
        "LEFT JOIN fm USING (symbol) WHERE coalesce(x.mid, fm.mid) IS NOT NULL"
    ),
)
_CU = f"""
, cu AS (
  SELECT symbol, ((ts // {3 * HOUR}) * {3 * HOUR}) // {6 * HOUR} * {6 * HOUR} AS open_ts, max(ts) AS recv, max(seq) AS seq,
         arg_max(price, tid) AS close, sum(size) AS volume_base, count(*) AS trade_count
  FROM tr GROUP BY symbol, ts // {3 * HOUR}, 2)
, cw AS (
  SELECT c.*, count(*) OVER (PARTITION BY symbol, open_ts) AS k FROM cu c
  QUALIFY row_number() OVER (PARTITION BY symbol, open_ts ORDER BY recv DESC, seq DESC) = 1)"""
register(
    "D8_upsert_candles",
    lambda s, d: state.upsert_candles(views.candle_updates(s, d)).select(
        "symbol", "interval", "open_ts_ms", "trade_count", "completion", *rounded("close", "volume_base")
    ),
    ob.base(f"""{_CU}
    SELECT symbol, '6h' AS interval, open_ts AS open_ts_ms, trade_count, {r6('close')} AS close, {r6('volume_base')} AS volume_base,
      CASE WHEN EXISTS (SELECT 1 FROM cu x WHERE x.symbol = cw.symbol AND x.open_ts > cw.open_ts AND x.seq > cw.seq) THEN 'closed' ELSE 'open' END AS completion
    FROM cw"""),
)
register(
    "D9_candle_cache_upsert",
    lambda s, d: state.candle_cache_upsert(views.candles(s, d), views.candle_updates(s, d))[0].select(
        "symbol", "open_ts_ms", "trade_count", *rounded("close", "volume_base")
    ),
    ob.base(f"""{_CU}
    SELECT symbol, open_ts AS open_ts_ms, trade_count, {r6('close')} AS close, {r6('volume_base')} AS volume_base FROM (
      SELECT symbol, open_ts, recv_ts AS recv, seq, close, volume_base, trade_count, 0 AS o FROM cd
      UNION ALL SELECT symbol, open_ts, recv, seq, close, volume_base, trade_count, 1 FROM cu)
    QUALIFY row_number() OVER (PARTITION BY symbol, open_ts ORDER BY recv DESC, o DESC, seq DESC) = 1"""),
)
register(
    "D9_candle_cache_changed_rows",
    lambda s, d: state.candle_cache_upsert(views.candles(s, d), views.candle_updates(s, d))[1],
    ob.base(f"""{_CU}
    SELECT count(*) FILTER (o = 1 AND recv = newest) AS changed_rows FROM (
      SELECT *, max(recv) OVER (PARTITION BY symbol, open_ts ORDER BY o, seq ROWS UNBOUNDED PRECEDING) AS newest FROM (
      SELECT symbol, open_ts, recv_ts AS recv, seq, 0 AS o FROM cd UNION ALL SELECT symbol, open_ts, recv, seq, 1 FROM cu))"""),
)
register(
    "D10_candle_cache_recent",
    lambda s, d: state.candle_cache_recent(views.candles(s, d), "6h", 12).select(
        "symbol", "open_ts_ms", "trade_count", *rounded("open", "high", "low", "close")
    ),
    ob.base(
        f"SELECT symbol, open_ts AS open_ts_ms, trade_count, {r6('open')} AS open, {r6('high')} AS high, {r6('low')} AS low, {r6('close')} AS close "
        "FROM cd QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_ts DESC) <= 12"
    ),
)
_LAST_UPDATE = f"""{_BOOK_SQL}
, lu AS (
  SELECT symbol, max(ms) AS last_update_ms FROM (
    SELECT symbol, ts AS ms FROM trd UNION ALL SELECT symbol, ts FROM qt UNION ALL SELECT symbol, ts FROM cx
    UNION ALL SELECT symbol, ts FROM md UNION ALL SELECT symbol, close_ts FROM cd
    UNION ALL SELECT symbol, ts FROM (SELECT *, max(recv) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS newest FROM bk) WHERE recv = newest)
  GROUP BY 1)"""


def _last_update(s, d):
    return state.last_update(
        views.trades_dup(s, d), views.quotes_onesided(s, d), views.books(s, d), views.contexts(s, d), views.mids(s, d), views.candles(s, d)
    )


register("D11_last_update", _last_update, ob.base(f"{_LAST_UPDATE} SELECT symbol, last_update_ms FROM lu"))
register(
    "D11_replay_clock",
    lambda s, d: _last_update(s, d).agg(F.max("last_update_ms").alias("replay_clock_ms")),
    ob.base(f"{_LAST_UPDATE} SELECT max(last_update_ms) AS replay_clock_ms FROM lu"),
)
register(
    "D12_staleness",
    lambda s, d: state.with_staleness(
        state.last_update(views.trades_dup(s, d), views.quotes_onesided(s, d)), views.now_ms(s, d), 2 * HOUR
    ),
    ob.base(f""", lu AS (SELECT symbol, max(ms) AS last_update_ms FROM (SELECT symbol, ts AS ms FROM trd UNION ALL SELECT symbol, ts FROM qt) GROUP BY 1)
    SELECT symbol, last_update_ms, greatest(n - last_update_ms, 0) AS updated_ms_ago,
      CASE WHEN n - last_update_ms <= {2 * HOUR} THEN 'fresh' ELSE 'stale' END AS staleness_state
    FROM lu, (SELECT max(ms) AS n FROM ev)"""),
)


def _two_days(s, d):
    daily, end = views.feature_table(s, d, "daily"), views.daily_times(s, d).end_ms
    at = lambda ms: daily.filter(F.col("now_ms") == ms).withColumn("confidence_score", F.col("confidence.score"))
    return at(end - DAY), at(end)


_OBS = ", ".join(f"{a}" for a in state.ALERT_OBSERVATION)
register(
    "D13_detect_changed",
    lambda s, d: state.detect_changed(*_two_days(s, d)),
    ob.daily(f"""
    , t2 AS (SELECT max(now_ms) AS b FROM times),
    p AS (SELECT symbol, ({_OBS}) AS seen FROM snap, t2 WHERE now_ms = b - {DAY}),
    c AS (SELECT symbol, ({_OBS}) AS seen FROM snap, t2 WHERE now_ms = b)
    SELECT symbol, 'changed' AS change FROM p JOIN c USING (symbol) WHERE p.seen IS DISTINCT FROM c.seen"""),
)
