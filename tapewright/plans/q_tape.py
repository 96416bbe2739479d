"""Registered queries: candle and tape analytics, composite index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import candles as tape
from tapewright.operators import composite
from tapewright.plans import oracle_base as ob
from tapewright.plans import views
from tapewright.plans.oracle_base import DAY, HOUR, r6
from tapewright.plans.registry import register, rounded

OHLC = ["open", "high", "low", "close"]
_RC = ", rc AS (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_ts DESC) <= 30)"


def recent(s, d):
    return tape.recent_candles(views.candles(s, d), "6h", 30)


register(
    "K1_recent_candles",
    lambda s, d: recent(s, d).select("symbol", "open_ts_ms", "trade_count", *rounded(*OHLC)),
    ob.base(f"{_RC} SELECT symbol, open_ts AS open_ts_ms, trade_count, {', '.join(f'{r6(c)} AS {c}' for c in OHLC)} FROM rc"),
)
_SUMMARY = ["move", "trend_pct", "range_pct", "vwap", "range_pos", "average_volume", "volume_pulse", "high", "low"]
register(
    "K2_candle_summary",
    lambda s, d: tape.candle_summary(recent(s, d)).select("symbol", "candles", "volatility", *rounded(*_SUMMARY)),
    ob.base(f"""{_RC}
    , a AS (SELECT symbol, count(*) AS candles, arg_min(open, open_ts) AS o, arg_max(close, open_ts) AS c, arg_max(volume_base, open_ts) AS lv, max(high) AS high, min(low) AS low,
        sum(volume_base) AS v, sum(close * volume_base) AS pv FROM rc GROUP BY 1)
    SELECT symbol, candles, {r6('c - o')} AS move, {r6('(c - o) / o * 100')} AS trend_pct, {r6('(high - low) / o * 100')} AS range_pct, {r6('pv / v')} AS vwap,
      {r6('(c - low) / (high - low)')} AS range_pos, {r6('v / candles')} AS average_volume, {r6('lv / (v / candles)')} AS volume_pulse, {r6('high')} AS high, {r6('low')} AS low,
      CASE WHEN (high - low) / o * 100 >= 2 THEN 'hot' WHEN (high - low) / o * 100 >= 0.5 THEN 'active' ELSE 'quiet' END AS volatility FROM a"""),
)
register(
    "K3_candle_structure",
    lambda s, d: tape.candle_structure(recent(s, d)),
    ob.base(f"""{_RC}
    , p AS (SELECT symbol, high, low, lag(high) OVER w AS h0, lag(low) OVER w AS l0 FROM rc WINDOW w AS (PARTITION BY symbol ORDER BY open_ts))
    , c AS (SELECT symbol, count(*) FILTER (high > h0) AS higher_highs, count(*) FILTER (low < l0) AS lower_lows FROM p GROUP BY 1)
    SELECT *, CASE WHEN higher_highs > lower_lows THEN 'up-structure' WHEN higher_highs < lower_lows THEN 'down-structure' ELSE 'balanced-structure' END AS structure FROM c"""),
)
register(
    "K4_volume_profile",
    lambda s, d: tape.volume_profile(recent(s, d)).select(
        "symbol", "bucket", "poc_bucket", *rounded("volume", "poc_price")
    ),
    ob.base(f"""{_RC}
    , m AS (SELECT *, min(low) OVER (PARTITION BY symbol) AS lo, max(high) OVER (PARTITION BY symbol) AS hi FROM rc)
    , k AS (SELECT symbol, CAST(least(floor((close - lo) / (hi - lo) * 6), 5) AS INTEGER) AS bucket, sum(volume_base) AS volume, any_value(lo) AS lo, any_value(hi) AS hi FROM m GROUP BY 1, 2)
    , q AS (SELECT *, arg_max(bucket, (volume, bucket)) OVER (PARTITION BY symbol) AS poc_bucket FROM k)
    SELECT symbol, bucket, poc_bucket, {r6('volume')} AS volume, {r6('lo + (hi - lo) / 6 * (poc_bucket + 0.5::DOUBLE)')} AS poc_price FROM q"""),
)


def _orderflow(s, d):
    flow = tape.orderflow_by_candle(views.candles(s, d), views.trades(s, d), 4 * HOUR)
    return flow.select(
        "symbol", "open_ts_ms", "buy_count", "sell_count", "marker",
        *rounded("buy_notional", "sell_notional", "net_notional", digits=3),
    )


register(
    "K5_orderflow_by_candle",
    _orderflow,
    ob.base("""
    , j AS (SELECT c.symbol, c.open_ts, t.side, t.notional FROM cd c LEFT JOIN tr t ON t.symbol = c.symbol AND t.ts BETWEEN c.open_ts AND c.close_ts)
    , f AS (SELECT symbol, open_ts, coalesce(sum(notional) FILTER (side = 'buy'), 0) AS b, coalesce(sum(notional) FILTER (side = 'sell'), 0) AS s,
        count(*) FILTER (side = 'buy') AS buy_count, count(*) FILTER (side = 'sell') AS sell_count FROM j GROUP BY 1, 2)
    SELECT symbol, open_ts AS open_ts_ms, buy_count, sell_count, round(b, 3) + 0 AS buy_notional, round(s, 3) + 0 AS sell_notional, round(b - s, 3) + 0 AS net_notional,
      CASE WHEN b > 0 AND s > 0 THEN 'X' WHEN b > 0 THEN 'B' WHEN s > 0 THEN 'S' ELSE '·' END AS marker FROM f"""),
)
_VELOCITY = ["prints_per_sec", "notional_per_sec", "skew", "window_secs"]
register(
    "K6_tape_velocity",
    lambda s, d: tape.tape_velocity(views.trades(s, d)).select(
        "symbol", "prints", *rounded("largest", "total_notional", digits=3), *rounded(*_VELOCITY)
    ),
    ob.base(f"""
    , a AS (SELECT symbol, count(*) AS n, greatest(greatest(max(ts) - min(ts), 1) / 1000, 1) AS w, sum(notional) AS t, max(notional) AS largest,
        sum(CASE WHEN side = 'buy' THEN notional ELSE -notional END) AS net FROM tr GROUP BY 1)
    SELECT symbol, n AS prints, round(largest, 3) + 0 AS largest, round(t, 3) + 0 AS total_notional, {r6('n / w')} AS prints_per_sec, {r6('t / w')} AS notional_per_sec, {r6('net / t')} AS skew, {r6('w')} AS window_secs FROM a"""),
)
register(
    "K7_trade_pressure",
    lambda s, d: tape.trade_pressure(views.lineitem_trades(s, d)).select(
        "symbol", "buy_count", "sell_count", *rounded("buy_notional", "sell_notional", "net_notional", digits=2),
        *rounded("buy_share", "sell_share", "skew"),
    ),
    f"""WITH a AS (SELECT 'P' || l_suppkey AS symbol, coalesce(sum(l_extendedprice) FILTER (l_returnflag <> 'R'), 0) AS b, coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0) AS s,
      count(*) FILTER (l_returnflag <> 'R') AS buy_count, count(*) FILTER (l_returnflag = 'R') AS sell_count FROM lineitem GROUP BY 1)
    SELECT symbol, buy_count, sell_count, round(b, 2) + 0 AS buy_notional, round(s, 2) + 0 AS sell_notional, round(b - s, 2) + 0 AS net_notional,
      {r6('coalesce(b / nullif(b + s, 0), 0)')} AS buy_share, {r6('coalesce(s / nullif(b + s, 0), 0)')} AS sell_share, {r6('coalesce((b - s) / nullif(b + s, 0), 0)')} AS skew FROM a""",
)
register(
    "K8_print_ladder",
    lambda s, d: tape.print_ladder(views.trades(s, d)).select(
        "symbol", "levels", *rounded("level"), *rounded("buy_notional", "sell_notional", digits=3), *rounded("ratio")
    ),
    ob.base(f"""
    , l AS (SELECT symbol, round(price, 7) AS level, coalesce(sum(notional) FILTER (side = 'buy'), 0) AS b, coalesce(sum(notional) FILTER (side = 'sell'), 0) AS s FROM tr GROUP BY 1, 2)
    , m AS (SELECT *, max(b + s) OVER (PARTITION BY symbol) AS mx, count(*) OVER (PARTITION BY symbol) AS levels FROM l)
    SELECT symbol, levels, {r6('level')} AS level, round(b, 3) + 0 AS buy_notional, round(s, 3) + 0 AS sell_notional, {r6('(b + s) / mx')} AS ratio FROM m
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY level DESC) <= 4"""),
)
register(
    "K9_recent_trades",
    lambda s, d: tape.recent_trades(views.trades_dup(s, d), 9).select("symbol", "exchange_ts_ms", "tid", "side", *rounded("price")),
    ob.base(f"SELECT symbol, ts AS exchange_ts_ms, tid, side, {r6('price')} AS price FROM trd QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, tid DESC, seq) <= 9"),
)
register(
    "K10_spark_ratio",
    lambda s, d: tape.spark_ratio(views.candles(s, d), 20).select("symbol", "open_ts_ms", "level", *rounded("ratio")),
    ob.base(f"""
    , n AS (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_ts DESC) <= 20)
    , r AS (SELECT symbol, open_ts, (close - min(close) OVER (PARTITION BY symbol)) / (max(close) OVER (PARTITION BY symbol) - min(close) OVER (PARTITION BY symbol)) AS ratio FROM n)
    SELECT symbol, open_ts AS open_ts_ms, CAST(round(ratio * 7) AS INTEGER) AS level, {r6('ratio')} AS ratio FROM r"""),
)
register(
    "K11_relative_volume",
    lambda s, d: tape.relative_volume(recent(s, d)).select("symbol", "open_ts_ms", *rounded("relative_volume")),
    ob.base(f"{_RC} SELECT symbol, open_ts AS open_ts_ms, {r6('volume_base / max(volume_base) OVER (PARTITION BY symbol)')} AS relative_volume FROM rc"),
)
register(
    "K12_live_tail_trades",
    lambda s, d: tape.live_tail(views.trades(s, d), ["exchange_ts_ms", "ingest_seq"], 64).select("symbol", "tid", "side"),
    ob.base("SELECT symbol, tid, side FROM tr QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) <= 64"),
)
register(
    "K12_live_tail_candles",
    lambda s, d: tape.live_tail(views.candles(s, d), ["open_ts_ms"], 64).select("symbol", "open_ts_ms", "trade_count"),
    ob.base("SELECT symbol, open_ts AS open_ts_ms, trade_count FROM cd QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_ts DESC) <= 64"),
)

# --- composite index ------------------------------------------------------------------------------

WEEK = 7 * DAY
_LI = f"""
li AS (SELECT 'P' || l_suppkey AS symbol, epoch_us(l_shipdate) // 1000 AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size, l_extendedprice AS notional,
       l_orderkey * 10 + l_linenumber AS tid, l_partkey AS seq FROM lineitem),
wc AS (SELECT symbol, ts // {WEEK} * {WEEK} AS open_ts, arg_min(price, (ts, tid, seq, notional)) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, (ts, tid, seq, notional)) AS close, sum(size) AS volume_base FROM li GROUP BY 1, 2)"""


def _weights_sql(liquidity: str) -> str:
    """Smallest number of capped symbols for which the next one fits below the cap."""
    return f"""
lq AS ({liquidity}),
w0 AS (SELECT symbol, sqrt(liquidity) AS raw, row_number() OVER (ORDER BY sqrt(liquidity) DESC) AS rn, count(*) OVER () AS n, sum(sqrt(liquidity)) OVER () AS total FROM lq WHERE liquidity > 0),
w1 AS (SELECT *, greatest(CAST(0.1 AS DOUBLE), 1 / n) AS cap, total - coalesce(sum(raw) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM w0),
w2 AS (SELECT *, coalesce(min(rn) FILTER ((1 - (rn - 1) * cap) * raw / rest <= cap) OVER () - 1, n) AS k FROM w1),
w3 AS (SELECT *, sum(raw) FILTER (rn > k) OVER () AS free FROM w2),
wt AS (SELECT symbol, CASE WHEN rn <= k THEN cap ELSE (1 - k * cap) * raw / free END AS weight FROM w3)"""


_LIQUIDITY = "SELECT symbol, sum(notional) AS liquidity FROM li GROUP BY 1"
register(
    "I1_capped_sqrt_weights",
    lambda s, d: composite.capped_sqrt_weights(views.skewed_liquidity(s, d)).select("symbol", *rounded("weight", digits=9)),
    f"WITH {_LI}, {_weights_sql('SELECT symbol, pow(sum(notional) / (SELECT sum(notional) / count(DISTINCT symbol) FROM li), 30) AS liquidity FROM li GROUP BY 1')} SELECT symbol, round(weight, 9) + 0 AS weight FROM wt",
)
register(
    "I2_valid_minute_candles",
    lambda s, d: composite.valid_minute_candles(views.lineitem_candles(s, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("candles")),
    f"WITH {_LI} SELECT symbol, count(*) AS candles FROM wc WHERE open > 0 AND low > 0 AND high >= greatest(open, close) AND low <= least(open, close) GROUP BY 1",
)


def _doubled(s, d):
    """Every weekly candle twice: the second copy was received later and closes higher."""
    rows = views.lineitem_candles(s, d)
    late = rows.withColumns({"recv_ts_ns": F.col("recv_ts_ns") + 1, "close": F.col("high"), "ingest_seq": F.col("ingest_seq") + 1})
    return rows.unionByName(late)


register(
    "I3_dedup_minute_candles",
    lambda s, d: composite.dedup_minute_candles(_doubled(s, d)).select("symbol", "open_ts_ms", *rounded("open", "close", digits=9)),
    f"WITH {_LI} SELECT symbol, open_ts AS open_ts_ms, round(open, 9) + 0 AS open, round(high, 9) + 0 AS close FROM wc",
)
_INDEX = f"""WITH {_LI}, {_weights_sql(_LIQUIDITY)},
b0 AS (SELECT wc.*, weight, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY open_ts), open) AS base FROM wc JOIN wt USING (symbol)),
b1 AS (SELECT open_ts, sum(weight) AS cov, sum(weight * (open / base - 1)) / sum(weight) AS ro, sum(weight * (high / base - 1)) / sum(weight) AS rh,
       sum(weight * (low / base - 1)) / sum(weight) AS rl, sum(weight * (close / base - 1)) / sum(weight) AS rc, sum(volume_base * close) AS qv, count(*) AS n,
       count(*) FILTER (close > open) AS advances, count(*) FILTER (close < open) AS declines, count(*) FILTER (close = open) AS unchanged FROM b0 GROUP BY 1),
b2 AS (SELECT *, 100 * coalesce(product(1 + rc) OVER (ORDER BY open_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS prev FROM b1),
ix AS (SELECT *, prev * (1 + ro) AS open, prev * (1 + rc) AS close, least(cov, 1) AS coverage,
       CASE WHEN least(cov, 1) >= 0.8 THEN 'healthy' WHEN least(cov, 1) >= 0.5 THEN 'partial' ELSE 'degraded' END AS coverage_state FROM b2)"""


def index(s, d, exact=None):
    return composite.composite_index(views.lineitem_candles(s, d), views.liquidity(s, d), 120, exact)


def relative(*names):
    """Index levels can span many magnitudes: compare eight significant digits."""
    return [F.format_string("%.7e", F.col(n)).alias(n) for n in names]


register(
    "I4_composite_index",
    lambda s, d: index(s, d).select("open_ts_ms", "close_ts_ms", "contributing_symbols", *relative("open", "high", "low", "close")),
    f"""{_INDEX} SELECT open_ts AS open_ts_ms, open_ts + {WEEK - 1} AS close_ts_ms, n AS contributing_symbols, printf('%.7e', open) AS open, printf('%.7e', close) AS close,
      printf('%.7e', greatest(prev * (1 + rh), open, close)) AS high, printf('%.7e', least(prev * (1 + rl), open, close)) AS low FROM ix""",
)
register(
    "I5_breadth",
    lambda s, d: index(s, d).select(
        "open_ts_ms", "advances", "declines", "unchanged", "stale_symbols", "coverage_state", *rounded("liquidity_weight_coverage")
    ),
    f"{_INDEX} SELECT open_ts AS open_ts_ms, advances, declines, unchanged, greatest(120 - n, 0) AS stale_symbols, coverage_state, {r6('coverage')} AS liquidity_weight_coverage FROM ix",
)


def _exact(s, d):
    """Traded notional per week, known only for weeks with enough prints."""
    rows = views.lineitem_trades(s, d).withColumn("open_ts_ms", F.expr(f"exchange_ts_ms div {WEEK}") * WEEK)
    sums = rows.groupBy("open_ts_ms").agg(F.sum("notional").alias("quote_volume"), F.count(F.lit(1)).alias("n"))
    average = sums.agg(F.avg("n")).first()[0]
    return sums.filter(F.col("n") >= average)


register(
    "I6_exact_quote_volume",
    lambda s, d: index(s, d, _exact(s, d)).select("open_ts_ms", "volume_source", *rounded("quote_volume", digits=2)),
    f"""{_INDEX}, e AS (SELECT ts // {WEEK} * {WEEK} AS open_ts, sum(notional) AS v, count(*) AS n FROM li GROUP BY 1),
    e2 AS (SELECT * FROM e WHERE n >= (SELECT avg(n) FROM e))
    SELECT ix.open_ts AS open_ts_ms, CASE WHEN v IS NULL THEN 'close_approximation' ELSE 'exact_trades' END AS volume_source, round(coalesce(v, qv), 2) + 0 AS quote_volume
    FROM ix LEFT JOIN e2 USING (open_ts)""",
)
register(
    "I7_composite_validate",
    lambda s, d: composite.composite_validate(index(s, d)).agg(
        F.count(F.lit(1)).alias("minutes"), F.min("open_ts_ms").alias("first_ms")
    ),
    f"{_INDEX} SELECT count(*) AS minutes, min(open_ts) AS first_ms FROM ix",
)
