"""Independent SQL statements of the base views and snapshots, used to check the Spark queries."""

from __future__ import annotations

HOUR, DAY = 3_600_000, 86_400_000

EVENTS = f"""
ev AS (
  SELECT 'S' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS symbol, epoch_us(ts) // 1000 AS ms, event_id AS seq, event_type,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
         CAST(100 AS DOUBLE) + value / 10 AS px
  FROM events),
tr AS (
  SELECT symbol, ms AS ts, seq AS tid, seq, k, CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, px AS price,
         CAST(k % 9 + 1 AS DOUBLE) AS size, px * CAST(k % 9 + 1 AS DOUBLE) AS notional
  FROM ev WHERE event_type IN ('purchase', 'click', 'view')),
trd AS (
  SELECT * FROM tr
  UNION ALL
  SELECT * REPLACE (tid + 1000000000 AS seq) FROM tr WHERE tid % 20 = 0),
qt0 AS (
  SELECT symbol, ms AS ts, seq, k, px,
         CAST(CASE WHEN k % 10 = 7 THEN (k + 1) * 5 ELSE k % 10 + 2 END AS DOUBLE) AS s
  FROM ev WHERE event_type IN ('signup', 'error')),
qfull AS (
  SELECT symbol, ts, seq, k, px, px * (1 - s / 20000) AS bid, CAST(seq % 60 + 1 AS DOUBLE) AS bsz,
         px * (1 + s / 20000) AS ask, CAST(seq * 7 % 60 + 1 AS DOUBLE) AS asz
  FROM qt0),
qt AS (
  SELECT * REPLACE (CASE WHEN seq % 50 <> 0 THEN ask END AS ask, CASE WHEN seq % 50 <> 0 THEN asz END AS asz) FROM qfull),
cx AS (
  SELECT symbol, ts, seq, CAST(10000 AS DOUBLE) * (k + 1) AS day_ntl_vlm, px AS prev_day_px,
         px * (1 + ((seq % 11) - 5) / CAST(10000 AS DOUBLE)) AS mark_px, CASE WHEN k % 5 <> 0 THEN px END AS mid_px
  FROM qfull),
md AS (SELECT symbol, ms + 500 AS ts, px AS mid, seq FROM ev WHERE event_type = 'view'),
cd AS (
  SELECT symbol, (ts // {6 * HOUR}) * {6 * HOUR} AS open_ts, (ts // {6 * HOUR}) * {6 * HOUR} + {6 * HOUR - 1} AS close_ts,
         arg_min(price, tid) AS open, max(price) AS high, min(price) AS low, arg_max(price, tid) AS close,
         sum(size) AS volume_base, count(*) AS trade_count, max(ts) AS recv_ts, max(seq) AS seq
  FROM tr GROUP BY 1, 2, 3)"""

ACCEPTED = f"""
arr AS (
  SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS newest FROM trd),
acc AS (
  SELECT symbol, ts, tid, min(seq) AS seq, any_value(side) AS side, any_value(price) AS price, any_value(size) AS size,
         any_value(notional) AS notional, count(*) - 1 AS copies
  FROM arr WHERE ts >= newest - {10 * DAY} GROUP BY symbol, ts, tid),
kept AS (
  SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS last_ts FROM acc) WHERE ts >= last_ts - {10 * DAY})"""

ONCE = """
kept AS (
  SELECT symbol, ts, tid, min(seq) AS seq, any_value(side) AS side, any_value(price) AS price, any_value(size) AS size,
         any_value(notional) AS notional, count(*) - 1 AS copies
  FROM trd GROUP BY symbol, ts, tid)"""

SINGLE_TIME = "times AS (SELECT max(ms) AS now_ms FROM ev)"
DAILY_TIMES = f"""
bounds AS (SELECT (min(ms) // {DAY} + 1) * {DAY} AS a, max(ms) AS b FROM ev),
times AS (SELECT unnest(range(a, a + CAST(ceil((b - a) / {DAY}.0) AS BIGINT) * {DAY} + 1, {DAY})) AS now_ms FROM bounds)"""


def _window(label: str, ms: int) -> str:
    return f"""
w_{label} AS (
  SELECT symbol, now_ms, price, row_number() OVER w AS rn, lag(price) OVER w AS p0
  FROM seen WHERE ts >= now_ms - {ms} WINDOW w AS (PARTITION BY symbol, now_ms ORDER BY ts, seq)),
a_{label} AS (
  SELECT symbol, now_ms, count(*) AS n,
         CASE WHEN count(*) >= 2 THEN (arg_max(price, rn) - arg_min(price, rn)) / arg_min(price, rn) END AS ret,
         CASE WHEN count(*) < 3 THEN 0 ELSE stddev_pop((price - p0) / p0) END AS rv
  FROM w_{label} GROUP BY 1, 2)"""


FEATURES = f"""
seen AS (SELECT t.*, now_ms FROM kept t JOIN times ON t.ts <= now_ms),
{_window("1m", 6 * HOUR)},
{_window("5m", DAY)},
{_window("1h", 7 * DAY)},
flow AS (
  SELECT symbol, now_ms, sum(CASE WHEN side = 'buy' THEN notional ELSE -notional END) AS flow, count(*) AS n,
         sum(notional) AS gross
  FROM seen WHERE ts >= now_ms - {3 * DAY} GROUP BY 1, 2),
lt AS (
  SELECT symbol, now_ms, arg_max(price, (ts, seq)) AS price, max(ts) AS lt_ts FROM seen GROUP BY 1, 2),
sparse AS (
  SELECT s.symbol, s.now_ms, count(*) AS n FROM seen s JOIN lt USING (symbol, now_ms)
  WHERE s.ts >= lt_ts - {10 * DAY} GROUP BY 1, 2),
qseen AS (SELECT q.*, now_ms FROM qt q JOIN times ON q.ts <= now_ms),
lq AS (
  SELECT symbol, now_ms, ts AS lq_ts, bid, bsz, ask, asz FROM qseen
  QUALIFY row_number() OVER (PARTITION BY symbol, now_ms ORDER BY ts DESC, seq DESC) = 1),
qwin AS (
  SELECT * FROM qseen WHERE ts >= now_ms - {7 * DAY}),
qp AS (
  SELECT symbol, now_ms, bid, bsz, ask, asz, lag(bid) OVER w AS b0, lag(bsz) OVER w AS bs0, lag(ask) OVER w AS a0,
         lag(asz) OVER w AS as0, row_number() OVER w AS rn
  FROM qwin WHERE ts >= now_ms - {3 * DAY} WINDOW w AS (PARTITION BY symbol, now_ms ORDER BY ts, seq)),
ofi AS (
  SELECT symbol, now_ms, CASE WHEN count(*) >= 2 THEN sum(CASE WHEN rn = 1 THEN 0 ELSE
    CASE WHEN b0 IS NULL OR bs0 IS NULL OR bid IS NULL OR bsz IS NULL THEN 0
         WHEN bid > b0 THEN bid * bsz WHEN bid = b0 THEN bid * (bsz - bs0) ELSE -(b0 * bs0) END
    + CASE WHEN a0 IS NULL OR as0 IS NULL OR ask IS NULL OR asz IS NULL THEN 0
         WHEN ask < a0 THEN -(ask * asz) WHEN ask = a0 THEN -(ask * (asz - as0)) ELSE a0 * as0 END END) END AS ofi
  FROM qp GROUP BY 1, 2),
sp AS (
  SELECT symbol, now_ms, ts, (ask - bid) / ((bid + ask) / 2) * 10000 AS bps,
         row_number() OVER (PARTITION BY symbol, now_ms ORDER BY ts, seq) AS rn
  FROM qwin WHERE bid IS NOT NULL AND ask IS NOT NULL AND bid <= ask AND bid > 0),
sp2 AS (SELECT *, max(bps) OVER (PARTITION BY symbol, now_ms) AS mx FROM sp),
sp3 AS (SELECT *, min(CASE WHEN bps = mx THEN rn END) OVER (PARTITION BY symbol, now_ms) AS at_rn FROM sp2),
sp4 AS (
  SELECT symbol, now_ms, count(*) AS n, max(mx) AS mx, median(bps) FILTER (rn < at_rn) AS base,
         max(ts) FILTER (rn = at_rn) AS shock_ts, arg_max(bps, rn) AS last_bps, arg_max(ts, rn) AS last_ts
  FROM sp3 GROUP BY 1, 2),
sp5 AS (
  SELECT *, n >= 2 AS enough,
         coalesce(n >= 2 AND mx - base >= 25 AND mx >= base * 2, FALSE) AS shock,
         last_bps <= greatest(base * 1.5, base + 10) AS recovered, last_ts - shock_ts AS elapsed
  FROM sp4),
shock AS (
  SELECT symbol, now_ms, CASE WHEN enough THEN CASE WHEN shock THEN mx - base ELSE 0 END END AS spread_shock_bps,
         CASE WHEN shock AND recovered THEN elapsed END AS spread_recovery_ms,
         CASE WHEN NOT enough THEN 'unknown' WHEN NOT shock OR recovered THEN 'normal' WHEN elapsed > {10 * HOUR} THEN 'brittle'
              WHEN last_bps < mx THEN 'recovering' ELSE 'shock' END AS resilience_state
  FROM sp5),
mu AS (
  SELECT symbol, seq, ts, (bid + ask) / 2 AS mid FROM (
    SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS newest FROM qt)
  WHERE ts = newest AND bid IS NOT NULL AND ask IS NOT NULL
  UNION ALL
  SELECT symbol, seq, ts, mid FROM (
    SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS newest FROM md)
  WHERE ts = newest),
lm AS (SELECT symbol, now_ms, arg_max(mid, seq) AS mid FROM mu JOIN times ON ts <= now_ms GROUP BY 1, 2),
fm AS (
  SELECT symbol, arg_min(mid_px, seq) AS mid, arg_min(ts, seq) AS ts FROM (
    SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS newest FROM cx)
  WHERE ts = newest AND mid_px IS NOT NULL GROUP BY 1),
lc AS (
  SELECT symbol, now_ms, ts AS lc_ts, day_ntl_vlm, mark_px FROM cx JOIN times ON ts <= now_ms
  QUALIFY row_number() OVER (PARTITION BY symbol, now_ms ORDER BY ts DESC, seq DESC) = 1),
lmd AS (SELECT symbol, now_ms, max(ts) AS lmd_ts FROM md JOIN times ON ts <= now_ms GROUP BY 1, 2),
cvis AS (SELECT c.*, now_ms FROM cd c JOIN times ON __CANDLE_VISIBLE__),
cz0 AS (
  SELECT *, max(open_ts) OVER (PARTITION BY symbol, now_ms) AS last_open FROM cvis),
cz AS (
  SELECT symbol, now_ms, max(close_ts) AS close_ts,
    CASE WHEN count(*) >= 3 AND stddev_pop(volume_base) FILTER (open_ts < last_open) > 0
         THEN (max(volume_base) FILTER (open_ts = last_open) - avg(volume_base) FILTER (open_ts < last_open))
              / stddev_pop(volume_base) FILTER (open_ts < last_open) ELSE 0 END AS vz,
    CASE WHEN count(*) >= 3 AND stddev_pop(trade_count) FILTER (open_ts < last_open) > 0
         THEN (max(trade_count) FILTER (open_ts = last_open) - avg(trade_count) FILTER (open_ts < last_open))
              / stddev_pop(trade_count) FILTER (open_ts < last_open) ELSE 0 END AS tz
  FROM cz0 GROUP BY 1, 2),
m1 AS (
  SELECT symbol, now_ms, count(*) AS n, sum(size) AS sz, sum(price * size) AS pxsz, sum(notional) AS ntl,
         (arg_max(price, (ts, tid)) - arg_min(price, (ts, tid))) / arg_min(price, (ts, tid)) AS ret
  FROM seen WHERE ts >= now_ms - {DAY} GROUP BY 1, 2),
m5a AS (
  SELECT symbol, now_ms, price, lag(price) OVER w AS p1, lag(price, 2) OVER w AS p2
  FROM seen WHERE ts >= now_ms - {7 * DAY} WINDOW w AS (PARTITION BY symbol, now_ms ORDER BY ts, tid)),
m5 AS (
  SELECT symbol, now_ms, count(*) AS n, avg((p1 - p2) * (price - p1)) AS cov,
         sum(abs((p1 - p2) / p2) * abs((price - p1) / p1)) AS bp
  FROM m5a GROUP BY 1, 2),
sy AS (SELECT DISTINCT symbol FROM ev),
raw AS (
  SELECT sy.symbol, times.now_ms,
    coalesce(lt.price, lm.mid, CASE WHEN fm.ts <= times.now_ms THEN fm.mid END, lc.mark_px) AS price,
    coalesce(lm.mid, CASE WHEN fm.ts <= times.now_ms THEN fm.mid END) AS mid_px, lc.mark_px, lc.day_ntl_vlm,
    lq.bid AS bid_px, lq.bsz AS bid_sz, lq.ask AS ask_px, lq.asz AS ask_sz,
    CASE WHEN lq.bid > 0 AND lq.ask > 0 AND lq.bid <= lq.ask THEN (lq.ask - lq.bid) / ((lq.bid + lq.ask) / 2) * 10000 END AS spread_bps,
    lq.bid * lq.bsz + lq.ask * lq.asz AS tob_depth_usd,
    CASE WHEN lq.bid * lq.bsz + lq.ask * lq.asz > 0 THEN
      (lq.bid * lq.bsz - lq.ask * lq.asz) / (lq.bid * lq.bsz + lq.ask * lq.asz) END AS tob_imbalance,
    shock.spread_shock_bps, shock.spread_recovery_ms, coalesce(shock.resilience_state, 'unknown') AS resilience_state,
    flow.flow AS signed_notional_flow_30s, flow.n AS flow_n, flow.gross, ofi.ofi AS bbo_ofi_proxy_30s,
    a_1m.ret AS ret_1m, a_5m.ret AS ret_5m, a_1h.ret AS ret_1h,
    coalesce(a_1m.rv, 0) AS rv_1m, coalesce(a_5m.rv, 0) AS rv_5m, coalesce(a_1h.rv, 0) AS rv_1h,
    cz.vz AS volume_z_1h, cz.tz AS trade_count_z_1h,
    coalesce(sparse.n, 0) < 2 AS sparse, coalesce(dups.n, 0) AS dups,
    greatest(lt_ts, lq_ts, lc_ts, lmd_ts, cz.close_ts) AS last_update_ms,
    m1.n AS m1_n, m1.sz, m1.pxsz, m1.ntl, m1.ret AS m1_ret, m5.n AS m5_n, m5.cov, m5.bp
  FROM sy CROSS JOIN times
  LEFT JOIN lt USING (symbol, now_ms) LEFT JOIN sparse USING (symbol, now_ms) LEFT JOIN lq USING (symbol, now_ms)
  LEFT JOIN shock USING (symbol, now_ms) LEFT JOIN ofi USING (symbol, now_ms) LEFT JOIN flow USING (symbol, now_ms)
  LEFT JOIN lm USING (symbol, now_ms) LEFT JOIN fm USING (symbol) LEFT JOIN lc USING (symbol, now_ms)
  LEFT JOIN lmd USING (symbol, now_ms) LEFT JOIN cz USING (symbol, now_ms)
  LEFT JOIN a_1m USING (symbol, now_ms) LEFT JOIN a_5m USING (symbol, now_ms) LEFT JOIN a_1h USING (symbol, now_ms)
  LEFT JOIN m1 USING (symbol, now_ms) LEFT JOIN m5 USING (symbol, now_ms) LEFT JOIN dups USING (symbol, now_ms)),
s1 AS (
  SELECT *, greatest(now_ms - last_update_ms, 0) AS updated_ms_ago,
    CASE WHEN last_update_ms IS NULL THEN 'incomplete' WHEN now_ms - last_update_ms <= {12 * HOUR} THEN 'fresh' ELSE 'stale' END AS staleness_state
  FROM raw),
s2 AS (
  SELECT *, CAST(greatest(100 - CASE WHEN staleness_state = 'stale' THEN 25 ELSE 0 END - CASE WHEN sparse THEN 40 ELSE 0 END
    - CASE WHEN dups > 0 THEN 10 ELSE 0 END, 0) AS INTEGER) AS confidence_score,
    list_filter([CASE WHEN staleness_state = 'stale' THEN 'stale_quote' END, CASE WHEN sparse THEN 'sparse_trades' END,
      CASE WHEN sparse THEN 'incomplete_window' END, CASE WHEN dups > 0 THEN 'duplicate_events' END], lambda x: x IS NOT NULL) AS reasons
  FROM s1),
s3 AS (
  SELECT *, CASE WHEN confidence_score >= 90 THEN 'high' WHEN confidence_score >= 70 THEN 'medium' WHEN confidence_score >= 30 THEN 'low' ELSE 'untrusted' END AS confidence_level,
    CASE WHEN signed_notional_flow_30s IS NULL OR bbo_ofi_proxy_30s IS NULL OR tob_depth_usd IS NULL THEN 'unknown'
      WHEN resilience_state IN ('brittle', 'shock') AND abs(signed_notional_flow_30s) / greatest(tob_depth_usd, 1) >= 1 THEN 'brittle'
      WHEN ((signed_notional_flow_30s >= 0) <> (bbo_ofi_proxy_30s >= 0) AND abs(signed_notional_flow_30s) / greatest(tob_depth_usd, 1) >= 0.1)
        OR abs(signed_notional_flow_30s) / greatest(tob_depth_usd, 1) >= 0.5 THEN 'watch' ELSE 'normal' END AS adverse_selection_proxy,
    coalesce(ret_5m, ret_1m, ret_1h) AS best_ret
  FROM s2),
s4 AS (
  SELECT *,
    CASE WHEN spread_bps IS NULL OR tob_depth_usd IS NULL OR resilience_state = 'unknown' THEN 'unknown'
      WHEN staleness_state <> 'fresh' OR confidence_level = 'untrusted' THEN 'stale'
      WHEN tob_depth_usd < 1000 THEN 'thin' WHEN spread_bps >= 50 OR resilience_state <> 'normal' THEN 'costly'
      WHEN spread_bps <= 25 AND tob_depth_usd >= 5000 AND confidence_level IN ('high', 'medium') THEN 'tradeable' ELSE 'costly' END AS tradeability_state,
    least(greatest(coalesce(tob_depth_usd, 0) / 100, 0), 100) AS liquidity_score,
    least(greatest(50 + coalesce(best_ret, 0) * 100, 0), 100) AS momentum_score,
    least(greatest(50 - coalesce(best_ret, 0) * 100, 0), 100) AS mean_reversion_score,
    coalesce(-least(greatest(spread_bps / 150, 0), 1) * 15, 0) AS spread_penalty,
    CASE WHEN signed_notional_flow_30s IS NULL THEN 0 ELSE least(abs(signed_notional_flow_30s) / 10000 * 100, 100) * CASE WHEN signed_notional_flow_30s >= 0 THEN 1 ELSE -1 END END AS flow_score
  FROM s3),
s5 AS (
  SELECT *, [struct_pack(name := 'liquidity_resilience', kind := 'resilience', raw := coalesce(tob_depth_usd, 0), norm := liquidity_score, weight := CAST(0.4 AS DOUBLE), c := liquidity_score * CAST(0.4 AS DOUBLE), win := 'top_of_book', pos := 0),
     struct_pack(name := 'momentum', kind := 'momentum', raw := coalesce(best_ret, 0) * 100, norm := momentum_score, weight := CAST(0.25 AS DOUBLE), c := momentum_score * CAST(0.25 AS DOUBLE), win := 'returns_1m_5m_1h', pos := 1),
     struct_pack(name := 'mean_reversion_context', kind := 'mean_reversion', raw := coalesce(best_ret, 0) * 100, norm := mean_reversion_score, weight := CAST(0.1 AS DOUBLE), c := mean_reversion_score * CAST(0.1 AS DOUBLE), win := 'returns_1m_5m_1h', pos := 2),
     struct_pack(name := 'signed_flow', kind := 'signed_flow', raw := coalesce(signed_notional_flow_30s, 0), norm := flow_score, weight := CAST(0.1 AS DOUBLE), c := flow_score * CAST(0.1 AS DOUBLE), win := 'trades_30s', pos := 3),
     struct_pack(name := 'spread_cost', kind := 'spread_cost', raw := coalesce(spread_bps, 0), norm := spread_penalty, weight := CAST(1.0 AS DOUBLE), c := spread_penalty * CAST(1.0 AS DOUBLE), win := 'bbo_latest', pos := 4)] AS comps,
    list_sort(list_filter([CASE WHEN best_ret IS NULL THEN 'return_window' END, CASE WHEN signed_notional_flow_30s IS NULL THEN 'signed_flow_30s' END,
      CASE WHEN spread_bps IS NULL THEN 'spread_cost' END, CASE WHEN tob_depth_usd IS NULL THEN 'top_of_book_depth' END], lambda x: x IS NOT NULL)) AS missing
  FROM s4),
snap AS (
  SELECT *, least(greatest(comps[1].c + comps[2].c + comps[3].c + comps[4].c + comps[5].c, 0), 100) AS raw_total,
    least(greatest(comps[1].c + comps[2].c + comps[3].c + comps[4].c + comps[5].c, 0), 100) * (confidence_score / CAST(100 AS DOUBLE)) AS adjusted_total
  FROM s5)"""

_SINGLE_DUPS = "dups AS (SELECT symbol, now_ms, sum(copies) AS n FROM acc CROSS JOIN times GROUP BY 1, 2)"
_GRID_DUPS = "dups AS (SELECT symbol, now_ms, sum(copies) AS n FROM kept JOIN times ON ts <= now_ms GROUP BY 1, 2)"


def r6(expr: str) -> str:
    """Round like the Spark side; adding zero removes a negative zero."""
    return f"(round({expr}, 6) + 0)"


def base(select: str) -> str:
    """A statement over the event views only."""
    return f"WITH {EVENTS}\n{select}"


def single(select: str) -> str:
    """A statement over ``snap``: one decision time at the newest event."""
    features = FEATURES.replace("__CANDLE_VISIBLE__", "recv_ts <= now_ms")
    return f"WITH {EVENTS},{ACCEPTED},\n{SINGLE_TIME},\n{_SINGLE_DUPS},{features}\n{select}"


def daily(select: str) -> str:
    """A statement over ``snap`` at every midnight of the tape."""
    features = FEATURES.replace("__CANDLE_VISIBLE__", "recv_ts <= now_ms")
    return f"WITH {EVENTS},{ONCE},{DAILY_TIMES},\n{_GRID_DUPS},{features}\n{select}"
