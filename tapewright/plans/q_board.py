"""Registered queries: market boards over the listed snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import board
from tapewright.plans import oracle_base as ob
from tapewright.plans.oracle_base import r6
from tapewright.plans.q_scores import META, listed
from tapewright.plans.registry import register, rounded

_BASE = f"""{META}
, b AS (SELECT *, signed_notional_flow_30s AS fl, tob_depth_usd AS dp, staleness_state <> 'fresh' AS nf,
    confidence_score < 70 OR staleness_state <> 'fresh' AS deg FROM listed)"""


def sql(select: str) -> str:
    return ob.single(f"{_BASE} {select}")


def r3(expr: str) -> str:
    return f"(round({expr}, 3) + 0)"


register(
    "B1_table_stats",
    lambda s, d: board.table_stats(listed(s, d)).withColumns(
        {c: F.round(c, 3) + 0 for c in ("median_spread_bps", "top_tob_depth_usd")}
    ),
    sql(f"""
    , st AS (SELECT count(*) AS row_count, count(*) FILTER (staleness_state = 'stale') AS stale, count(*) FILTER (staleness_state = 'incomplete') AS incomplete,
      count(spread_bps) AS spread_count, median(spread_bps) AS ms, count(dp) AS depth_count, max(dp) AS md,
      list_sort(list(updated_ms_ago))[CAST(ceil((count(updated_ms_ago) - 1) * 0.95) AS BIGINT) + 1] AS p95_age_ms,
      count(*) FILTER (confidence_level = 'high') AS confidence_high, count(*) FILTER (confidence_level = 'medium') AS confidence_medium,
      count(*) FILTER (confidence_level = 'low') AS confidence_low, count(*) FILTER (confidence_level = 'untrusted') AS confidence_untrusted,
      min(confidence_score) AS min_confidence_score, CAST(sum(len(reasons)) AS BIGINT) AS confidence_reason_count FROM b)
    SELECT * EXCLUDE (ms, md), {r3('ms')} AS median_spread_bps, {r3('md')} AS top_tob_depth_usd,
      CASE WHEN incomplete > 0 THEN 'CHECK' WHEN row_count = 0 OR ms IS NULL OR md IS NULL OR spread_count < row_count OR depth_count < row_count THEN 'PARTIAL'
        WHEN ms >= 100 OR md < 1000 THEN 'CHECK' WHEN ms >= 50 OR md < 5000 OR stale > 0 THEN 'WATCH' ELSE 'GOOD' END AS quality_status FROM st"""),
)
_UP, _DN = "count(*) FILTER (ret_1m > 0)", "count(*) FILTER (ret_1m < 0)"
register(
    "B2_market_internals",
    lambda s, d: board.market_internals(listed(s, d)).withColumns({c: F.round(c, 3) + 0 for c in ("signed_flow", "depth")}),
    sql(f"""SELECT count(*) AS row_count, {_UP} AS up, {_DN} AS down, count(*) FILTER (tradeability_state = 'tradeable') AS tradeable,
      count(*) FILTER (nf) AS stale, {r3('coalesce(sum(fl), 0)')} AS signed_flow, {r3('coalesce(sum(dp), 0)')} AS depth FROM b"""),
)
_REGIME = "CASE WHEN up + down = 0 THEN 'idle' WHEN up / (up + down) >= 0.65 THEN 'risk-on' WHEN up / (up + down) <= 0.35 THEN 'risk-off' ELSE 'mixed' END"
register(
    "B3_market_regime",
    lambda s, d: board.market_regime(listed(s, d)).withColumns({c: F.round(c, 3) + 0 for c in ("net_flow", "depth")}),
    sql(f""", a AS (SELECT {_UP} AS up, {_DN} AS down, {r3('coalesce(sum(fl), 0)')} AS net_flow, {r3('coalesce(sum(dp), 0)')} AS depth,
      least(CAST(sum(confidence_score) // count(*) AS BIGINT), 100) AS avg_confidence FROM b) SELECT *, {_REGIME} AS regime FROM a"""),
)


def _lead(value: str, size: str, name: str, where: str = "TRUE") -> str:
    pick = f"FILTER (({where}) AND {value} IS NOT NULL)"
    return f"arg_max(symbol, ({size}, symbol)) {pick} AS {name}_symbol, {r6(f'arg_max({value}, ({size}, symbol)) {pick}')} AS {name}_value"


_LEADERS = ("mover", "flow", "depth", "rise", "fall")
register(
    "B4_leaders",
    lambda s, d: board.leaders(listed(s, d)).withColumns({f"{n}_value": F.round(f"{n}_value", 6) + 0 for n in _LEADERS}),
    sql(f"""SELECT {_lead('ret_1m', 'abs(ret_1m)', 'mover')}, {_lead('fl', 'abs(fl)', 'flow')}, {_lead('dp', 'dp', 'depth')},
      {_lead('ret_1m', 'abs(ret_1m)', 'rise', 'ret_1m > 0')}, {_lead('ret_1m', 'abs(ret_1m)', 'fall', 'NOT ret_1m > 0')} FROM b"""),
)
register(
    "B5_flow_leaders",
    lambda s, d: board.flow_leaders(listed(s, d), 7).select(
        "symbol", "display_symbol", *rounded("signed_notional_flow_30s", digits=3)
    ),
    sql(f"SELECT symbol, display AS display_symbol, {r3('fl')} AS signed_notional_flow_30s FROM b ORDER BY abs(coalesce(fl, 0)) DESC, display LIMIT 7"),
)
register(
    "B5_flow_totals",
    lambda s, d: board.flow_totals(listed(s, d)).select(*rounded("net_flow", "gross_flow", "max_abs_flow", digits=3)),
    sql(f"SELECT {r3('coalesce(sum(fl), 0)')} AS net_flow, {r3('coalesce(sum(abs(fl)), 0)')} AS gross_flow, {r3('coalesce(max(abs(fl)), 0)')} AS max_abs_flow FROM b"),
)
register(
    "B6_flow_spectrum",
    lambda s, d: board.flow_spectrum(listed(s, d)).select(
        *rounded("buy_flow", "sell_flow", digits=3), *rounded("buy_share", "sell_share")
    ),
    sql(f""", a AS (SELECT coalesce(sum(fl) FILTER (fl > 0), 0) AS buy, coalesce(-sum(fl) FILTER (fl < 0), 0) AS sell FROM b)
    SELECT {r3('buy')} AS buy_flow, {r3('sell')} AS sell_flow, {r6('coalesce(buy / nullif(buy + sell, 0), 0)')} AS buy_share,
      {r6('coalesce(sell / nullif(buy + sell, 0), 0)')} AS sell_share FROM a"""),
)
register(
    "B7_cohort_counts",
    lambda s, d: board.cohort_counts(listed(s, d)),
    sql("""SELECT count(*) FILTER (list_contains(cohort_tags, 'new_listing')) AS new_listings, count(*) FILTER (list_contains(cohort_tags, 'fresh_liquidity')) AS fresh_liquidity,
      count(*) FILTER (list_contains(cohort_tags, 'low_float')) AS low_float,
      count(*) FILTER (NOT has_meta OR list_contains(cohort_tags, 'unknown_metadata') OR len(unknown_fields) > 0) AS unknown,
      arg_max(symbol, (seeded_usdc, symbol)) FILTER (seeded_usdc > 0) AS seed_symbol, arg_max(seeded_usdc, (seeded_usdc, symbol)) FILTER (seeded_usdc > 0) AS seed_value FROM b"""),
)
_RISK = ("net_flow", "gross_flow", "total_depth", "top_value")
register(
    "B8_risk_stack",
    lambda s, d: board.risk_stack(listed(s, d)).withColumns(
        {**{c: F.round(c, 3) + 0 for c in _RISK}, **{c: F.round(c, 6) + 0 for c in ("flow_skew", "top_share")}}
    ),
    sql(f""", a AS (SELECT {_UP} AS up, {_DN} AS down, coalesce(sum(fl), 0) AS net, coalesce(sum(abs(fl)), 0) AS gross, coalesce(sum(dp) FILTER (dp > 0), 0) AS total,
      arg_max(symbol, (dp, symbol)) FILTER (dp > 0) AS top_symbol, max(dp) FILTER (dp > 0) AS top, count(*) FILTER (deg) AS degraded, count(*) FILTER (nf) AS stale,
      count(*) FILTER (spread_bps > 25) AS wide_spread FROM b)
    SELECT up, down, {r3('net')} AS net_flow, {r3('gross')} AS gross_flow, {r3('total')} AS total_depth, top_symbol, {r3('top')} AS top_value, degraded, stale, wide_spread,
      {r6('coalesce(net / nullif(gross, 0), 0)')} AS flow_skew, {r6('coalesce(top / nullif(total, 0), 0)')} AS top_share,
      CASE WHEN degraded = 0 AND stale = 0 AND wide_spread = 0 THEN 'clean' WHEN degraded <= 2 AND stale <= 1 THEN 'review' ELSE 'degraded' END AS gate FROM a"""),
)
_DEPTHS = ("long_depth", "short_depth", "neutral_depth")
register(
    "B9_exposure_buckets",
    lambda s, d: board.exposure_buckets(listed(s, d)).withColumns(
        {**{c: F.round(c, 3) + 0 for c in _DEPTHS}, "depth_skew": F.round("depth_skew", 6) + 0}
    ),
    sql(f""", a AS (SELECT *, CASE WHEN ret_1m > 0 THEN 'l' WHEN ret_1m < 0 THEN 's' ELSE 'n' END AS side, CASE WHEN dp > 0 THEN dp END AS pd FROM b),
    c AS (SELECT count(*) FILTER (side = 'l') AS long_count, coalesce(sum(pd) FILTER (side = 'l'), 0) AS l, count(*) FILTER (side = 's') AS short_count,
      coalesce(sum(pd) FILTER (side = 's'), 0) AS s, count(*) FILTER (side = 'n') AS neutral_count, coalesce(sum(pd) FILTER (side = 'n'), 0) AS n,
      arg_min(symbol, (confidence_score, symbol)) AS drag_symbol, min(confidence_score) AS drag_score FROM a)
    SELECT long_count, short_count, neutral_count, {r3('l')} AS long_depth, {r3('s')} AS short_depth, {r3('n')} AS neutral_depth, drag_symbol, drag_score,
      {r6('coalesce((l - s) / nullif(l + s + n, 0), 0)')} AS depth_skew FROM c"""),
)
_WATCH = """SELECT symbol, display AS display_symbol, staleness_state, confidence_score, updated_ms_ago FROM b WHERE {}
  ORDER BY nf DESC, confidence_score < 70 DESC, coalesce(updated_ms_ago, 0) DESC, confidence_score, display LIMIT {}"""
register(
    "B10_quality_watch",
    lambda s, d: board.quality_watch(listed(s, d), 6),
    sql(_WATCH.format("deg OR updated_ms_ago > 2000", 6)),
)
register("B10_worst_quality_row", lambda s, d: board.worst_quality_row(listed(s, d)), sql(_WATCH.format("deg", 1)))
register(
    "B11_quality_matrix",
    lambda s, d: board.quality_matrix(listed(s, d)),
    sql("""SELECT count(*) AS total, count(*) FILTER (tradeability_state = 'tradeable') AS tradeable, count(*) FILTER (deg) AS degraded, count(*) FILTER (nf) AS stale,
      least(CAST(sum(confidence_score) // count(*) AS BIGINT), 100) AS confidence, count(*) FILTER (tradeability_state = 'tradeable') / count(*) AS tradeable_ratio FROM b"""),
)
register(
    "B12_row_age_p95",
    lambda s, d: board.row_age_p95(listed(s, d)),
    sql("""SELECT quantile_disc(updated_ms_ago, 0.95) AS p95_age_ms, count(*) FILTER (confidence_score < 70) AS low_confidence, count(*) FILTER (nf) AS stale FROM b"""),
)
register(
    "B13_signal_matrix",
    lambda s, d: board.signal_matrix(listed(s, d), 12).select(
        "symbol", "short_symbol", "direction", "flow_sign", "badge", *rounded("liquidity")
    ),
    sql(f"""SELECT symbol, substr(split_part(display, '/', 1), 1, 5) AS short_symbol,
      CAST(CASE WHEN coalesce(ret_1m, 0) <> 0 THEN sign(ret_1m) ELSE sign(coalesce(fl, 0)) END AS INTEGER) AS direction,
      CASE WHEN fl > 0 THEN '+' WHEN fl < 0 THEN '-' ELSE '=' END AS flow_sign,
      CASE WHEN deg THEN '!' WHEN tradeability_state = 'tradeable' THEN 'T' ELSE 'Q' END AS badge,
      {r6('coalesce(CASE WHEN dp > 0 THEN least(greatest(log10(dp) / 6, 0), 1) END, 0)')} AS liquidity FROM b ORDER BY symbol LIMIT 12"""),
)
register(
    "B14_rank_watchlist",
    lambda s, d: board.rank_watchlist(listed(s, d), ["now_ms"]).select("symbol", "rank", *rounded("score", digits=4)),
    sql("""SELECT symbol, CAST(row_number() OVER (ORDER BY least(greatest(adjusted_total, 0), 99) DESC, symbol) AS INTEGER) AS rank,
      round(least(greatest(adjusted_total, 0), 99), 4) + 0 AS score FROM b"""),
)
