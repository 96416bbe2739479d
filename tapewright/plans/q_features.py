"""Registered queries: top-of-book, window features, snapshots, research metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import book
from tapewright.operators import features, metrics, state
from tapewright.operators.timegrid import DecisionTimes
from tapewright.plans import oracle_base as ob
from tapewright.plans import views
from tapewright.plans.oracle_base import DAY, HOUR, r6
from tapewright.plans.registry import joined, register, rounded
from tapewright.plans.views import SCALED

QUOTE = ["symbol", "exchange_ts_ms", "ingest_seq"]
_KEYS = "symbol, ts AS exchange_ts_ms, seq AS ingest_seq"
SIDES = ("bid_price", "bid_size", "ask_price", "ask_size")


def _per_quote(name, column, sql, onesided=True):
    source = views.quotes_onesided if onesided else views.quotes
    register(
        name,
        lambda s, d: source(s, d).select(*QUOTE, column().alias("value")).select(*QUOTE, *rounded("value", digits=8)),
        ob.base(f"SELECT {_KEYS}, round({sql}, 8) + 0 AS value FROM {'qt' if onesided else 'qfull'}"),
    )


_per_quote(
    "F1_spread_bps",
    lambda: book.spread_bps("bid_price", "ask_price"),
    "CASE WHEN bid > 0 AND ask > 0 AND bid <= ask THEN (ask - bid) / ((bid + ask) / 2) * 10000 END",
)
_per_quote("F2_tob_depth_usd", lambda: book.tob_depth_usd(*SIDES), "bid * bsz + ask * asz")
_per_quote(
    "F3_tob_imbalance",
    lambda: book.tob_imbalance(*SIDES),
    "CASE WHEN bid * bsz + ask * asz > 0 THEN (bid * bsz - ask * asz) / (bid * bsz + ask * asz) END",
)


def _microprice(s, d):
    micro, mid = book.microprice(*SIDES), (F.col("bid_price") + F.col("ask_price")) / 2
    return (
        views.quotes_onesided(s, d)
        .select(*QUOTE, micro.alias("microprice"), book.edge_bps(micro, mid).alias("edge_bps"))
        .select(*QUOTE, *rounded("microprice", "edge_bps", digits=4))
    )


_MICRO = "(ask * bsz + bid * asz) / (bsz + asz)"
register(
    "F4_microprice_edge",
    _microprice,
    ob.base(
        f"SELECT {_KEYS}, round({_MICRO}, 4) + 0 AS microprice, "
        f"round(({_MICRO} - (bid + ask) / 2) / ((bid + ask) / 2) * 10000, 4) + 0 AS edge_bps FROM qt"
    ),
)


def _shares(s, d):
    bids, asks = book.quote_shares(F.col("bid_price") * F.col("bid_size"), F.col("ask_price") * F.col("ask_size"))
    rows = views.quotes_onesided(s, d).select(*QUOTE, bids.alias("bid_share"), asks.alias("ask_share"))
    skew = F.col("bid_share") - F.col("ask_share")
    return rows.withColumn("queue", book.queue_label(skew)).select(*QUOTE, "queue", *rounded("bid_share", "ask_share"))


register(
    "F5_quote_share",
    _shares,
    ob.base(f"""
    , sh AS (SELECT *, bid * bsz AS b, coalesce(ask * asz, 0) AS a FROM qt)
    SELECT {_KEYS}, {r6('b / (a + b)')} AS bid_share, {r6('a / (a + b)')} AS ask_share,
      CASE WHEN b / (a + b) - a / (a + b) > 0.08 THEN 'bid-heavy' WHEN b / (a + b) - a / (a + b) < -0.08 THEN 'ask-heavy' ELSE 'balanced' END AS queue
    FROM sh"""),
)
register(
    "F6_basis_bps",
    lambda s, d: views.contexts(s, d)
    .select("symbol", "ingest_seq", book.basis_bps("mark_px", "mid_px").alias("basis_bps"))
    .select("symbol", "ingest_seq", *rounded("basis_bps", digits=4)),
    ob.base("SELECT symbol, seq AS ingest_seq, round((mark_px / mid_px - 1) * 10000, 4) + 0 AS basis_bps FROM cx"),
)


def _windows(s, d, columns):
    now = views.now_ms(s, d)
    # Only the longest window is read: the bound reaches the scan as a pushed filter.
    scanned = features.scan_trades(views.trades_once(s, d, now - SCALED.longest_trade_window_ms))
    rows = features.trade_windows(scanned, DecisionTimes.at(now), SCALED)
    return rows.select("symbol", "now_ms", *rounded(*columns))


def _tw_sql(columns: str) -> str:
    """Window features over the clean tape, without retention."""
    clean = "kept AS (SELECT symbol, ts, tid, seq, side, price, size, notional, CAST(0 AS BIGINT) AS copies FROM tr), acc AS (SELECT * FROM kept)"
    features_sql = ob.FEATURES.replace("__CANDLE_VISIBLE__", "TRUE")
    return f"WITH {ob.EVENTS}, {clean}, {ob.SINGLE_TIME}, {ob._SINGLE_DUPS},{features_sql}\n{columns}"


_RET = ["ret_1m", "ret_5m", "ret_1h"]
_RV = ["rv_1m", "rv_5m", "rv_1h"]
register(
    "F7_window_return",
    lambda s, d: _windows(s, d, _RET),
    _tw_sql(f"SELECT symbol, now_ms, {', '.join(f'{r6(c)} AS {c}' for c in _RET)} FROM snap"),
)
register(
    "F8_realized_vol",
    lambda s, d: _windows(s, d, _RV),
    _tw_sql(f"SELECT symbol, now_ms, {', '.join(f'{r6(c)} AS {c}' for c in _RV)} FROM snap"),
)
register(
    "F9_history_return_and_vol",
    lambda s, d: features.history_return_and_vol(features.scan_trades(views.trades_once(s, d))).select(
        "symbol", *rounded("ret_all", "rv_all")
    ),
    ob.base(f"""
    , h AS (SELECT symbol, price, row_number() OVER w AS rn, lag(price) OVER w AS p0 FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq))
    SELECT symbol, {r6('(arg_max(price, rn) - arg_min(price, rn)) / arg_min(price, rn)')} AS ret_all,
      {r6('CASE WHEN count(*) < 3 THEN 0 ELSE stddev_pop((price - p0) / p0) END')} AS rv_all FROM h GROUP BY 1"""),
)
register(
    "F10_candle_z",
    lambda s, d: features.candle_z(views.candles(s, d)).select(
        "symbol", *rounded("volume_z_1h", "trade_count_z_1h")
    ),
    ob.single(f"SELECT symbol, {r6('volume_z_1h')} AS volume_z_1h, {r6('trade_count_z_1h')} AS trade_count_z_1h FROM snap"),
)
register(
    "F11_signed_flow",
    lambda s, d: _windows(s, d, ["signed_notional_flow_30s"]),
    _tw_sql(f"SELECT symbol, now_ms, {r6('signed_notional_flow_30s')} AS signed_notional_flow_30s FROM snap"),
)


def _quote_windows(s, d):
    now = views.now_ms(s, d)
    near = views.quotes_onesided(s, d, now - max(SCALED.flow_ms, SCALED.shock_ms))
    return features.quote_windows(near, DecisionTimes.at(now), SCALED)


register(
    "F12_bbo_ofi",
    lambda s, d: _quote_windows(s, d).select("symbol", "now_ms", *rounded("bbo_ofi_proxy_30s", digits=4)),
    ob.single("SELECT symbol, now_ms, round(bbo_ofi_proxy_30s, 4) + 0 AS bbo_ofi_proxy_30s FROM snap"),
)
register(
    "F13_spread_shock",
    lambda s, d: _quote_windows(s, d).select(
        "symbol", "spread_recovery_ms", "resilience_state", *rounded("spread_shock_bps")
    ),
    ob.single(f"SELECT symbol, spread_recovery_ms, resilience_state, {r6('spread_shock_bps')} AS spread_shock_bps FROM snap"),
)


def _snapshot(s, d):
    return views.feature_table(s, d, "now")


register(
    "F14_adverse_selection",
    lambda s, d: _snapshot(s, d).select("symbol", "adverse_selection_proxy"),
    ob.single("SELECT symbol, adverse_selection_proxy FROM snap"),
)
register(
    "F15_price",
    lambda s, d: _snapshot(s, d).select("symbol", *rounded("price", "mid_px", "mark_px")),
    ob.single(f"SELECT symbol, {r6('price')} AS price, {r6('mid_px')} AS mid_px, {r6('mark_px')} AS mark_px FROM snap"),
)

NUMBERS = [
    "price", "mid_px", "mark_px", "day_ntl_vlm", "bid_px", "bid_sz", "ask_px", "ask_sz", "spread_bps", "tob_imbalance",
    "spread_shock_bps", "ret_1m", "ret_5m", "ret_1h", "rv_1m", "rv_5m", "rv_1h", "volume_z_1h", "trade_count_z_1h",
    "momentum_score", "mean_reversion_score",
]
AMOUNTS = ["tob_depth_usd", "signed_notional_flow_30s", "bbo_ofi_proxy_30s", "liquidity_score"]
LABELS = [
    "symbol", "now_ms", "spread_recovery_ms", "resilience_state", "tradeability_state", "adverse_selection_proxy",
    "updated_ms_ago", "staleness_state",
]


def flat(rows):
    return rows.select(
        *LABELS,
        *rounded(*NUMBERS),
        *rounded(*AMOUNTS, digits=3),
        F.col("confidence.score").alias("confidence_score"),
        F.col("confidence.level").alias("confidence_level"),
        F.array_join("confidence.reasons", ",").alias("reasons"),
        (F.round("score_breakdown.raw_total", 4) + 0).alias("raw_total"),
        (F.round("score_breakdown.adjusted_total", 4) + 0).alias("adjusted_total"),
    )


FLAT = (
    f"SELECT {', '.join(LABELS)}, {', '.join(f'{r6(c)} AS {c}' for c in NUMBERS)}, "
    f"{', '.join(f'round({c}, 3) + 0 AS {c}' for c in AMOUNTS)}, confidence_score, confidence_level, "
    "array_to_string(reasons, ',') AS reasons, round(raw_total, 4) + 0 AS raw_total, "
    "round(adjusted_total, 4) + 0 AS adjusted_total FROM snap"
)
register("F16_snapshot", lambda s, d: flat(views.snapshots(s, d)), ob.single(FLAT))
register("F17_snapshots_at_daily", lambda s, d: flat(views.daily_snapshots(s, d)), ob.daily(FLAT))

# --- research metrics -----------------------------------------------------------------------------

_VWAP = "CASE WHEN m1_n >= 3 AND sz > 0 AND pxsz > 0 THEN pxsz / sz END"
_M = {
    "public_trade_vwap_1m": ("M1_public_trade_vwap", _VWAP, "m1_n >= 3"),
    "public_trade_return_1m": ("M2_public_trade_return", "CASE WHEN m1_n >= 3 THEN m1_ret END", "m1_n >= 3"),
    "amihud_1m": ("M3_amihud", "CASE WHEN m1_n >= 2 AND ntl > 0 THEN abs(m1_ret) / ntl END", "m1_n >= 2"),
    "roll_effective_spread": ("M4_roll_spread", "CASE WHEN m5_n >= 4 AND cov < 0 THEN 2 * sqrt(-cov) END", "m5_n >= 4"),
    "bipower_variation_5m": ("M5_bipower_variation", "CASE WHEN m5_n >= 3 THEN pi() / 2 * bp END", "m5_n >= 3"),
    "bbo_ofi_proxy_30s": ("M6_bbo_ofi_metric", "bbo_ofi_proxy_30s", "bbo_ofi_proxy_30s IS NOT NULL"),
    "signed_flow_toxicity_proxy_30s": (
        "M7_signed_flow_toxicity",
        "CASE WHEN flow_n >= 2 AND gross > 0 THEN least(abs(signed_notional_flow_30s) / gross, 1) END",
        "flow_n >= 2",
    ),
    "adverse_selection_toxicity_proxy": (
        "M8_adverse_selection_metric",
        "CAST(CASE adverse_selection_proxy WHEN 'normal' THEN 0 WHEN 'watch' THEN 1 WHEN 'brittle' THEN 2 END AS DOUBLE)",
        "adverse_selection_proxy <> 'unknown'",
    ),
}


def _digits(name: str) -> int:
    return {"amihud_1m": 14, "bbo_ofi_proxy_30s": 8}.get(name, 9)


def _quoted(text: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if text is None else "'" + text.replace("'", "''") + "'"


def _metric_sql(name: str, value: str, enough: str, position: int | None = None) -> str:
    kind = "canonical" if name in metrics.CANONICAL else "proxy"
    bad = metrics.BAD_INPUT_REASON.get(name, metrics.TOO_FEW_REASON[name])
    pos = f"{position} AS position, " if position is not None else ""
    return (
        f"SELECT symbol, now_ms, {pos}'{name}' AS name, CASE WHEN ({value}) IS NOT NULL THEN '{kind}' ELSE 'unavailable' END AS support, "
        f"round({value}, {_digits(name)}) + 0 AS value, '{metrics.UNITS[name]}' AS unit, "
        f"CASE WHEN ({value}) IS NOT NULL THEN {_quoted(metrics.PROXY_REASON.get(name))} "
        f"WHEN {enough} THEN {_quoted(bad)} ELSE {_quoted(metrics.TOO_FEW_REASON[name])} END AS reason FROM snap"
    )


def _one_metric(name):
    return lambda s, d: metrics.metric(_snapshot(s, d), name).select(
        "symbol", "now_ms", "name", "support", "unit", "reason", *rounded("value", digits=_digits(name))
    )


for _name, (_query, _value, _enough) in _M.items():
    register(_query, _one_metric(_name), ob.single(_metric_sql(_name, _value, _enough)))


def _tall(s, d):
    value = F.lit(None).cast("double")
    for name in metrics.NAMES:
        value = F.when(F.col("name") == name, F.round("value", _digits(name))).otherwise(value)
    return metrics.metric_rows(views.feature_table(s, d, "daily")).withColumn("value", value + 0)


register(
    "M9_metric_rows",
    _tall,
    ob.daily(
        "\nUNION ALL\n".join(
            _metric_sql(name, *_M[name][1:], position=i) for i, name in enumerate(metrics.NAMES)
        )
    ),
)


def _validated(s, d):
    """The streaming-style window aggregate against an independent one-pass VWAP."""
    now = views.now_ms(s, d)
    near = views.trades_once(s, d, now - DAY)
    expected = near.groupBy("symbol").agg(
        (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("expected_value"),
        F.count(F.lit(1)).alias("observations"),
    )
    actual = metrics.metric(
        features.snapshot(features.Market(views.trades_once(s, d), views.quotes(s, d), symbols=views.symbols(s, d)), now, views.OPTIONS),
        "public_trade_vwap_1m",
    ).select("symbol", "value")
    contract = metrics.CANONICAL_CONTRACTS[0]
    return metrics.validate_metric(actual, expected, contract, ["symbol"]).select("symbol", "observations", "verdict")


register(
    "M10_validate_metric",
    _validated,
    ob.base(f"""SELECT symbol, count(*) AS observations, CASE WHEN count(*) < 3 THEN 'insufficient' ELSE 'ok' END AS verdict
    FROM tr WHERE ts >= (SELECT max(ms) FROM ev) - {DAY} GROUP BY 1"""),
)
