"""Registered queries: classification, confidence, scores, screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import labels
from tapewright.operators import candles as tape
from tapewright.operators import scoring, screen
from tapewright.plans import oracle_base as ob
from tapewright.plans import views
from tapewright.plans.oracle_base import DAY, r6
from tapewright.plans.registry import register, rounded

PROFILE = scoring.FeeProfile("blended", 150, 450, 200, 2_500, 6_000, taker_fill_ratio_hundredths=6_000)
COSTLY = scoring.FeeProfile("taker-only", 300, 700, 500, 2_000, 4_000)


def now(s, d):
    return views.feature_table(s, d, "now")


def daily(s, d):
    return views.feature_table(s, d, "daily")


register(
    "C1_tradeability_state",
    lambda s, d: daily(s, d).select("symbol", "now_ms", "tradeability_state"),
    ob.daily("SELECT symbol, now_ms, tradeability_state FROM snap"),
)


def _fee_sql(p: scoring.FeeProfile) -> str:
    cost = f"(spread_bps + CAST({p.round_trip_cost_bps!r} AS DOUBLE))"
    limit = p.max_tradeable_round_trip_hundredths_bps / 100
    return f"""SELECT symbol, now_ms, '{p.name}' AS profile, round({cost}, 4) + 0 AS cost,
      CASE WHEN tradeability_state <> 'tradeable' THEN tradeability_state WHEN {cost} <= {limit} THEN 'tradeable' ELSE 'costly' END AS state,
      CASE WHEN tradeability_state <> 'tradeable' THEN 'base_tradeability_' || tradeability_state WHEN {cost} <= {limit} THEN 'within_tradeable_fee_threshold' ELSE 'fee_cost_exceeds_tradeable_threshold' END AS reason
    FROM snap WHERE spread_bps IS NOT NULL"""


def _fees(rows):
    f = "fee_aware_tradeability"
    return rows.filter(F.col(f).isNotNull()).select(
        "symbol", "now_ms", F.col(f"{f}.profile_name").alias("profile"),
        (F.round(f"{f}.expected_round_trip_cost_bps", 4) + 0).alias("cost"),
        F.col(f"{f}.state").alias("state"), F.col(f"{f}.reason").alias("reason"),
    )


register(
    "C2_fee_aware_tradeability",
    lambda s, d: _fees(scoring.apply_fee_profile(daily(s, d), PROFILE)),
    ob.daily(_fee_sql(PROFILE)),
)
register(
    "C2_many_fee_profiles",
    lambda s, d: _fees(scoring.apply_fee_profiles(daily(s, d), [PROFILE, COSTLY])),
    ob.daily(f"{_fee_sql(PROFILE)} UNION ALL {_fee_sql(COSTLY)}"),
)
register(
    "C3_liquidity_cost_class",
    lambda s, d: daily(s, d).select("symbol", "now_ms", labels.liquidity_cost_class().alias("cost_class")),
    ob.daily("""SELECT symbol, now_ms, CASE WHEN spread_bps IS NULL OR tob_depth_usd IS NULL THEN 'unknown'
      WHEN liquidity_score >= 70 AND spread_bps <= 20 AND tob_depth_usd >= 10000 THEN 'low'
      WHEN liquidity_score >= 20 AND spread_bps <= 75 AND tob_depth_usd >= 1000 THEN 'med' ELSE 'high' END AS cost_class FROM snap"""),
)
register(
    "C4_row_labels",
    lambda s, d: daily(s, d).select(
        "symbol", "now_ms", labels.spread_gate().alias("spread_gate"), labels.spread_cost().alias("spread_cost"),
        labels.pair_risk().alias("pair_risk"), labels.quality_badge().alias("badge"), labels.regime_label().alias("regime"),
    ),
    ob.daily("""SELECT symbol, now_ms,
      CASE WHEN spread_bps IS NULL THEN 'unknown' WHEN spread_bps <= 5 THEN 'tight' WHEN spread_bps <= 25 THEN 'workable' ELSE 'wide' END AS spread_gate,
      CASE WHEN spread_bps IS NULL THEN 'unknown' WHEN spread_bps <= 5 THEN 'tight' WHEN spread_bps <= 25 THEN 'normal' ELSE 'wide' END AS spread_cost,
      CASE WHEN confidence_score < 60 OR staleness_state = 'stale' THEN 'elevated' WHEN staleness_state = 'incomplete' THEN 'partial' WHEN spread_bps > 25 THEN 'costly' ELSE 'normal' END AS pair_risk,
      CASE WHEN confidence_score < 70 OR staleness_state <> 'fresh' THEN '!' WHEN tradeability_state = 'tradeable' THEN 'T' ELSE 'Q' END AS badge,
      CASE WHEN coalesce(ret_1m, 0) * 100 >= 0.1 THEN 'MOMENTUM' WHEN coalesce(ret_1m, 0) * 100 <= -0.1 THEN 'DOWNTREND' WHEN mean_reversion_score > momentum_score THEN 'MEAN REVERSION' ELSE 'BALANCED' END AS regime
    FROM snap"""),
)

# Listing metadata of the event symbols, in SQL.
META = f"""
, em AS (SELECT symbol, min(ms) AS first_ms, count(*) AS n, count(*) FILTER (px - 100 < 4) AS m, avg(px) AS mean FROM ev GROUP BY 1)
, mi AS (
  SELECT symbol, symbol || '/USD' AS display_name, CAST(substr(symbol, 2, 2) AS INTEGER) AS i, first_ms, n, m FROM em
  WHERE mean > (SELECT avg(px) FROM ev))
, mt0 AS (
  SELECT symbol, display_name, first_ms + i * {DAY} AS deploy_time_ms, CASE WHEN m >= n * 0.535 THEN 'd' || i END AS deployer,
         CASE WHEN m >= n * 0.55 THEN CAST(n * 10 AS DOUBLE) END AS seeded_usdc, CAST(n AS DOUBLE) AS max_supply,
         CAST(m * 0.45 AS DOUBLE) AS circulating_supply, (SELECT max(ms) FROM ev) AS now FROM mi)
, mt1 AS (
  SELECT *, greatest(now - deploy_time_ms, 0) AS listing_age_ms,
         list_filter([CASE WHEN deployer IS NULL THEN 'deployer' END, CASE WHEN seeded_usdc IS NULL THEN 'seeded_usdc' END], lambda x: x IS NOT NULL) AS unknown_fields
  FROM mt0)
, mt2 AS (
  SELECT *, list_filter([CASE WHEN listing_age_ms <= {14 * DAY} THEN 'new_listing' END, CASE WHEN seeded_usdc > 0 THEN 'fresh_liquidity' END,
    CASE WHEN circulating_supply / max_supply <= 0.25 THEN 'low_float' END], lambda x: x IS NOT NULL) AS known FROM mt1)
, mt AS (
  SELECT *, list_sort(list_concat(known, CASE WHEN len(unknown_fields) > 0 OR len(known) = 0 THEN ['unknown_metadata'] ELSE [] END)) AS cohort_tags FROM mt2)
, listed AS (SELECT s.*, coalesce(m.display_name, s.symbol) AS display, m.display_name IS NOT NULL AS has_meta, m.deploy_time_ms, m.listing_age_ms, m.deployer, m.seeded_usdc, m.max_supply,
    m.circulating_supply, m.cohort_tags, m.unknown_fields, m.now AS fetched FROM snap s LEFT JOIN mt m USING (symbol))"""


def listed(s, d):
    return views.feature_table(s, d, "listed")


OBSERVED = """list_filter([CASE WHEN staleness_state = 'stale' THEN 'stale feed' WHEN staleness_state = 'incomplete' THEN 'partial data' END,
  CASE confidence_level WHEN 'low' THEN 'low confidence' WHEN 'untrusted' THEN 'untrusted data' END,
  CASE tradeability_state WHEN 'thin' THEN 'thin tradeability' WHEN 'costly' THEN 'costly tradeability' WHEN 'stale' THEN 'stale tradeability' END,
  CASE resilience_state WHEN 'shock' THEN 'spread shock' WHEN 'recovering' THEN 'recovering book' WHEN 'brittle' THEN 'brittle book' END,
  CASE adverse_selection_proxy WHEN 'watch' THEN 'flow watch' WHEN 'brittle' THEN 'adverse proxy' END,
  CASE WHEN tob_depth_usd < 1000 THEN 'thin book' END,
  CASE WHEN spread_bps >= 50 THEN 'wide spread' WHEN spread_bps <= 10 THEN 'tight spread' END,
  CASE WHEN abs(ret_1m) >= 0.005 THEN 'move active' END, CASE WHEN abs(tob_imbalance) >= 0.4 THEN 'imbalanced' END,
  CASE WHEN list_contains(cohort_tags, 'new_listing') THEN 'new listing' END,
  CASE WHEN list_contains(cohort_tags, 'fresh_liquidity') THEN 'fresh liquidity' END,
  CASE WHEN list_contains(cohort_tags, 'unknown_metadata') THEN 'metadata partial' END], lambda x: x IS NOT NULL)"""
_SHORT = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.SHORT_OBSERVATION.items()) + " ELSE x END"
register(
    "C5_observation_tags",
    lambda s, d: listed(s, d)
    .withColumn("seen", labels.observation_tags())
    .select("symbol", F.array_join("seen", ",").alias("tags"), labels.why_now(F.col("seen")).alias("why_now")),
    ob.single(f"""{META}, o AS (SELECT symbol, {OBSERVED} AS seen FROM listed)
    SELECT symbol, array_to_string(seen, ',') AS tags, CASE WHEN len(seen) = 0 THEN 'steady' ELSE
      array_to_string(list_transform(seen[1:2], lambda x: {_SHORT}), ' + ') END AS why_now FROM o"""),
)

_PRESSURE = "least(greatest(coalesce(signed_notional_flow_30s, 0) / greatest(abs(coalesce(tob_depth_usd, 0)), 1), -1), 1)"
_DEPTH_SCALE = "coalesce(CASE WHEN tob_depth_usd > 0 THEN least(greatest(log10(tob_depth_usd) / 6, 0), 1) END, 0)"
_SPREAD_Q = "CASE WHEN spread_bps IS NULL THEN 0 ELSE 1 - least(greatest(spread_bps / {}, 0), 1) END"
_ALPHA = f"least(greatest({_PRESSURE} * 0.65::DOUBLE + least(greatest(coalesce(ret_1m, 0) * 100, -1), 1) * 0.35::DOUBLE, -1), 1)"
register(
    "C6_heat_and_alpha",
    lambda s, d: daily(s, d).select(
        "symbol", "now_ms", labels.liquidity_heat().alias("heat"), labels.alpha_signal().alias("alpha"),
        labels.spread_quality(25.0).alias("radar_spread"), labels.depth_scale().alias("radar_depth"),
    ).select("symbol", "now_ms", *rounded("heat", "alpha", "radar_spread", "radar_depth")),
    ob.daily(f"""SELECT symbol, now_ms, {r6(f"({_SPREAD_Q.format(20)}) * 0.55::DOUBLE + {_DEPTH_SCALE} * 0.45::DOUBLE")} AS heat,
      {r6(_ALPHA)} AS alpha, {r6(_SPREAD_Q.format(25))} AS radar_spread, {r6(_DEPTH_SCALE)} AS radar_depth FROM snap"""),
)


def _bias(s, d):
    trend = tape.candle_summary(tape.recent_candles(views.candles(s, d), "6h", 30)).select("symbol", "trend_pct")
    rows = now(s, d).join(trend, "symbol", "left")
    signal = labels.strategy_signal(F.col("trend_pct"))
    return rows.select("symbol", labels.strategy_bias(signal).alias("bias"), signal.alias("signal")).select(
        "symbol", "bias", *rounded("signal")
    )


_SIGNAL_VALUE = "least(greatest(adjusted_total, 0), 99)"
_STRATEGY = (
    f"least(greatest(least(greatest(coalesce(trend_pct, 0) / 5, -1), 1) * 0.35::DOUBLE + {_PRESSURE} * 0.45::DOUBLE + "
    f"least(greatest({_SIGNAL_VALUE} / 100 * 2 - 1, -1), 1) * 0.2::DOUBLE, -1), 1)"
)
register(
    "C7_strategy_bias",
    _bias,
    ob.single(f"""
    , rc AS (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_ts DESC) <= 30)
    , tr30 AS (SELECT symbol, (arg_max(close, open_ts) - arg_min(open, open_ts)) / arg_min(open, open_ts) * 100 AS trend_pct FROM rc GROUP BY 1)
    , g AS (SELECT *, {_STRATEGY} AS signal FROM snap LEFT JOIN tr30 USING (symbol))
    SELECT symbol, {r6('signal')} AS signal, CASE WHEN confidence_score < 70 THEN 'confidence-watch' WHEN spread_bps IS NULL OR spread_bps > 5 THEN 'liquidity-watch'
      WHEN signal > 0.25 THEN 'momentum-watch' WHEN signal < -0.25 THEN 'pressure-watch' ELSE 'balanced-watch' END AS bias FROM g"""),
)

# --- confidence and scores ------------------------------------------------------------------------

register(
    "Q1_confidence",
    lambda s, d: daily(s, d).select(
        "symbol", "now_ms", F.col("confidence.score").alias("score"), F.col("confidence.level").alias("level"),
        F.array_join("confidence.reasons", ",").alias("reasons"), F.array_join("confidence.incomplete_windows", ",").alias("incomplete"),
    ),
    ob.daily("""SELECT symbol, now_ms, confidence_score AS score, confidence_level AS level, array_to_string(reasons, ',') AS reasons,
      CASE WHEN sparse THEN 'returns,realized_volatility,microstructure_windows' ELSE '' END AS incomplete FROM snap"""),
)
register(
    "Q2_scores",
    lambda s, d: daily(s, d).select(
        "symbol", "now_ms", *rounded("momentum_score", "mean_reversion_score"), *rounded("liquidity_score", digits=4)
    ),
    ob.daily(f"""SELECT symbol, now_ms, {r6('momentum_score')} AS momentum_score, {r6('mean_reversion_score')} AS mean_reversion_score,
      round(liquidity_score, 4) + 0 AS liquidity_score FROM snap"""),
)
register(
    "Q3_score_breakdown",
    lambda s, d: daily(s, d).select(
        "symbol", "now_ms", (F.round("score_breakdown.raw_total", 4) + 0).alias("raw_total"),
        (F.round("score_breakdown.adjusted_total", 4) + 0).alias("adjusted_total"),
        F.size("score_breakdown.components").alias("components"),
        F.array_join("score_breakdown.unavailable_evidence", ",").alias("missing"),
    ),
    ob.daily("""SELECT symbol, now_ms, round(raw_total, 4) + 0 AS raw_total, round(adjusted_total, 4) + 0 AS adjusted_total,
      CAST(len(comps) AS INTEGER) AS components, array_to_string(missing, ',') AS missing FROM snap"""),
)
register(
    "Q4_explain",
    lambda s, d: scoring.explain(now(s, d)).select(
        "symbol", "position", "name", "kind", "direction", "evidence_window", "weight",
        *rounded("raw_value", "normalized_value", "signed_contribution", "confidence_penalty", digits=8),
    ),
    # contributions of the tape have six decimals: rounding to fewer would hit ties, which the order of a sum decides
    ob.single("""SELECT symbol, u.pos AS position, u.name AS name, u.kind AS kind,
      CASE WHEN u.c > 0 THEN 'positive' WHEN u.c < 0 THEN 'negative' ELSE 'neutral' END AS direction, u.win AS evidence_window, u.weight AS weight,
      round(CAST(u.raw AS DOUBLE), 8) + 0 AS raw_value, round(CAST(u.norm AS DOUBLE), 8) + 0 AS normalized_value, round(CAST(u.c AS DOUBLE), 8) + 0 AS signed_contribution,
      round(adjusted_total - raw_total, 8) + 0 AS confidence_penalty
    FROM (SELECT symbol, raw_total, adjusted_total, unnest(comps) AS u FROM snap)"""),
)
_NAMES = "CASE top.name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scoring.SHORT_NAME.items()) + " END"
register(
    "Q5_top_driver",
    lambda s, d: scoring.top_driver(daily(s, d)),
    ob.daily(f"""
    , t AS (SELECT *, list_sort(list_transform(comps, lambda c: struct_pack(a := -abs(c.c), name := c.name, c := c.c)))[1] AS top,
        list_transform(list_filter(comps, lambda c: abs(c.c) > 0.5), lambda c: CASE WHEN c.c > 0 THEN '+' ELSE '-' END || c.name) AS strong FROM snap)
    SELECT symbol, now_ms, upper({_NAMES}) || CASE WHEN top.c < 0 THEN '-' ELSE '+' END AS score_bias,
      CASE WHEN confidence_score < 50 OR staleness_state <> 'fresh' THEN 'data' ELSE {_NAMES} || CASE WHEN top.c < 0 THEN '-' ELSE '+' END END AS why_ranked,
      CASE WHEN len(strong) = 0 THEN 'score ' || printf('%.1f', adjusted_total) ELSE array_to_string(strong[1:4], ' ') END
        || CASE WHEN len(missing) > 0 THEN ' missing:' || array_to_string(missing, ',') ELSE '' END AS tokens
    FROM t"""),
)
register(
    "Q6_confidence_summary",
    lambda s, d: scoring.confidence_summary(daily(s, d)),
    ob.daily("""SELECT count(*) AS row_count, count(*) FILTER (confidence_level = 'high') AS confidence_high, count(*) FILTER (confidence_level = 'medium') AS confidence_medium,
      count(*) FILTER (confidence_level = 'low') AS confidence_low, count(*) FILTER (confidence_level = 'untrusted') AS confidence_untrusted,
      min(confidence_score) AS min_confidence_score, CAST(sum(len(reasons)) AS BIGINT) AS confidence_reason_count FROM snap"""),
)

# --- screens --------------------------------------------------------------------------------------

_VIEW = f"""{META}
, v AS (SELECT *, adjusted_total - raw_total AS score_confidence_penalty, adjusted_total AS score_total,
    CASE WHEN NOT has_meta THEN 'missing' WHEN len(unknown_fields) = 0 THEN 'complete' ELSE 'partial' END AS metadata_state,
    coalesce(cohort_tags, ['unknown_metadata']) AS cohort_tag FROM listed)"""


def view(s, d):
    return screen.screen_view(listed(s, d))


register(
    "X1_screen_view",
    lambda s, d: view(s, d).select(
        "symbol", "display_symbol", "confidence_state", "metadata_state", "confidence_score", "listing_age_ms", "deployer",
        F.array_join("cohort_tag", ",").alias("cohort_tag"), F.round(F.expr("score_component.momentum"), 6).alias("momentum"),
        *rounded("price", "spread_bps", "seeded_usdc", "score_total", "score_confidence_penalty", digits=4),
    ),
    ob.single(f"""{_VIEW} SELECT symbol, display AS display_symbol, confidence_level AS confidence_state, metadata_state,
      CAST(confidence_score AS DOUBLE) AS confidence_score, CAST(listing_age_ms AS DOUBLE) AS listing_age_ms, deployer,
      array_to_string(cohort_tag, ',') AS cohort_tag, round(comps[2].c, 6) AS momentum, {', '.join(f'round({c}, 4) + 0 AS {c}' for c in ('price', 'spread_bps', 'seeded_usdc', 'score_total', 'score_confidence_penalty'))} FROM v"""),
)

_RULES = {
    "X2_screen_filter": (
        '(spread_bps < 30 or abs(tob_imbalance) >= 0.4) and tradeability_state != "unknown" and score_component.signed_flow > -5',
        "(spread_bps < 30 OR abs(tob_imbalance) >= 0.4) AND tradeability_state <> 'unknown' AND comps[4].c > -5",
    ),
    "X3_tag_equality": (
        'cohort_tag == "fresh_liquidity" and cohort_tag != "low_float"',
        "list_contains(cohort_tag, 'fresh_liquidity') AND NOT list_contains(cohort_tag, 'low_float')",
    ),
}
for _name, (_rule, _where) in _RULES.items():
    register(
        _name,
        lambda s, d, rule=_rule: screen.screen_filter(view(s, d), rule).select("symbol", *rounded("spread_bps")),
        ob.single(f"{_VIEW} SELECT symbol, {r6('spread_bps')} AS spread_bps FROM v WHERE {_where}"),
    )

_ORDERS = {
    "liquid_momentum": ("momentum_score", "liquidity_score > 70 AND volume_z_1h > 2 AND ret_5m > 0 AND spread_bps < 30"),
    "volume_anomaly": ("volume_z_1h", "volume_z_1h > 3 AND trade_count_z_1h > 2"),
    "tight_spread_movers": ("abs(ret_5m)", "spread_bps < 20 AND abs(ret_5m) > 0.01"),
    "mean_reversion_watch": ("mean_reversion_score", "mean_reversion_score > 70 AND liquidity_score > 60"),
    "thin_books": ("-tob_depth_usd", "day_ntl_vlm > 100000 AND tob_depth_usd < 5000"),
    "liquidity_resilience": ("tob_depth_usd", "tradeability_state = 'tradeable' AND resilience_state = 'normal'"),
    "brittle_tradeability": ("spread_bps", "tradeability_state = 'thin' OR resilience_state = 'brittle' OR adverse_selection_proxy = 'brittle'"),
    "flow_pressure": ("abs(signed_notional_flow_30s)", "abs(signed_notional_flow_30s) > 1000"),
    "new_listings": ("-listing_age_ms", "list_contains(cohort_tag, 'new_listing')"),
    "fresh_liquidity": ("seeded_usdc", "list_contains(cohort_tag, 'fresh_liquidity')"),
    "metadata_unknown": ("fetched", "list_contains(cohort_tag, 'unknown_metadata')"),
}


def ranked(rows, sort):
    """Position in the screen's order as a column, so that the order is part of what is compared."""
    from pyspark.sql.window import Window

    key, descending = screen.sort_key(sort)
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    place = F.row_number().over(Window.partitionBy("now_ms").orderBy(order, "symbol"))
    return rows.withColumn("place", place)


def _rank_sql(key: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {key} DESC NULLS LAST, symbol) AS INTEGER) AS place"


_OUT = ["symbol", "place"]
register(
    "X4_screen_sort",
    lambda s, d: ranked(screen.screen_sort(view(s, d), "abs(bbo_ofi_proxy_30s):desc"), "abs(bbo_ofi_proxy_30s):desc").select(*_OUT),
    ob.single(f"{_VIEW} SELECT symbol, {_rank_sql('abs(bbo_ofi_proxy_30s)')} FROM v"),
)
register(
    "X5_screen_preset_with_custom_sort",
    lambda s, d: ranked(
        screen.screen(view(s, d), screen.ScreenRequest("flow_pressure", sort="spread_bps:desc")), "spread_bps:desc"
    ).select(*_OUT),
    ob.single(f"{_VIEW} SELECT symbol, {_rank_sql('spread_bps')} FROM v WHERE {_ORDERS['flow_pressure'][1]}"),
)
for _preset, (_key, _where) in _ORDERS.items():
    register(
        f"X6_{_preset}",
        lambda s, d, p=_preset: ranked(screen.screen(view(s, d), screen.ScreenRequest(p)), screen.PRESETS[p][1]).select(
            *_OUT, *rounded("spread_bps", "momentum_score")
        ),
        ob.single(f"{_VIEW} SELECT symbol, {_rank_sql(_key)}, {r6('spread_bps')} AS spread_bps, {r6('momentum_score')} AS momentum_score FROM v WHERE {_where}"),
    )
register(
    "X7_screen_limit",
    lambda s, d: screen.screen(view(s, d), screen.ScreenRequest(sort="tob_depth_usd:desc"), limit=5).select(
        "symbol", *rounded("tob_depth_usd", digits=3)
    ),
    ob.single(f"{_VIEW} SELECT symbol, round(tob_depth_usd, 3) + 0 AS tob_depth_usd FROM v ORDER BY v.tob_depth_usd DESC NULLS LAST, symbol LIMIT 5"),
)
register(
    "X8_lookup_symbol",
    lambda s, d: screen.lookup_symbol(view(s, d), " s06-usd ").unionByName(screen.lookup_symbol(view(s, d), "s11")).select(
        "symbol", "display_symbol"
    ),
    ob.single(f"{_VIEW} SELECT symbol, display AS display_symbol FROM v WHERE lower(display) = 's06/usd' OR lower(symbol) = 's11'"),
)
register(
    "X8_symbol_candidates",
    lambda s, d: screen.symbol_candidates(view(s, d), "S1", 6).select("symbol", "display_symbol"),
    ob.single(f"{_VIEW} SELECT symbol, display AS display_symbol FROM v WHERE contains(lower(display), 's1') OR contains(lower(symbol), 's1') ORDER BY symbol LIMIT 6"),
)
_BATCH = {p: screen.ScreenRequest(p) for p in _ORDERS}
register(
    "X9_screen_batch",
    lambda s, d: screen.screen_batch(view(s, d), _BATCH).select("request", "symbol", "rank"),
    ob.single(
        f"{_VIEW} "
        + " UNION ALL ".join(
            f"SELECT '{p}' AS request, symbol, CAST(row_number() OVER (ORDER BY {k} DESC NULLS LAST, symbol) AS INTEGER) AS rank FROM v WHERE {w}"
            for p, (k, w) in _ORDERS.items()
        )
    ),
)
