"""Row labels and composite signals computed from snapshot columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.functions.common import choose, clamp, finite_or_null, or_zero, tags


def display_symbol() -> Column:
    name = F.col("metadata.display_name")
    return F.when(F.trim(name) != "", name).otherwise(F.col("symbol"))


def not_fresh() -> Column:
    return F.col("staleness_state") != "fresh"


def degraded() -> Column:
    return (F.col("confidence.score") < 70) | not_fresh()


def liquidity_cost_class() -> Column:
    spread, depth, score = F.col("spread_bps"), F.col("tob_depth_usd"), F.col("liquidity_score")
    return choose(
        [
            (spread.isNull() | depth.isNull(), "unknown"),
            ((score >= 70) & (spread <= 20) & (depth >= 10_000), "low"),
            ((score >= 20) & (spread <= 75) & (depth >= 1_000), "med"),
        ],
        "high",
    )


def _spread_steps(middle: str) -> Column:
    spread = finite_or_null("spread_bps")
    return choose([(spread.isNull(), "unknown"), (spread <= 5, "tight"), (spread <= 25, middle)], "wide")


def spread_gate() -> Column:
    return _spread_steps("workable")


def spread_cost() -> Column:
    return _spread_steps("normal")


def pair_risk() -> Column:
    return choose(
        [
            ((F.col("confidence.score") < 60) | (F.col("staleness_state") == "stale"), "elevated"),
            (F.col("staleness_state") == "incomplete", "partial"),
            (finite_or_null("spread_bps") > 25, "costly"),
        ],
        "normal",
    )


def quality_badge() -> Column:
    return choose([(degraded(), "!"), (F.col("tradeability_state") == "tradeable", "T")], "Q")


def regime_label() -> Column:
    trend = or_zero("ret_1m") * 100.0
    return choose(
        [
            (trend >= 0.10, "MOMENTUM"),
            (trend <= -0.10, "DOWNTREND"),
            (F.col("mean_reversion_score") > F.col("momentum_score"), "MEAN REVERSION"),
        ],
        "BALANCED",
    )


def has_tag(tag: str) -> Column:
    return F.coalesce(F.array_contains("metadata.cohort_tags", tag), F.lit(False))


def observation_tags() -> Column:
    """Everything noteworthy about a row, in display order."""
    state, level = F.col("staleness_state"), F.col("confidence.level")
    trade, book, flow = F.col("tradeability_state"), F.col("resilience_state"), F.col("adverse_selection_proxy")
    spread = F.col("spread_bps")
    # The tag texts, their limits and their order.
    return tags(
        [
            (state == "stale", "stale feed"),
            (state == "incomplete", "partial data"),
            (level == "low", "low confidence"),
            (level == "untrusted", "untrusted data"),
            (trade == "thin", "thin tradeability"),
            (trade == "costly", "costly tradeability"),
            (trade == "stale", "stale tradeability"),
            (book == "shock", "spread shock"),
            (book == "recovering", "recovering book"),
            (book == "brittle", "brittle book"),
            (flow == "watch", "flow watch"),
            (flow == "brittle", "adverse proxy"),
            (F.col("tob_depth_usd") < 1_000, "thin book"),
            (spread >= 50, "wide spread"),
            (spread <= 10, "tight spread"),
            (F.abs("ret_1m") >= 0.005, "move active"),
            (F.abs("tob_imbalance") >= 0.4, "imbalanced"),
            (has_tag("new_listing"), "new listing"),
            (has_tag("fresh_liquidity"), "fresh liquidity"),
            (has_tag("unknown_metadata"), "metadata partial"),
        ]
    )


# Short forms used in the two-tag summary.
SHORT_OBSERVATION = {
    "thin book": "thin",
    "wide spread": "wide",
    "tight spread": "tight",
    "move active": "move",
    "imbalanced": "imbalance",
    "spread shock": "shock",
    "recovering book": "recovering",
    "brittle book": "brittle",
    "fresh liquidity": "fresh liq",
    "new listing": "new",
}


def why_now(observed: Column) -> Column:
    """First two observations, shortened; ``steady`` without any."""
    short = F.create_map(*[F.lit(x) for pair in SHORT_OBSERVATION.items() for x in pair])
    words = F.transform(F.slice(observed, 1, 2), lambda t: F.coalesce(F.try_element_at(short, t), t))
    return F.when(F.size(observed) == 0, "steady").otherwise(F.array_join(words, " + "))


def depth_scale() -> Column:
    """log10 of depth over six decades, 0..1."""
    depth = finite_or_null("tob_depth_usd")
    positive = F.when(depth > 0, depth)
    return or_zero(clamp(F.log10(positive) / 6.0, 0.0, 1.0))


def spread_quality(full_at_bps: float) -> Column:
    return or_zero(1.0 - clamp(finite_or_null("spread_bps") / full_at_bps, 0.0, 1.0))


def liquidity_heat(full_at_bps: float = 20.0) -> Column:
    return spread_quality(full_at_bps) * 0.55 + depth_scale() * 0.45


def flow_pressure() -> Column:
    depth = F.greatest(F.abs(or_zero("tob_depth_usd")), F.lit(1.0))
    return clamp(or_zero("signed_notional_flow_30s") / depth, -1.0, 1.0)


def alpha_signal() -> Column:
    momentum = or_zero(clamp(finite_or_null("ret_1m") * 100.0, -1.0, 1.0))
    return clamp(flow_pressure() * 0.65 + momentum * 0.35, -1.0, 1.0)


def signal_value() -> Column:
    fallback = F.col("liquidity_score") + F.col("momentum_score")
    return clamp(F.coalesce(F.col("score_breakdown.adjusted_total"), fallback), 0.0, 99.0)


def strategy_signal(trend_pct: Column) -> Column:
    trend = clamp(or_zero(trend_pct) / 5.0, -1.0, 1.0)
    score = clamp(signal_value() / 100.0 * 2.0 - 1.0, -1.0, 1.0)
    return clamp(trend * 0.35 + flow_pressure() * 0.45 + score * 0.20, -1.0, 1.0)


def strategy_bias(signal: Column) -> Column:
    return choose(
        [
            (F.col("confidence.score") < 70, "confidence-watch"),
            (spread_gate() != "tight", "liquidity-watch"),
            (signal > 0.25, "momentum-watch"),
            (signal < -0.25, "pressure-watch"),
        ],
        "balanced-watch",
    )


def direction() -> Column:
    """Sign of the 1m return, else of the flow, else 0."""
    ret, flow = or_zero("ret_1m"), or_zero("signed_notional_flow_30s")
    return choose([(ret > 0, 1), (ret < 0, -1), (flow > 0, 1), (flow < 0, -1)], 0)


def flow_sign() -> Column:
    flow = or_zero("signed_notional_flow_30s")
    return choose([(flow > 0, "+"), (flow < 0, "-")], "=")
