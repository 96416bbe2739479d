"""Confidence, tradeability, fee-aware tradeability and explainable scores."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.errors import ContractError
from tapewright.functions.common import choose, clamp, finite_or_null, half_sign, or_zero, tags

METADATA_TYPE = (
    "struct<symbol:string,display_name:string,feed_identifier:string,spot_index:int,base_token_index:int,"
    "quote_token_index:int,metadata_source:string,metadata_fetched_at_ms:bigint,listing_age_ms:bigint,"
    "deployer:string,deploy_time_ms:bigint,seeded_usdc:double,max_supply:double,circulating_supply:double,"
    "cohort_tags:array<string>,unknown_fields:array<string>>"
)
FEE_TYPE = (
    "struct<profile_name:string,state:string,expected_round_trip_cost_bps:double,maker_fee_bps:double,"
    "taker_fee_bps:double,taker_fill_ratio:double,slippage_buffer_bps:double,"
    "max_tradeable_round_trip_bps:double,reason:string>"
)

# Penalty per confidence reason, in evaluation order, and the level floors.
CONFIDENCE_PENALTY = {
    "reconnect_gap": 35,
    "stale_quote": 25,
    "sparse_trades": 20,
    "incomplete_window": 20,
    "duplicate_events": 10,
    "parser_drops": 30,
    "writer_backlog": 20,
}
CONFIDENCE_LEVELS = [("high", 90), ("medium", 70), ("low", 30)]
SPARSE_WINDOWS = ["returns", "realized_volatility", "microstructure_windows"]


def confidence(
    *, has_gap: Column, stale: Column, sparse: Column, duplicates: Column, parser_drops: Column, writer_backlog: Column
) -> Column:
    """Struct (score, level, reasons, incomplete_windows); every reason counts once, floor 0."""
    facts = {
        "reconnect_gap": has_gap,
        "stale_quote": stale,
        "sparse_trades": sparse,
        "incomplete_window": sparse,
        "duplicate_events": duplicates,
        "parser_drops": parser_drops,
        "writer_backlog": writer_backlog,
    }
    penalty = sum((F.when(fact, CONFIDENCE_PENALTY[name]).otherwise(0) for name, fact in facts.items()), F.lit(0))
    score = F.greatest(F.lit(100) - penalty, F.lit(0)).cast("int")
    level = choose([(score >= floor, name) for name, floor in CONFIDENCE_LEVELS], "untrusted")
    return F.struct(
        score.alias("score"),
        level.alias("level"),
        tags([(fact, name) for name, fact in facts.items()]).alias("reasons"),
        tags([(sparse, window) for window in SPARSE_WINDOWS]).alias("incomplete_windows"),
    )


def confidence_summary(snapshots: DataFrame) -> DataFrame:
    """Counts by level, lowest score and number of reasons over all rows."""
    level = F.col("confidence.level")
    return snapshots.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(level == name).alias(f"confidence_{name}") for name in ("high", "medium", "low", "untrusted")],
        F.min("confidence.score").alias("min_confidence_score"),
        F.sum(F.size("confidence.reasons")).alias("confidence_reason_count"),
    )


# Fixed values of the tradeability rule.
TRADEABLE_MAX_SPREAD_BPS = 25.0
COSTLY_SPREAD_BPS = 50.0
MIN_TRADEABLE_DEPTH_USD = 5_000.0
THIN_DEPTH_USD = 1_000.0


def tradeability_state() -> Column:
    spread, depth = finite_or_null("spread_bps"), finite_or_null("tob_depth_usd")
    level, resilience = F.col("confidence.level"), F.col("resilience_state")
    return choose(
        [
            (spread.isNull() | depth.isNull() | (resilience == "unknown"), "unknown"),
            ((F.col("staleness_state") != "fresh") | (level == "untrusted"), "stale"),
            (depth < THIN_DEPTH_USD, "thin"),
            ((spread >= COSTLY_SPREAD_BPS) | (resilience != "normal"), "costly"),
            (
                (spread <= TRADEABLE_MAX_SPREAD_BPS)
                & (depth >= MIN_TRADEABLE_DEPTH_USD)
                & level.isin("high", "medium"),
                "tradeable",
            ),
        ],
        "costly",
    )


@dataclass(frozen=True)
class FeeProfile:
    """Fees in integer hundredths of a basis point; the fill ratio in hundredths of a percent."""

    name: str
    maker_fee_hundredths_bps: int
    taker_fee_hundredths_bps: int
    slippage_buffer_hundredths_bps: int
    max_tradeable_round_trip_hundredths_bps: int
    max_costly_round_trip_hundredths_bps: int
    taker_fill_ratio_hundredths: int = 10_000

    def check(self) -> "FeeProfile":
        if not re.fullmatch(r"[a-z0-9_-]+", self.name or ""):
            raise ContractError("fee profile name must contain lowercase ascii letters, digits, '-' or '_'")
        rates = (
            self.maker_fee_hundredths_bps,
            self.taker_fee_hundredths_bps,
            self.slippage_buffer_hundredths_bps,
            self.max_tradeable_round_trip_hundredths_bps,
            self.max_costly_round_trip_hundredths_bps,
        )
        if any(not 0 <= rate <= 1_000_000 for rate in rates):
            raise ContractError("fee profile rates must be between 0 and 10000 basis points")
        if not 0 <= self.taker_fill_ratio_hundredths <= 10_000:
            raise ContractError("taker fill ratio must be between 0 and 10000 hundredths")
        if self.max_tradeable_round_trip_hundredths_bps > self.max_costly_round_trip_hundredths_bps:
            raise ContractError("fee profile thresholds must be ordered tradeable <= costly")
        return self

    @property
    def taker_fill_ratio(self) -> float:
        return self.taker_fill_ratio_hundredths / 10_000

    @property
    def round_trip_cost_bps(self) -> float:
        """Two blended fees plus the slippage buffer."""
        taker, maker = self.taker_fee_hundredths_bps / 100, self.maker_fee_hundredths_bps / 100
        ratio = self.taker_fill_ratio
        return 2.0 * (taker * ratio + maker * (1.0 - ratio)) + self.slippage_buffer_hundredths_bps / 100


def fee_aware_tradeability(profile: FeeProfile | None) -> Column:
    """Struct comparing spread plus round-trip cost with the profile's threshold; null without spread."""
    if profile is None:
        return F.lit(None).cast(FEE_TYPE)
    profile.check()
    spread, base = finite_or_null("spread_bps"), F.col("tradeability_state")
    cost = spread + F.lit(profile.round_trip_cost_bps)
    limit = profile.max_tradeable_round_trip_hundredths_bps / 100
    state = F.when(base != "tradeable", base).when(cost <= limit, "tradeable").otherwise("costly")
    reason = (
        F.when(base != "tradeable", F.concat(F.lit("base_tradeability_"), base))
        .when(cost <= limit, "within_tradeable_fee_threshold")
        .otherwise("fee_cost_exceeds_tradeable_threshold")
    )
    return F.when(
        spread.isNotNull(),
        F.struct(
            F.lit(profile.name).alias("profile_name"),
            state.alias("state"),
            cost.alias("expected_round_trip_cost_bps"),
            F.lit(profile.maker_fee_hundredths_bps / 100).alias("maker_fee_bps"),
            F.lit(profile.taker_fee_hundredths_bps / 100).alias("taker_fee_bps"),
            F.lit(profile.taker_fill_ratio).alias("taker_fill_ratio"),
            F.lit(profile.slippage_buffer_hundredths_bps / 100).alias("slippage_buffer_bps"),
            F.lit(limit).alias("max_tradeable_round_trip_bps"),
            reason.alias("reason"),
        ),
    )


def apply_fee_profile(snapshots: DataFrame, profile: FeeProfile) -> DataFrame:
    return snapshots.withColumn("fee_aware_tradeability", fee_aware_tradeability(profile))


def apply_fee_profiles(snapshots: DataFrame, profiles: list[FeeProfile]) -> DataFrame:
    """One row per snapshot and profile: the profiles are a literal array, exploded on the row."""
    options = F.array(*[fee_aware_tradeability(profile) for profile in profiles])
    return snapshots.withColumn("fee_aware_tradeability", F.explode(options))


# --- scores -------------------------------------------------------------------------------------

# Component name, kind, weight and evidence window, in order.
COMPONENTS = [
    ("liquidity_resilience", "resilience", 0.40, "top_of_book"),
    ("momentum", "momentum", 0.25, "returns_1m_5m_1h"),
    ("mean_reversion_context", "mean_reversion", 0.10, "returns_1m_5m_1h"),
    ("signed_flow", "signed_flow", 0.10, "trades_30s"),
    ("spread_cost", "spread_cost", 1.00, "bbo_latest"),
]
SPREAD_PENALTY_FULL_AT_BPS = 150.0
SPREAD_PENALTY_MAX = 15.0
FLOW_FULL_AT = 10_000.0


def best_return() -> Column:
    return F.coalesce("ret_5m", "ret_1m", "ret_1h")


def _component(name: str, kind: str, weight: float, window: str, raw: Column, normalized: Column) -> Column:
    raw, normalized = or_zero(finite_or_null(raw)), or_zero(finite_or_null(normalized))
    contribution = normalized * F.lit(weight)
    direction = choose([(contribution > 0, "positive"), (contribution < 0, "negative")], "neutral")
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(kind).alias("kind"),
        contribution.alias("value"),
        raw.alias("raw_value"),
        normalized.alias("normalized_value"),
        F.lit(weight).alias("weight"),
        contribution.alias("signed_contribution"),
        direction.alias("direction"),
        F.lit(window).alias("evidence_window"),
    )


def with_scores(rows: DataFrame) -> DataFrame:
    """Liquidity, momentum and mean-reversion scores (0..100) and the score breakdown."""
    ret, depth = or_zero(best_return()), or_zero("tob_depth_usd")
    rows = rows.withColumns(
        {
            "liquidity_score": clamp(depth / 100.0, 0.0, 100.0),
            "momentum_score": clamp(F.lit(50.0) + ret * 100.0, 0.0, 100.0),
            "mean_reversion_score": clamp(F.lit(50.0) - ret * 100.0, 0.0, 100.0),
        }
    )
    flow, spread = F.col("signed_notional_flow_30s"), F.col("spread_bps")
    penalty = or_zero(-clamp(spread / SPREAD_PENALTY_FULL_AT_BPS, 0.0, 1.0) * SPREAD_PENALTY_MAX)
    flow_score = or_zero(clamp(F.abs(flow) / FLOW_FULL_AT * 100.0, 0.0, 100.0) * half_sign(flow))
    inputs = [
        (depth, F.col("liquidity_score")),
        (ret * 100.0, F.col("momentum_score")),
        (ret * 100.0, F.col("mean_reversion_score")),
        (or_zero(flow), flow_score),
        (or_zero(spread), penalty),
    ]
    components = F.array(*[_component(*spec, raw, norm) for spec, (raw, norm) in zip(COMPONENTS, inputs)])
    rows = rows.withColumn("_components", components)
    total = F.aggregate("_components", F.lit(0.0), lambda acc, c: acc + c["signed_contribution"])
    raw_total = or_zero(clamp(finite_or_null(total), 0.0, 100.0))
    adjusted = clamp(F.col("_raw") * (F.col("confidence.score") / 100.0), 0.0, 100.0)
    missing = tags(
        [
            (best_return().isNull(), "return_window"),
            (F.col("rv_1m").isNull(), "realized_volatility_1m"),
            (flow.isNull(), "signed_flow_30s"),
            (spread.isNull(), "spread_cost"),
            (F.col("tob_depth_usd").isNull(), "top_of_book_depth"),
        ]
    )
    rows = rows.withColumn("_raw", raw_total).withColumn("_adjusted", adjusted)
    return rows.withColumn(
        "score_breakdown",
        F.struct(
            F.lit("score_breakdown.v1").alias("version"),
            F.col("symbol"),
            F.col("_raw").alias("raw_total"),
            F.col("_adjusted").alias("adjusted_total"),
            F.col("confidence.score").alias("confidence_score"),
            F.col("_components").alias("components"),
            F.array_sort(F.array_distinct(missing)).alias("unavailable_evidence"),
        ),
    ).drop("_components", "_raw", "_adjusted")


def explain(snapshots: DataFrame, symbol: str | None = None) -> DataFrame:
    """Tall table of score components with the totals and the confidence penalty."""
    if symbol is not None:
        snapshots = snapshots.filter(F.col("symbol") == symbol)
    b = "score_breakdown"
    return snapshots.select(
        "symbol",
        "now_ms",
        F.col(f"{b}.raw_total").alias("raw_total"),
        F.col(f"{b}.adjusted_total").alias("adjusted_total"),
        (F.col(f"{b}.adjusted_total") - F.col(f"{b}.raw_total")).alias("confidence_penalty"),
        F.posexplode(f"{b}.components").alias("position", "c"),
    ).select("symbol", "now_ms", "raw_total", "adjusted_total", "confidence_penalty", "position", "c.*")


# Short names of the components.
SHORT_NAME = {
    "liquidity_resilience": "liq",
    "momentum": "mom",
    "mean_reversion_context": "mean",
    "signed_flow": "flow",
    "spread_cost": "spread",
}


def dominant_component() -> Column:
    """Component with the largest absolute contribution, smaller name on ties."""
    return F.array_sort(
        F.col("score_breakdown.components"),
        lambda a, b: F.when(F.abs(a["signed_contribution"]) > F.abs(b["signed_contribution"]), -1)
        .when(F.abs(a["signed_contribution"]) < F.abs(b["signed_contribution"]), 1)
        .when(a["name"] < b["name"], -1)
        .when(a["name"] > b["name"], 1)
        .otherwise(0),
    )[0]


def top_driver(snapshots: DataFrame) -> DataFrame:
    """Dominant driver label, compact reason and the list of contributing components."""
    top = F.col("_top")
    mark = F.when(top["signed_contribution"] < 0, "-").otherwise("+")
    short = choose([(top["name"] == name, label) for name, label in SHORT_NAME.items()], "factor")
    unusable = (F.col("confidence.score") < 50) | (F.col("staleness_state") != "fresh")
    strong = F.filter("score_breakdown.components", lambda c: F.abs(c["signed_contribution"]) > 0.5)
    tokens = F.slice(
        F.transform(strong, lambda c: F.concat(F.when(c["signed_contribution"] > 0, "+").otherwise("-"), c["name"])), 1, 4
    )
    missing = F.col("score_breakdown.unavailable_evidence")
    tokens = F.when(
        F.size(tokens) == 0,
        F.array(F.concat(F.lit("score "), F.format_string("%.1f", F.col("score_breakdown.adjusted_total")))),
    ).otherwise(tokens)
    tokens = F.concat(
        tokens,
        F.when(F.size(missing) > 0, F.array(F.concat(F.lit("missing:"), F.array_join(missing, ",")))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return snapshots.withColumn("_top", dominant_component()).select(
        "symbol",
        "now_ms",
        F.concat(F.upper(short), mark).alias("score_bias"),
        F.when(unusable, "data").otherwise(F.concat(short, mark)).alias("why_ranked"),
        F.array_join(tokens, " ").alias("tokens"),
    )
