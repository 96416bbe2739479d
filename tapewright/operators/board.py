"""Market-board aggregates over a set of snapshot rows.

Each board is one aggregation (partial per task, then one row), a top-k, or a per-row projection.
Percentile picks use rank counting instead of sorting all rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.functions import labels
from tapewright.functions.common import choose, clamp, finite_or_null, or_zero
from tapewright.operators.ordered import value_at_rank

FLOW = "signed_notional_flow_30s"


def _finite_sum(c: str) -> Column:
    return or_zero(F.sum(finite_or_null(c)))


def _average_score() -> Column:
    """Whole-number mean confidence, 0 for no rows."""
    n = F.count(F.lit(1))
    mean = F.floor(F.sum(F.col("confidence.score").cast("long")) / F.when(n > 0, n))
    return F.coalesce(F.least(mean, F.lit(100)), F.lit(0)).cast("long")


def _up() -> Column:
    return F.count_if(F.coalesce(F.col("ret_1m") > 0, F.lit(False)))


def _down() -> Column:
    return F.count_if(F.coalesce(F.col("ret_1m") < 0, F.lit(False)))


def table_stats(rows: DataFrame) -> DataFrame:
    """Row quality summary; the age percentile is the value at index ceil((n - 1) * 0.95)."""
    level, state = F.col("confidence.level"), F.col("staleness_state")
    spread, depth = finite_or_null("spread_bps"), finite_or_null("tob_depth_usd")
    ages = value_at_rank(rows, [], "updated_ms_ago", {"p95_age_ms": lambda n: F.ceil((n - 1) * 95 / F.lit(100)) + 1})
    halves = {"_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.floor(n / 2) + 1}
    middle = value_at_rank(rows.select(spread.alias("_spread")), [], "_spread", halves)
    stats = rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(state == "stale").alias("stale"),
        F.count_if(state == "incomplete").alias("incomplete"),
        F.count(spread).alias("spread_count"),
        F.count(depth).alias("depth_count"),
        F.max(depth).alias("top_tob_depth_usd"),
        *[F.count_if(level == name).alias(f"confidence_{name}") for name in ("high", "medium", "low", "untrusted")],
        F.min("confidence.score").alias("min_confidence_score"),
        F.coalesce(F.sum(F.size("confidence.reasons")), F.lit(0)).cast("long").alias("confidence_reason_count"),
    )
    stats = stats.join(ages.select(F.col("p95_age_ms").cast("bigint").alias("p95_age_ms")), how="cross")  # one row each
    stats = stats.join(middle.select(((F.col("_low") + F.col("_high")) / 2).alias("median_spread_bps")), how="cross")
    s, d = F.col("median_spread_bps"), F.col("top_tob_depth_usd")
    whole = (F.col("spread_count") == F.col("row_count")) & (F.col("depth_count") == F.col("row_count"))
    return stats.withColumn(
        "quality_status",
        choose(
            [
                (F.col("incomplete") > 0, "CHECK"),
                ((F.col("row_count") == 0) | s.isNull() | d.isNull() | ~whole, "PARTIAL"),
                ((s >= 100) | (d < 1_000), "CHECK"),
                ((s >= 50) | (d < 5_000) | (F.col("stale") > 0), "WATCH"),
            ],
            "GOOD",
        ),
    )


def market_internals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        _up().alias("up"),
        _down().alias("down"),
        F.count_if(F.col("tradeability_state") == "tradeable").alias("tradeable"),
        F.count_if(labels.not_fresh()).alias("stale"),
        _finite_sum(FLOW).alias("signed_flow"),
        _finite_sum("tob_depth_usd").alias("depth"),
    )


def regime(up: Column, down: Column) -> Column:
    share = up / F.when(up + down > 0, up + down)
    return choose([(share.isNull(), "idle"), (share >= 0.65, "risk-on"), (share <= 0.35, "risk-off")], "mixed")


def market_regime(rows: DataFrame) -> DataFrame:
    stats = rows.agg(
        _up().alias("up"),
        _down().alias("down"),
        _finite_sum(FLOW).alias("net_flow"),
        _finite_sum("tob_depth_usd").alias("depth"),
        _average_score().alias("avg_confidence"),
    )
    return stats.withColumn("regime", regime(F.col("up"), F.col("down")))


def _leader(value: Column, size: Column, name: str) -> list[Column]:
    """Row with the largest ``size`` (later symbol on ties) as two columns."""
    best = F.max_by(F.struct("symbol", value.alias("value")), F.when(size.isNotNull(), F.struct(size, F.col("symbol"))))
    return [best["symbol"].alias(f"{name}_symbol"), best["value"].alias(f"{name}_value")]


def leaders(rows: DataFrame) -> DataFrame:
    """Top mover, flow and depth leader, and the strongest rise and fall (a zero return counts as fall)."""
    ret, flow, depth = finite_or_null("ret_1m"), finite_or_null(FLOW), finite_or_null("tob_depth_usd")
    rise, fall = F.when(ret > 0, ret), F.when(~(ret > 0), ret)
    return rows.agg(
        *_leader(ret, F.abs(ret), "mover"),
        *_leader(flow, F.abs(flow), "flow"),
        *_leader(depth, depth, "depth"),
        *_leader(rise, F.abs(rise), "rise"),
        *_leader(fall, F.abs(fall), "fall"),
    )


def flow_leaders(rows: DataFrame, k: int) -> DataFrame:
    """Largest absolute flow first, display name on ties."""
    return (
        rows.select("symbol", labels.display_symbol().alias("display_symbol"), FLOW)
        .orderBy(F.abs(or_zero(FLOW)).desc(), "display_symbol")
        .limit(k)
    )


def flow_totals(rows: DataFrame) -> DataFrame:
    flow = finite_or_null(FLOW)
    return rows.agg(
        or_zero(F.sum(flow)).alias("net_flow"),
        or_zero(F.sum(F.abs(flow))).alias("gross_flow"),
        or_zero(F.max(F.abs(flow))).alias("max_abs_flow"),
    )


def flow_spectrum(rows: DataFrame) -> DataFrame:
    flow = finite_or_null(FLOW)
    sums = rows.agg(
        or_zero(F.sum(F.when(flow > 0, flow))).alias("buy_flow"),
        or_zero(F.sum(F.when(flow < 0, -flow))).alias("sell_flow"),
    )
    total = F.col("buy_flow") + F.col("sell_flow")
    share = lambda c: or_zero(F.col(c) / F.when(total > 0, total))
    return sums.withColumns({"buy_share": share("buy_flow"), "sell_share": share("sell_flow")})


def cohort_counts(rows: DataFrame) -> DataFrame:
    """Rows per cohort and the largest seed; a row without metadata is unknown."""
    missing = F.col("metadata").isNull()
    unknown = missing | labels.has_tag("unknown_metadata") | (F.size("metadata.unknown_fields") > 0)
    seeded = finite_or_null("metadata.seeded_usdc")
    seeded = F.when(seeded > 0, seeded)
    return rows.agg(
        F.count_if(labels.has_tag("new_listing")).alias("new_listings"),
        F.count_if(labels.has_tag("fresh_liquidity")).alias("fresh_liquidity"),
        F.count_if(labels.has_tag("low_float")).alias("low_float"),
        F.count_if(unknown).alias("unknown"),
        *_leader(seeded, seeded, "seed"),
    )


def risk_stack(rows: DataFrame) -> DataFrame:
    depth = finite_or_null("tob_depth_usd")
    depth = F.when(depth > 0, depth)
    flow = finite_or_null(FLOW)
    stats = rows.agg(
        _up().alias("up"),
        _down().alias("down"),
        or_zero(F.sum(flow)).alias("net_flow"),
        or_zero(F.sum(F.abs(flow))).alias("gross_flow"),
        or_zero(F.sum(depth)).alias("total_depth"),
        *_leader(depth, depth, "top"),
        F.count_if(labels.degraded()).alias("degraded"),
        F.count_if(labels.not_fresh()).alias("stale"),
        F.count_if(F.coalesce(finite_or_null("spread_bps") > 25, F.lit(False))).alias("wide_spread"),
    )
    skew = clamp(F.col("net_flow") / F.when(F.col("gross_flow") > 0, F.col("gross_flow")), -1.0, 1.0)
    share = F.col("top_value") / F.when(F.col("total_depth") > 0, F.col("total_depth"))
    clean = (F.col("degraded") == 0) & (F.col("stale") == 0) & (F.col("wide_spread") == 0)
    return stats.withColumns(
        {
            "flow_skew": or_zero(skew),
            "top_share": or_zero(share),
            "gate": choose([(clean, "clean"), ((F.col("degraded") <= 2) & (F.col("stale") <= 1), "review")], "degraded"),
        }
    )


def exposure_buckets(rows: DataFrame) -> DataFrame:
    """Count and depth by sign of the 1m return, depth skew and the lowest-confidence row."""
    ret, depth = finite_or_null("ret_1m"), finite_or_null("tob_depth_usd")
    depth = F.when(depth > 0, depth)
    side = F.when(ret > 0, "long").when(ret < 0, "short").otherwise("neutral")
    tagged = rows.withColumn("_side", side)
    aggs = []
    for name in ("long", "short", "neutral"):
        aggs.append(F.count_if(F.col("_side") == name).alias(f"{name}_count"))
        aggs.append(or_zero(F.sum(F.when(F.col("_side") == name, depth))).alias(f"{name}_depth"))
    drag = F.min_by(F.struct("symbol", "confidence.score"), F.struct("confidence.score", "symbol"))
    stats = tagged.agg(*aggs, drag["symbol"].alias("drag_symbol"), drag["score"].alias("drag_score"))
    total = F.col("long_depth") + F.col("short_depth") + F.col("neutral_depth")
    skew = (F.col("long_depth") - F.col("short_depth")) / F.when(total > 0, total)
    return stats.withColumn("depth_skew", or_zero(clamp(skew, -1.0, 1.0)))


def quality_watch(rows: DataFrame, k: int) -> DataFrame:
    """Rows to look at first: stale, then low confidence, then old, then the lowest score."""
    age = F.col("updated_ms_ago")
    watched = rows.filter(labels.degraded() | F.coalesce(age > 2_000, F.lit(False)))
    return (
        watched.select(
            "symbol",
            labels.display_symbol().alias("display_symbol"),
            "staleness_state",
            F.col("confidence.score").alias("confidence_score"),
            "updated_ms_ago",
        )
        .orderBy(
            (F.col("staleness_state") != "fresh").desc(),
            (F.col("confidence_score") < 70).desc(),
            F.coalesce("updated_ms_ago", F.lit(0)).desc(),
            F.col("confidence_score").asc(),
            "display_symbol",
        )
        .limit(k)
    )


def worst_quality_row(rows: DataFrame) -> DataFrame:
    return quality_watch(rows.filter(labels.degraded()), 1)


def quality_matrix(rows: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    tradeable = F.count_if(F.col("tradeability_state") == "tradeable")
    return rows.agg(
        total.alias("total"),
        tradeable.alias("tradeable"),
        F.count_if(labels.degraded()).alias("degraded"),
        F.count_if(labels.not_fresh()).alias("stale"),
        _average_score().alias("confidence"),
        or_zero(tradeable / F.when(total > 0, total)).alias("tradeable_ratio"),
    )


def row_age_p95(rows: DataFrame) -> DataFrame:
    """Nearest-rank 95th percentile of non-negative ages, with the counts shown next to it."""
    ages = value_at_rank(rows.filter("updated_ms_ago >= 0"), [], "updated_ms_ago", {"p95_age_ms": lambda n: F.ceil(n * 95 / F.lit(100))})
    counts = rows.agg(
        F.count_if(F.col("confidence.score") < 70).alias("low_confidence"),
        F.count_if(labels.not_fresh()).alias("stale"),
    )
    return ages.select(F.col("p95_age_ms").cast("bigint").alias("p95_age_ms")).join(counts, how="cross")  # one row each


def signal_matrix(rows: DataFrame, k: int | None = None) -> DataFrame:
    cells = rows.select(
        "symbol",
        F.substring(F.split_part(labels.display_symbol(), F.lit("/"), F.lit(1)), 1, 5).alias("short_symbol"),
        labels.direction().alias("direction"),
        labels.depth_scale().alias("liquidity"),
        labels.flow_sign().alias("flow_sign"),
        labels.quality_badge().alias("badge"),
    )
    return cells.orderBy("symbol").limit(k) if k is not None else cells


def rank_watchlist(rows: DataFrame, per: list[str] = ()) -> DataFrame:
    """Rank by screen order (score descending, symbol on ties) and the display score."""
    scored = rows.withColumn("score", labels.signal_value())
    order = Window.partitionBy(*per).orderBy(F.col("score").desc(), "symbol")
    keep = [*per, "symbol", "score"]
    return scored.select(*keep, F.row_number().over(order).alias("rank"))
