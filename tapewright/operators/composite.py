"""Capped, liquidity-weighted composite index over one-minute candles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.errors import ContractError
from tapewright.functions.common import choose
from tapewright.operators.ordered import lookup_join, ordered_scan
from tapewright.session import cut_lineage

# Fixed values of the index.
START_VALUE = 100.0
MAX_WEIGHT = 0.10
HEALTHY_COVERAGE = 0.80
PARTIAL_COVERAGE = 0.50
INDEX_INTERVAL = "1m"
DAY_MS = 86_400_000


def capped_sqrt_weights(liquidity: DataFrame) -> DataFrame:
    """Weight proportional to sqrt(liquidity), none above max(10 %, 1/n); the excess is shared out.

    At most 1/cap symbols can be capped, so the cut-off is decided from the ten largest values and
    two totals; every other symbol is scaled by one factor. No global sort of the universe.
    """
    raw = liquidity.filter((F.col("liquidity") > 0) & (F.col("liquidity") < float("inf"))).select(
        "symbol", F.sqrt("liquidity").alias("raw")
    )
    raw = cut_lineage(raw)
    totals = raw.agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("total")).first()
    if not totals["n"]:
        raise ContractError("composite requires positive finite liquidity")
    cap = max(MAX_WEIGHT, 1.0 / totals["n"])
    top = [r["raw"] for r in raw.orderBy(F.col("raw").desc()).limit(int(1 / cap) + 1).collect()]
    capped, rest = 0, totals["total"]
    while capped < len(top) and rest > 0 and (1 - capped * cap) * top[capped] / rest > cap:
        rest -= top[capped]
        capped += 1
    floor = top[capped - 1] if capped else float("inf")
    free = max(1 - capped * cap, 0.0)
    weight = F.when(F.col("raw") >= floor, F.lit(cap)).otherwise(
        F.col("raw") * F.lit(free / rest if rest > 0 and capped < totals["n"] else 0.0)
    )
    whole = capped * cap + (free if rest > 0 and capped < totals["n"] else 0.0)
    return raw.select("symbol", (weight / F.lit(whole)).alias("weight"))


def valid_minute_candles(candles: DataFrame) -> DataFrame:
    inf = float("inf")
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume_base"))
    return candles.filter(
        (F.col("interval") == INDEX_INTERVAL)
        & (F.col("open_ts_ms") >= 0)
        & (F.col("close_ts_ms") >= F.col("open_ts_ms"))
        & (h < inf)
        & (v < inf)
        & (o > 0)
        & (low > 0)
        & (v >= 0)
        & (h >= F.greatest(o, c))
        & (low <= F.least(o, c))
    )


def dedup_minute_candles(candles: DataFrame) -> DataFrame:
    """Latest receive time per (symbol, minute), later arrival on ties."""
    payload = [c for c in candles.columns if c not in ("symbol", "open_ts_ms")]
    return (
        candles.groupBy("symbol", "open_ts_ms")
        .agg(F.max_by(F.struct(*payload), F.struct("recv_ts_ns", "ingest_seq")).alias("_w"))
        .select("symbol", "open_ts_ms", "_w.*")
    )


def coverage_state(coverage):
    return choose([(coverage >= HEALTHY_COVERAGE, "healthy"), (coverage >= PARTIAL_COVERAGE, "partial")], "degraded")


def minute_returns(candles: DataFrame, weights: DataFrame) -> DataFrame:
    """Per minute: coverage, weighted returns against each symbol's previous close, breadth, volume."""
    rows = dedup_minute_candles(valid_minute_candles(candles))
    # One row per symbol and minute, written once instead of being aggregated for every pass below.
    rows = cut_lineage(lookup_join(rows, weights, ["symbol"], "inner"))
    rows = ordered_scan(rows, ["symbol"], "open_ts_ms", "open_ts_ms", previous=["close"])
    base = F.coalesce("prev.close", "open")
    rows = rows.withColumn("_base", base)
    part = lambda c: F.sum(F.col("weight") * (F.col(c) / F.col("_base") - 1)) / F.sum("weight")
    up, down = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    return (
        rows.groupBy("open_ts_ms")
        .agg(
            F.max("close_ts_ms").alias("close_ts_ms"),
            F.sum("weight").alias("coverage"),
            *[part(c).alias(f"r_{c}") for c in ("open", "high", "low", "close")],
            F.sum(F.col("volume_base") * F.col("close")).alias("quote_volume"),
            F.count(F.lit(1)).alias("contributing_symbols"),
            F.count_if(up).alias("advances"),
            F.count_if(down).alias("declines"),
            F.count_if(~up & ~down).alias("unchanged"),
        )
        .filter((F.col("coverage") > 0) & (F.col("coverage") < float("inf")))
    )


def chain(minutes: DataFrame, block_ms: int = DAY_MS) -> DataFrame:
    """Add ``before`` (index level before each minute) by chaining close returns from 100.

    Minutes are multiplied up inside blocks of a day in parallel; only one factor per day is then
    chained over all days.
    """
    rows = minutes.withColumn("_block", F.expr(f"open_ts_ms div {block_ms}"))
    growth = 1 + F.col("r_close")
    inside = Window.partitionBy("_block").orderBy("open_ts_ms").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.product(growth).over(inside), F.lit(1.0)))
    days = rows.groupBy("_block").agg(F.product(growth).alias("_day"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_block", F.coalesce(F.product("_day").over(earlier), F.lit(1.0)).alias("_out"))
    joined = rows.join(days, "_block")
    return joined.withColumn("before", F.lit(START_VALUE) * F.col("_out") * F.col("_in")).drop("_block", "_in", "_out")


def composite_index(
    candles: DataFrame, liquidity: DataFrame, requested_symbols: int, exact_volume: DataFrame | None = None
) -> DataFrame:
    """Composite OHLC per minute. ``exact_volume`` (open_ts_ms, quote_volume) overrides the estimate."""
    if requested_symbols < 1:
        raise ContractError("composite requires at least one requested symbol")
    # One row per minute, written once: the chain reads it twice.
    minutes = cut_lineage(minute_returns(candles, capped_sqrt_weights(liquidity)))
    rows = chain(minutes)
    level = lambda c: F.col("before") * (1 + F.col(f"r_{c}"))
    rows = rows.withColumns({"open": level("open"), "close": level("close")})
    rows = rows.withColumns(
        {
            "high": F.greatest(level("high"), F.col("open"), F.col("close")),
            "low": F.least(level("low"), F.col("open"), F.col("close")),
        }
    )
    if exact_volume is not None:
        known = exact_volume.filter((F.col("quote_volume") >= 0) & (F.col("quote_volume") < float("inf")))
        rows = rows.join(known.select("open_ts_ms", F.col("quote_volume").alias("_exact")), "open_ts_ms", "left")
    else:
        rows = rows.withColumn("_exact", F.lit(None).cast("double"))
    covered = F.least(F.greatest(F.col("coverage"), F.lit(0.0)), F.lit(1.0))
    return rows.select(
        "open_ts_ms",
        "close_ts_ms",
        "open",
        "high",
        "low",
        "close",
        F.coalesce("_exact", "quote_volume").alias("quote_volume"),
        F.when(F.col("_exact").isNotNull(), "exact_trades").otherwise("close_approximation").alias("volume_source"),
        "contributing_symbols",
        F.lit(requested_symbols).cast("long").alias("requested_symbols"),
        covered.alias("liquidity_weight_coverage"),
        coverage_state(covered).alias("coverage_state"),
        "advances",
        "declines",
        "unchanged",
        F.greatest(F.lit(requested_symbols) - F.col("contributing_symbols"), F.lit(0)).cast("long").alias("stale_symbols"),
    )


def composite_problems(index: DataFrame) -> DataFrame:
    """Minutes whose output is not usable: a value that is not finite, or not positive."""
    inf = float("inf")
    prices = ["open", "high", "low", "close"]
    bad = ~F.coalesce((F.greatest(*prices) < inf) & (F.least(*prices) > 0), F.lit(False))
    bad_volume = ~F.coalesce((F.col("quote_volume") >= 0) & (F.col("quote_volume") < inf), F.lit(False))
    return index.filter(bad | bad_volume)


def composite_validate(index: DataFrame) -> DataFrame:
    """Pass the index through, failing the job on the first unusable minute."""
    inf = float("inf")
    ok = (F.greatest("open", "high", "low", "close") < inf) & (F.least("open", "high", "low", "close") > 0)
    ok = F.coalesce(ok & (F.col("quote_volume") >= 0) & (F.col("quote_volume") < inf), F.lit(False))
    message = F.concat(F.lit("composite has invalid values for minute "), F.col("open_ts_ms").cast("string"))
    return index.filter(F.assert_true(ok, message).isNull())
