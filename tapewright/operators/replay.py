"""Replay of a recorded run, parity against a stored baseline, dataset digests."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.errors import ContractError
from tapewright.operators import features, state


def check_run(runs: DataFrame, run_id: str) -> None:
    """A run must be registered and have shut down cleanly before it can be replayed."""
    row = runs.filter(F.col("run_id") == run_id).select("clean_shutdown").first()
    if row is None:
        raise ContractError(f"recording run '{run_id}' was not found")
    if row["clean_shutdown"] is not True:
        raise ContractError(f"recording run '{run_id}' did not shut down cleanly")


def replay(market: features.Market, symbols: DataFrame | None = None, options=features.SnapshotOptions()) -> tuple[DataFrame, int]:
    """State of a run's events at its newest update: (snapshots, decision time)."""
    if symbols is not None:
        keep = lambda df: None if df is None else state.filter_universe(df, symbols)
        parts = ("trades", "quotes", "contexts", "mids", "books", "candles")
        market = replace(market, **{p: keep(getattr(market, p)) for p in parts}, symbols=symbols)
    updates = state.last_update(market.trades, market.quotes, market.books, market.contexts, market.mids, market.candles)
    now = state.replay_clock_ms(updates)
    if now <= 0:
        raise ContractError("run has no market events to replay")
    return features.snapshot(market, now, options), now


CONFIDENCE = ["score", "level", "reasons", "incomplete_windows"]


def confidence_of(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("symbol", "confidence")


def parity_diff(baseline: DataFrame, replayed: DataFrame) -> DataFrame:
    """Symbols whose confidence differs, or that one side lacks, with a readable detail."""
    b = baseline.select("symbol", F.col("confidence").alias("b"))
    r = replayed.select("symbol", F.col("confidence").alias("r"))
    rows = b.join(r, "symbol", "full").filter(~F.col("b").eqNullSafe(F.col("r")))
    text = lambda side, name: F.concat(
        F.lit(f"{name} score="), F.col(f"{side}.score").cast("string"), F.lit(" level="), F.col(f"{side}.level"),
        F.lit(" reasons=["), F.array_join(f"{side}.reasons", ","), F.lit("]"),
    )
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("r").isNull(), "extra").otherwise("drift")
    detail = (
        F.when(F.col("b").isNull(), F.concat("symbol", F.lit(": missing confidence baseline")))
        .when(F.col("r").isNull(), F.concat("symbol", F.lit(": baseline has no replayed row")))
        .otherwise(F.concat("symbol", F.lit(": "), text("b", "baseline"), F.lit("; "), text("r", "replay")))
    )
    return rows.select("symbol", kind.alias("kind"), detail.alias("detail"))


def parity_report(baseline: DataFrame, replayed: DataFrame) -> DataFrame:
    kind = F.col("kind")
    counts = parity_diff(baseline, replayed).agg(
        F.count_if(kind == "drift").alias("drift_count"),
        F.count_if(kind == "missing").alias("missing_count"),
        F.count_if(kind == "extra").alias("extra_count"),
    )
    return counts.withColumn("matched", F.col("drift_count") + F.col("missing_count") + F.col("extra_count") == 0)


def row_hashes(df: DataFrame) -> DataFrame:
    """SHA-256 of each row's canonical JSON (columns by name)."""
    return df.select(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256).alias("h"))


def dataset_digest(df: DataFrame) -> DataFrame:
    """One digest for a whole table, independent of row order and partitioning.

    Row hashes are summed in four 60-bit lanes, so the digest is a plain aggregation; put an order
    column into the rows when order matters.
    """
    lanes = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    sums = row_hashes(df).agg(F.count(F.lit(1)).alias("n"), *[lane.alias(f"l{i}") for i, lane in enumerate(lanes)])
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", "l0", "l1", "l2", "l3")])
    return sums.select(F.col("n").alias("row_count"), F.sha2(text, 256).alias("digest"))


def check_digest(df: DataFrame, expected: str) -> None:
    actual = dataset_digest(df).first()["digest"]
    if actual != expected:
        raise ContractError(f"dataset digest drifted: expected {expected}, got {actual}")
