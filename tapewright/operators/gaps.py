"""Data gaps and their backfill from public candles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.errors import ContractError
from tapewright.operators.candles import INTERVAL_MS
from tapewright.operators.ordered import ordered_scan

SILENCE_NS = 60 * 10**9
SOURCE = "candleSnapshot"


def detect_gaps(messages: DataFrame, silence_ns: int = SILENCE_NS, symbols: list[str] = (), per_symbol: bool = False) -> DataFrame:
    """Gaps between consecutive messages of a run: a changed connection or a long silence.

    ``messages`` has (run_id, conn_id, recv_ts_ns, seq). A gap spans from the last message before it to
    the next one and affects every tracked symbol; with ``per_symbol`` silence is judged per symbol.
    """
    keys = ["run_id", "symbol"] if per_symbol else ["run_id"]
    scanned = ordered_scan(messages, keys, "recv_ts_ns", "seq", previous=["recv_ts_ns", "conn_id"])
    moved = F.col("conn_id") != F.col("prev.conn_id")
    silent = F.col("recv_ts_ns") - F.col("prev.recv_ts_ns") >= silence_ns
    affected = F.array("symbol") if per_symbol else F.array(*[F.lit(s) for s in symbols]).cast("array<string>")
    rows = scanned.filter(F.col("prev").isNotNull() & (moved | silent)).select(
        "run_id",
        F.col("prev.conn_id").alias("conn_id"),
        F.col("prev.recv_ts_ns").alias("started_at_ns"),
        F.col("recv_ts_ns").alias("ended_at_ns"),
        F.when(moved, "connection changed")
        .otherwise(F.lit(f"no market-data event for {silence_ns // 10**9} seconds"))
        .alias("reason"),
        affected.alias("affected_symbols"),
        F.lit(False).alias("recovered"),
    )
    parts = ["run_id", "conn_id", "started_at_ns", "ended_at_ns"]
    return rows.withColumn("gap_id", F.concat_ws(":", *parts, *(["affected_symbols"] if per_symbol else [])))


def gap_symbols(gaps: DataFrame, attempts: DataFrame | None = None, skip_recovered: bool = True) -> DataFrame:
    """Symbols still penalised. A replay skips recovered gaps and gaps with a restoring attempt."""
    open_gaps = gaps.filter(~F.col("recovered")) if skip_recovered else gaps
    if skip_recovered and attempts is not None:
        restored = attempts.filter(F.col("confidence_impact") == "restored").select("run_id", "gap_id").distinct()
        open_gaps = open_gaps.join(restored, ["run_id", "gap_id"], "left_anti")
    return open_gaps.select(F.explode("affected_symbols").alias("symbol")).distinct()


def pending_backfill(gaps: DataFrame, attempts: DataFrame, interval: str, retry_existing: bool = False) -> DataFrame:
    """One candle request per unrecovered gap and symbol not yet tried with this source and interval."""
    if interval not in INTERVAL_MS:
        raise ContractError("backfill interval must be a supported public candle interval")
    todo = gaps.filter(~F.col("recovered"))
    if not retry_existing:
        tried = attempts.filter((F.col("source") == SOURCE) & (F.col("interval") == interval))
        todo = todo.join(tried.select("run_id", "gap_id").distinct(), ["run_id", "gap_id"], "left_anti")
    return todo.select(
        "run_id",
        "gap_id",
        F.explode("affected_symbols").alias("symbol"),
        F.lit(interval).alias("interval"),
        F.expr("started_at_ns div 1000000").alias("start_time_ms"),
        F.expr("ended_at_ns div 1000000").alias("end_time_ms"),
    )


def backfill_rows(requests: DataFrame, candles: DataFrame, bucket_ms: int) -> DataFrame:
    """Candles overlapping each request. Both sides spread over time buckets; a pair that shares
    several buckets is kept in the first common one, so it appears once."""
    def spread(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
        first = F.expr(f"{start} div {bucket_ms}")
        return df.withColumn(name, first).withColumn(
            "_bucket", F.explode(F.sequence(first, F.expr(f"{end} div {bucket_ms}")))
        )

    left = spread(requests, "start_time_ms", "end_time_ms", "_from_request")
    right = spread(candles, "open_ts_ms", "close_ts_ms", "_from_candle")
    pairs = left.join(right, ["symbol", "interval", "_bucket"])
    overlap = (F.col("close_ts_ms") >= F.col("start_time_ms")) & (F.col("open_ts_ms") <= F.col("end_time_ms"))
    once = F.col("_bucket") == F.greatest("_from_request", "_from_candle")
    return pairs.filter(overlap & once).drop("_bucket", "_from_request", "_from_candle")


def backfill_attempts(gaps: DataFrame, rows: DataFrame, interval: str, attempted_at_ms: int) -> DataFrame:
    """One attempt per examined gap. Candles repair a gap only partially; none leaves it degraded."""
    written = rows.groupBy("run_id", "gap_id").agg(F.count(F.lit(1)).alias("rows_written"))
    found = F.col("rows_written") > 0
    return (
        gaps.filter(~F.col("recovered"))
        .join(written, ["run_id", "gap_id"], "left")
        .withColumn("rows_written", F.coalesce("rows_written", F.lit(0).cast("long")))
        .select(
            F.concat_ws(":", "gap_id", F.lit(SOURCE), F.lit(interval), F.lit("0")).alias("attempt_id"),
            "run_id",
            "gap_id",
            F.lit(SOURCE).alias("source"),
            F.lit(interval).alias("interval"),
            F.col("started_at_ns").alias("requested_start_ns"),
            F.col("ended_at_ns").alias("requested_end_ns"),
            F.lit(attempted_at_ms).cast("long").alias("attempted_at_ms"),
            F.when(found, "partially_repaired").otherwise("unrepaired").alias("status"),
            "rows_written",
            F.when(found, "partial").otherwise("degraded").alias("confidence_impact"),
        )
    )


def backfill_summary(attempts: DataFrame, failures: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """One row per run with an attempt or, given ``runs`` (run_id), per run examined: one without a gap to repair has zero
    counts and, as a sum over no attempts, null ``rows_written``."""
    status = F.col("status")
    out = attempts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("gaps_examined"),
        F.count_if(status == "repaired").alias("gaps_repaired"),
        F.count_if(status == "partially_repaired").alias("gaps_partially_repaired"),
        F.count_if(status == "unrepaired").alias("gaps_unrepaired"),
        F.sum("rows_written").alias("rows_written"),
    )
    if runs is not None:
        counts = ["gaps_examined", "gaps_repaired", "gaps_partially_repaired", "gaps_unrepaired"]
        out = runs.select("run_id").distinct().join(out, "run_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})
    if failures is None:
        return out.withColumn("requests_failed", F.lit(0).cast("long"))
    failed = failures.groupBy("run_id").agg(F.count(F.lit(1)).alias("requests_failed"))
    return out.join(failed, "run_id", "left").withColumn("requests_failed", F.coalesce("requests_failed", F.lit(0).cast("long")))
