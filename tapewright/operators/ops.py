"""Operational views: health, latency percentiles, metric rows, soak summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.errors import ContractError
from tapewright.functions.common import tags
from tapewright.operators.ordered import value_at_rank

# Labels that would explode a metric's cardinality.
BANNED_LABELS = ["symbol", "hl_coin", "coin", "run_id", "wallet", "account", "address", "tx_hash", "trade_id"]


def health_status(inputs: DataFrame) -> DataFrame:
    """Status and reasons per health row; the worst rule decides."""
    ok = F.col("read_only") & ~F.col("wallet_enabled") & ~F.col("trading_enabled")
    conn = F.col("connection_state")
    backlog = (F.col("writer_warn_at") > 0) & (F.col("writer_backlog") > F.col("writer_warn_at"))
    # The reason texts and limits of a health report.
    rules = [
        (~ok, "read-only safety violation", 2),
        (conn == "disconnected", "connection disconnected", 2),
        (conn == "reconnecting", "connection reconnecting", 1),
        (conn == "stale", "connection stale", 1),
        (backlog, "writer backlog high", 1),
        (F.coalesce(F.col("last_message_age_ms") >= 60_000, F.lit(False)), "stale inbound data", 1),
        (F.coalesce(F.col("lag_ms") >= 10_000, F.lit(False)), "data lag high", 1),
        (F.greatest("gap_count", "connection_gap_count") > 0, "data gaps detected", 1),
    ]
    worst = F.greatest(*[F.when(hit, level).otherwise(0) for hit, _, level in rules])
    return inputs.withColumns(
        {
            "status": F.when(worst == 2, "interrupted").when(worst == 1, "degraded").otherwise("healthy"),
            "degraded_reasons": tags([(hit, text) for hit, text, _ in rules]),
        }
    )


def latency_percentiles(samples: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Nearest-rank percentiles of receive, feature and render lag; a negative lag counts as 0."""
    ends = {"data": "recv_ts_ms", "feature": "feature_done_ts_ms", "render": "render_done_ts_ms"}
    lags = [F.struct(F.lit(kind).alias("kind"), F.greatest(F.col(end) - F.col("exchange_ts_ms"), F.lit(0).cast("long")).alias("lag")) for kind, end in ends.items()]
    tall = samples.select(*keys, F.inline(F.array(*lags)))
    ranks = {f"p{p}": lambda n, p=p: F.ceil(n * F.lit(p) / 100) for p in (50, 95)}
    found = value_at_rank(tall, [*keys, "kind"], "lag", ranks)

    def pick(kind: str, p: int) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(f"p{p}"))).cast("bigint").alias(f"{kind}_lag_ms_p{p}")

    picked = found.groupBy(*keys).agg(pick("data", 50), pick("data", 95), pick("feature", 95), pick("render", 95))
    counts = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    return counts.join(picked, keys, "left") if keys else counts.join(picked, how="cross")  # one row each


# Operational metrics (column, kind); the repair latency is optional.
OPS_METRICS = [
    ("reconnect_attempts_total", "counter", "reconnect_attempts"),
    ("parser_drops_total", "counter", "parser_drops"),
    ("stale_duration_ms_total", "counter", "stale_duration_ms"),
    ("unrepaired_gap_duration_ms", "gauge", "unrepaired_gap_duration_ms"),
    ("repair_latency_ms", "gauge", "repair_latency_ms"),
]


def ops_metrics(telemetry: DataFrame, prefix: str = "market_", labels: list[str] = ()) -> DataFrame:
    """Metric rows (name, kind, labels, value); a metric without a value is left out."""
    for label in labels:
        if label in BANNED_LABELS:
            raise ContractError(f"label '{label}' has unbounded cardinality")
    if len(set(labels)) != len(labels):
        raise ContractError("metric labels repeat")
    pairs = [x for label in labels for x in (F.lit(label), F.col(label).cast("string"))]
    label_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    records = [
        F.when(
            F.col(column).isNotNull(),
            F.struct(F.lit(prefix + name).alias("name"), F.lit(kind).alias("kind"), F.col(column).cast("double").alias("value")),
        )
        for name, kind, column in OPS_METRICS
    ]
    rows = telemetry.withColumn("labels", label_map)
    return rows.select("labels", F.inline(F.array_compact(F.array(*records))))


def soak_summary(messages: DataFrame, events: DataFrame, gaps: DataFrame, rejects: DataFrame) -> DataFrame:
    """Run totals per run: symbols, messages, events, reconnects, gaps, parser drops."""
    per = lambda df, *aggs: df.groupBy("run_id").agg(*aggs)
    n = F.count(F.lit(1))
    out = per(messages, n.alias("messages"), (F.count_distinct("conn_id") - 1).alias("reconnects"))
    out = out.join(per(events, n.alias("events"), F.count_distinct("symbol").alias("symbols")), "run_id", "left")
    out = out.join(per(gaps, n.alias("gaps")), "run_id", "left").join(per(rejects, n.alias("parser_drops")), "run_id", "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("events", "symbols", "gaps", "parser_drops")})
