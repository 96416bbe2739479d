"""Streaming ingest: raw capture and typed tables written in the same pass, latest values published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapewright.sources import files, wire


def frame_stream(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """Raw capture files as a stream of frames; ``max_files`` bounds a micro-batch.

    As in batch, a line that is no capture record has a ``problem`` and its text in ``line``.
    """
    return files.parse_raw(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def run_ingest(frames: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write raw frames, every typed table and the rejects (unusable lines and refused frames) of each micro-batch.

    Each batch owns the folder ``batch=<id>`` of every table and overwrites it, so a batch that is
    retried after a failure leaves no duplicates. A failing sink fails the batch. Frames are decoded once a batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        bad = F.col("problem").isNotNull() if "problem" in batch.columns else F.lit(False)
        lines = batch if "problem" in batch.columns else batch.withColumns({"problem": F.lit(None).cast("string"), "line": F.col("value")})
        decoded = wire.decode(lines.filter(~bad).drop("problem", "line")).persist()
        try:
            lines.filter(~bad).drop("problem", "line").write.mode("overwrite").parquet(f"{out}/raw/batch={batch_id}")
            for name, build in wire.NORMALIZERS.items():
                rows = build(decoded)
                if name == "rejects":
                    unusable = lines.filter(bad).select(*wire.META, "channel", "problem", F.col("line").alias("value"))
                    rows = rows.unionByName(unusable)
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        finally:
            decoded.unpersist()

    stream = frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"processingTime": "1 second"})).start()


def latest_values(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Latest trade and quote per symbol as a native streaming aggregation.

    Works in update mode with one small row of state per symbol; partial aggregation combines a hot
    symbol's ticks before the shuffle. Late ticks never replace newer ones.
    """
    def tick(df: DataFrame, kind: str, value) -> DataFrame:
        return df.select("symbol", "exchange_ts_ms", "ingest_seq", F.lit(kind).alias("kind"), value.alias("v"))

    trade = F.struct(F.col("price").alias("a"), F.col("size").alias("b"), F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("d"))
    quote = F.struct(F.col("bid_price").alias("a"), F.col("bid_size").alias("b"), F.col("ask_price").alias("c"), F.col("ask_size").alias("d"))
    ticks = tick(trades, "trade", trade).unionByName(tick(quotes, "quote", quote))

    def newest(kind: str):
        return F.max_by("v", F.when(F.col("kind") == kind, F.struct("exchange_ts_ms", "ingest_seq")))

    return (
        ticks.groupBy("symbol")
        .agg(newest("trade").alias("t"), newest("quote").alias("q"), F.max("exchange_ts_ms").alias("last_update_ms"))
        .select(
            "symbol",
            F.col("t.a").alias("last_trade_price"),
            F.col("q.a").alias("bid_px"),
            F.col("q.b").alias("bid_sz"),
            F.col("q.c").alias("ask_px"),
            F.col("q.d").alias("ask_sz"),
            "last_update_ms",
        )
    )


def publish_latest(values: DataFrame, path: str, checkpoint: str, compact_every: int = 240, **trigger) -> StreamingQuery:
    """Publish changed rows: the newest state of a symbol wins and skipped ticks are not caught up.

    Each micro-batch (250 ms apart by default) writes one version folder with the changed symbols; every ``compact_every`` batches (a
    minute) the versions are merged, so that the number of folders stays bounded (0: never).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact_published(batch.sparkSession, path)

    stream = values.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"processingTime": "250 milliseconds"})).start()


def _folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``prefix<number>`` below a path, ascending."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}*")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(int(f.getPath().getName()[len(prefix) :]) for f in found or [])


def _newest_base(spark: SparkSession, path: str) -> int | None:
    """The base that readers follow. A pointer is one file, moved into place when the base is complete."""
    if not _folders(spark, path, "pointer="):
        return None
    return spark.read.schema("base long").option("basePath", path).parquet(f"{path}/pointer=*").agg(F.max("base").alias("b")).first()["b"]


def compact_published(spark: SparkSession, path: str) -> int | None:
    """Merge the newest base and all later versions into a new base, point readers to it, and drop what the base before it replaced.

    Readers that started on the base before still find its files: one generation is kept. One compaction at a time.
    """
    versions, before = _folders(spark, path, "v="), _newest_base(spark, path)
    later = [v for v in versions if before is None or v > before]
    if not later:
        return before
    newest = later[-1]
    read_published(spark, path, up_to=newest).write.mode("overwrite").parquet(f"{path}/base={newest}")
    spark.range(1).select(F.lit(newest).cast("long").alias("base")).coalesce(1).write.mode("overwrite").parquet(f"{path}/pointer={newest}")
    if before is not None:
        old = [f"v={v}" for v in versions if v <= before]
        old += [f"{kind}={b}" for kind in ("pointer", "base") for b in _folders(spark, path, f"{kind}=") if b < before]
        for name in old:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return newest


def read_published(spark: SparkSession, path: str, up_to: int | None = None) -> DataFrame:
    """Current state: the highest version per symbol, from the newest base and the versions after it."""
    base = _newest_base(spark, path)
    versions = [v for v in _folders(spark, path, "v=") if (base is None or v > base) and (up_to is None or v <= up_to)]
    places = [f"{path}/v={v}" for v in versions] + ([f"{path}/base={base}"] if base is not None else [])
    rows = spark.read.parquet(*places)
    payload = [c for c in rows.columns if c != "symbol"]
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*payload), "version").alias("w")).select("symbol", "w.*")


def rolling_flow(trades: DataFrame, window: str, slide: str, lateness: str = "1 hour") -> DataFrame:
    """Sliding-window flow, VWAP and counts by exchange time; duplicates inside the lateness dropped.

    Additive features need no per-symbol ordering, so Spark's own sliding windows (with partial
    aggregation) carry them.
    """
    timed = trades.withColumn("event_time", F.timestamp_millis("exchange_ts_ms")).withWatermark("event_time", lateness)
    once = timed.dropDuplicatesWithinWatermark(["symbol", "unique_trade_id"])
    buy = F.col("side") == "buy"
    return (
        once.groupBy("symbol", F.window("event_time", window, slide).alias("w"))
        .agg(
            F.sum(F.when(buy, F.col("notional")).otherwise(-F.col("notional"))).alias("flow"),
            (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"),
            F.count(F.lit(1)).alias("trades"),
        )
        .select("symbol", F.unix_millis("w.end").alias("window_end_ms"), "flow", "vwap", "trades")
    )
