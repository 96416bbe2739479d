"""Files: raw captures, tagged JSON lines, event and feature parquet, manifests, inventories."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.errors import ContractError
from tapewright.session import cut_lineage

# Supported storage versions.
MANIFEST = {"manifest_version": 1, "normalized_event_schema_version": 1, "sqlite_schema_version": 1}
EVENT_MANIFEST = {**MANIFEST, "parquet_event_schema_version": 1}
FEATURE_MANIFEST = {**MANIFEST, "parquet_feature_schema_version": 1}
OPTIONAL_VERSIONS = ("parquet_event_schema_version", "parquet_feature_schema_version")

LEVELS = "array<struct<price:double,size:double,order_count:bigint>>"
# Field names of the tagged event documents, per variant.
VARIANTS = {
    "Trade": "struct<recv_ts_ns:bigint,exchange_ts_ms:bigint,hl_coin:string,side:string,price:double,size:double,"
    "notional:double,hash:string,tid:bigint,unique_trade_id:string>",
    "TopOfBook": "struct<recv_ts_ns:bigint,exchange_ts_ms:bigint,hl_coin:string,bid_price:double,bid_size:double,"
    "bid_order_count:bigint,ask_price:double,ask_size:double,ask_order_count:bigint>",
    "OrderBook": f"struct<recv_ts_ns:bigint,exchange_ts_ms:bigint,hl_coin:string,bids:{LEVELS},asks:{LEVELS}>",
    "AssetContext": "struct<recv_ts_ns:bigint,hl_coin:string,day_ntl_vlm:double,prev_day_px:double,mark_px:double,"
    "mid_px:double,circulating_supply:double>",
    "AllMids": "struct<recv_ts_ns:bigint,mids_by_hl_coin:map<string,double>>",
    "Candle": "struct<recv_ts_ns:bigint,open_ts_ms:bigint,close_ts_ms:bigint,hl_coin:string,interval:string,open:double,"
    "high:double,low:double,close:double,volume_base:double,trade_count:bigint,provenance:string,completion:string>",
}
ENVELOPE = "struct<" + ",".join(f"{name}:{schema}" for name, schema in VARIANTS.items()) + ">"
EVENT_TYPES = {
    "Trade": "trade",
    "TopOfBook": "top_of_book",
    "OrderBook": "order_book",
    "AssetContext": "asset_context",
    "AllMids": "all_mids",
    "Candle": "candle",
}
TABLES = {"Trade": "trades", "TopOfBook": "quotes", "OrderBook": "books", "AssetContext": "contexts", "AllMids": "mids", "Candle": "candles"}

RAW = "struct<recv_ts_ns:bigint,conn_id:bigint,seq:bigint,channel:string,payload:string>"


# --- raw captures -------------------------------------------------------------------------------

ZSTD_SUFFIX = ".zst"


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of a capture folder (``value``, ``path``): plain, gzip and other codecs of the text source, and
    Zstandard files, which are unpacked as streams inside the tasks that read them."""
    plain = spark.read.option("pathGlobFilter", "{*[!t],*[!s]t,*[!z]st,*[!.]zst,t,st,zst}").text(path, recursiveFileLookup=True)
    plain = plain.select("value", F.col("_metadata.file_path").alias("path"))
    packed = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ZSTD_SUFFIX}").option("recursiveFileLookup", "true").load(path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content.as_py())) as stream:
                    text = io.TextIOWrapper(stream, encoding="utf-8", newline="\n")
                    while lines := [x.rstrip("\r\n") for x in text.readlines(1 << 22)]:
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([name] * len(lines), pa.string())], ["value", "path"])

    return plain.unionByName(packed.select("path", "content").mapInArrow(unpack, "value string, path string"))


def parse_raw(lines: DataFrame) -> DataFrame:
    """Raw rows with ``problem``: set for a line that is no capture record (bad JSON or without a channel)."""
    rows = lines.select(F.col("value").alias("line"), F.from_json("value", RAW).alias("r"))
    problem = F.when(F.col("r").isNull() | (F.col("r.channel").isNull() & F.col("r.payload").isNull()), "unreadable line").when(F.col("r.channel").isNull(), "no channel")
    return rows.select("r.*", "line", problem.alias("problem")).withColumnRenamed("payload", "value")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw capture rows with the frame text as ``value``. Fails closed: an unusable line ends the job with its text;
    ``parse_raw`` on ``raw_lines`` keeps such lines as rejects instead."""
    return closed(parse_raw(raw_lines(spark, path))).drop("line", "problem")


def closed(rows: DataFrame) -> DataFrame:
    """The rows, or an error in the job that meets one with a ``problem``."""
    text = F.concat(F.col("problem"), F.lit(": "), F.substring(F.coalesce("line", F.lit("")), 1, 200))
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(text)).otherwise(F.lit(True))
    return rows.filter(checked)


def raw_from_frames(frames: DataFrame) -> DataFrame:
    channel = F.get_json_object("value", "$.channel")
    return frames.select("recv_ts_ns", "conn_id", "seq", channel.alias("channel"), "value")


def write_raw(raw: DataFrame, path: str, run_id: str, rows_per_file: int = 1_000_000, compression: str = "gzip") -> None:
    """Create-new write of a run's capture, rolled into files by row count."""
    head = F.to_json(F.struct("recv_ts_ns", "conn_id", "seq", "channel"))
    line = F.concat(F.expr("substring(_h, 1, length(_h) - 1)"), F.lit(',"payload":'), F.col("value"), F.lit("}"))
    (
        raw.withColumn("_h", head)
        .select(line.alias("value"))
        .write.mode("errorifexists")
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", compression)
        .text(f"{path}/run={run_id}")
    )


# --- tagged events ------------------------------------------------------------------------------

def _variant(table: str) -> str:
    return next(v for v, t in TABLES.items() if t == table)


def event_document(table: str, df: DataFrame) -> DataFrame:
    """Rows of one typed table as tagged documents (event_type, recv_ts_ns, symbol, event_json)."""
    variant = _variant(table)
    if table == "mids":
        body = F.struct("recv_ts_ns", F.create_map("symbol", "mid").alias("mids_by_hl_coin"))
        coin = F.lit(None).cast("string")
    else:
        names = [f.split(":")[0] for f in VARIANTS[variant].replace(LEVELS, "levels")[len("struct<"):-1].split(",")]
        cols = []
        for name in names:
            if name == "hl_coin":
                cols.append(F.col("symbol").alias("hl_coin"))
            elif name == "side":
                cols.append(F.initcap("side").alias("side"))
            elif name in df.columns:
                cols.append(F.col(name))
        body, coin = F.struct(*cols), F.col("symbol")
    return df.select(
        F.lit(EVENT_TYPES[variant]).alias("event_type"),
        "recv_ts_ns",
        coin.alias("symbol"),
        F.to_json(F.struct(body.alias(variant))).alias("event_json"),
        "ingest_seq",
    )


def event_documents(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [event_document(name, df) for name, df in tables.items() if name in TABLES.values()]
    return reduce(DataFrame.unionByName, parts)


def parse_documents(docs: DataFrame, json_col: str = "event_json") -> DataFrame:
    """Decode tagged documents; ``variant`` is the one filled field, null for an unusable line."""
    rows = docs.withColumn("e", F.from_json(json_col, ENVELOPE))
    kinds = [F.when(F.col(f"e.{name}").isNotNull(), F.lit(name)) for name in VARIANTS]
    return rows.withColumn("variant", F.coalesce(*kinds))


def tables_from_documents(parsed: DataFrame) -> dict[str, DataFrame]:
    """Typed tables of decoded documents; needs ``ingest_seq``."""
    out = {}
    for variant, table in TABLES.items():
        rows = parsed.filter(F.col("variant") == variant)
        if table == "mids":
            out[table] = rows.select(
                F.col("e.AllMids.recv_ts_ns").alias("recv_ts_ns"), F.explode("e.AllMids.mids_by_hl_coin").alias("symbol", "mid"), "ingest_seq"
            )
            continue
        df = rows.select(f"e.{variant}.*", "ingest_seq").withColumnRenamed("hl_coin", "symbol")
        if table == "trades":
            df = df.withColumn("side", F.lower("side"))
        if table == "candles":
            df = df.withColumns(
                {"provenance": F.coalesce("provenance", F.lit("web_socket")), "completion": F.coalesce("completion", F.lit("open"))}
            )
        out[table] = df
    return out


def with_problem(parsed: DataFrame, json_col: str = "event_json") -> DataFrame:
    """Decoded documents with ``line`` and ``problem`` (no variant that this version knows)."""
    return parsed.withColumns({"line": F.col(json_col), "problem": F.when(F.col("variant").isNull(), "unreadable document")})


def read_normalized(spark: SparkSession, path: str, fail: bool = True) -> dict[str, DataFrame]:
    """Typed tables of a tagged JSON-lines dataset, in (file, line) order.

    An unusable line ends the job; with ``fail=False`` such lines are the table ``rejects`` (line, problem).
    """
    lines = spark.read.text(path, recursiveFileLookup=True)
    rows = lines.select(
        F.col("value").alias("event_json"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return typed_tables(number_lines(parsed_once(rows)), fail)


def number_lines(rows: DataFrame) -> DataFrame:
    """Dense 0-based ``ingest_seq`` in (file, line) order of rows that were read with ``_path``, ``_block``, ``_line``, without sorting them.

    The lines of a block are read by one task, one after the other, so a line only needs the first number of its block and
    how many lines the blocks before it have: a table with one row per block.
    """
    block = ["_path", "_block"]
    sizes = rows.groupBy(*block).agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*block, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = rows.join(F.broadcast(offsets), block)
    return numbered.withColumn("ingest_seq", F.col("_line") + F.col("_shift")).drop(*block, "_line", "_shift")


def parsed_once(docs: DataFrame) -> DataFrame:
    """Documents decoded and written once, so that no typed table decodes all of them again; ``line`` is kept where there is a problem."""
    parsed = with_problem(parse_documents(docs)).drop("event_json")
    return cut_lineage(parsed.withColumn("line", F.when(F.col("problem").isNotNull(), F.col("line"))))


def typed_tables(parsed: DataFrame, fail: bool) -> dict[str, DataFrame]:
    rejects = parsed.filter("problem IS NOT NULL").select("line", "problem")
    if not fail:
        return {**tables_from_documents(parsed), "rejects": rejects}
    # asked here: a filter on the variant may skip the part of the file that a bad line is in
    bad = rejects.first()
    if bad is not None:
        raise ContractError(f"{bad['problem']}: {(bad['line'] or '')[:200]}")
    return tables_from_documents(parsed)


def write_normalized(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    docs = event_documents(tables).withColumn("run", F.lit(run_id))
    docs.select("event_json").write.mode("errorifexists").text(f"{path}/run={run_id}")


# --- parquet exports ----------------------------------------------------------------------------

def with_row_index(df: DataFrame, order: list[str]) -> DataFrame:
    """Dense 0-based ``row_index`` along ``order``, without one task seeing all rows.

    A range sort balances partitions by sampling; the sorted rows are frozen in the checkpoint folder,
    then every partition only needs the number of rows before it (one row per partition).
    """
    rows = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_id") - F.shiftleft(F.col("_p"), 33)
    joined = rows.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return joined.withColumn("row_index", F.col("_before") + inside).drop("_p", "_id", "_before")


def export_events_parquet(tables: dict[str, DataFrame], path: str) -> None:
    """Five-column event parquet in stream order, with its manifest."""
    # written before the sort, which reads its input twice
    docs = with_row_index(cut_lineage(event_documents(tables)), ["recv_ts_ns", "ingest_seq", "event_type"])
    out = docs.select("row_index", "event_type", "recv_ts_ns", F.col("symbol").alias("hl_coin"), "event_json")
    out.write.mode("errorifexists").parquet(f"{path}/events")
    write_manifest(docs.sparkSession, path, EVENT_MANIFEST)


def read_events_parquet(spark: SparkSession, path: str, fail: bool = True) -> dict[str, DataFrame]:
    """Typed tables of an event export; refuses an unsupported manifest, never falls back to JSON. Unusable documents
    end the job, or with ``fail=False`` are the table ``rejects``."""
    check_manifest(read_manifest(spark, path), need="parquet_event_schema_version")
    docs = spark.read.parquet(f"{path}/events").withColumnRenamed("row_index", "ingest_seq")
    return typed_tables(parsed_once(docs), fail)


FEATURE_COLUMNS = [
    "row_index", "snapshot_ts_ms", "symbol", "confidence_score", "confidence_level", "confidence_reasons_json", "price", "mid_px",
    "spread_bps", "tob_depth_usd", "tob_imbalance", "liquidity_score", "momentum_score", "mean_reversion_score", "tradeability_state",
    "resilience_state", "snapshot_json",
]


def feature_export(snapshots: DataFrame) -> DataFrame:
    whole: Column = F.to_json(F.struct(*[F.col(c) for c in snapshots.columns]))
    rows = snapshots.withColumns(
        {
            "snapshot_json": whole,
            "snapshot_ts_ms": F.col("now_ms"),
            "confidence_score": F.col("confidence.score").cast("long"),
            "confidence_level": F.col("confidence.level"),
            "confidence_reasons_json": F.to_json("confidence.reasons"),
        }
    )
    return with_row_index(rows, ["now_ms", "symbol"]).select(*FEATURE_COLUMNS)


def export_features_parquet(snapshots: DataFrame, path: str) -> None:
    feature_export(snapshots).write.mode("errorifexists").parquet(f"{path}/features")
    write_manifest(snapshots.sparkSession, path, FEATURE_MANIFEST)


# --- manifests and inventories --------------------------------------------------------------------

def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/schema")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/schema").first()[0])


def check_manifest(manifest: dict, need: str | None = None) -> None:
    for name, wanted in MANIFEST.items():
        if manifest.get(name) != wanted:
            raise ContractError(f"unsupported {name} {manifest.get(name)}; expected {wanted}")
    for name in OPTIONAL_VERSIONS:
        if manifest.get(name) not in (None, 1):
            raise ContractError(f"unsupported {name} {manifest[name]}; expected 1")
    if need and manifest.get(need) is None:
        raise ContractError(f"manifest has no {need}")


def file_inventory(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows, bytes and covered time per file of a dataset read from files."""
    m = "_metadata"
    rows = df.select(
        F.col(f"{m}.file_path").alias("path"), F.col(f"{m}.file_size").alias("bytes"), F.col(start).alias("_s"), F.col(end).alias("_e")
    )
    return rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes"), F.min("_s").alias("start_ts_ms"), F.max("_e").alias("end_ts_ms")
    )


def event_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
