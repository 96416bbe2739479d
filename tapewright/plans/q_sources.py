"""Registered queries: decoding of wire frames, file round trips, exports, inventories."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapewright.operators import replay
from tapewright.plans import oracle_base as ob
from tapewright.plans import views
from tapewright.plans.frames import frames
from tapewright.plans.oracle_base import HOUR, r6
from tapewright.plans.registry import register, rounded
from tapewright.session import checkpoint_dir
from tapewright.sources import files, wire


def scratch(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def decoded(s, d):
    return wire.decode(frames(s, d))


_TR = "event_type = 'purchase' AND k NOT IN (50, 51)"
register(
    "S5_normalize_trades",
    lambda s, d: wire.normalize_trades(decoded(s, d)).select("symbol", "exchange_ts_ms", "tid", "side", "unique_trade_id", *rounded("price", "size", "notional")),
    ob.base(f"""SELECT symbol, ms AS exchange_ts_ms, seq + o AS tid, CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, symbol || ':' || ms || ':' || (seq + o) AS unique_trade_id,
      {r6('px')} AS price, CAST(k % 9 + 1 AS DOUBLE) AS size, {r6('px * (k % 9 + 1)')} AS notional FROM ev, (SELECT unnest([0, 10000000]) AS o) WHERE {_TR}"""),
)
register(
    "S6_normalize_quotes",
    lambda s, d: wire.normalize_quotes(decoded(s, d)).select("symbol", "exchange_ts_ms", "bid_order_count", "ask_order_count", *rounded("bid_price", "bid_size", "ask_price", "ask_size")),
    ob.base(f"""SELECT symbol, ms AS exchange_ts_ms, CAST(1 AS BIGINT) AS bid_order_count, CASE WHEN seq % 5 <> 0 THEN CAST(1 AS BIGINT) END AS ask_order_count, {r6('px * 0.999::DOUBLE')} AS bid_price,
      CAST(seq % 60 + 1 AS DOUBLE) AS bid_size, CASE WHEN seq % 5 <> 0 THEN {r6('px * 1.001::DOUBLE')} END AS ask_price, CASE WHEN seq % 5 <> 0 THEN CAST(seq % 60 + 1 AS DOUBLE) END AS ask_size
    FROM ev WHERE event_type = 'signup' AND k < 70 AND NOT (k = 60 AND seq % 5 <> 0)"""),
)
register(
    "S7_normalize_books",
    lambda s, d: wire.normalize_books(decoded(s, d)).select(
        "symbol", "exchange_ts_ms", F.size("bids").alias("bids"), (F.round(F.col("bids")[1]["price"], 6) + 0).alias("second_bid"),
        F.col("bids")[1]["size"].alias("second_size"), (F.round(F.col("asks")[0]["price"], 6) + 0).alias("best_ask"),
    ),
    ob.base(f"""SELECT symbol, ms AS exchange_ts_ms, 2 AS bids, {r6('px * 0.99::DOUBLE')} AS second_bid, CAST(0 AS DOUBLE) AS second_size, {r6('px * 1.001::DOUBLE')} AS best_ask
    FROM ev WHERE event_type = 'signup' AND k >= 70"""),
)
register(
    "S8_normalize_mids",
    lambda s, d: wire.normalize_mids(decoded(s, d)).select("symbol", F.expr("recv_ts_ns div 1000000").alias("recv_ms"), *rounded("mid")),
    ob.base(f"""SELECT symbol, ms AS recv_ms, {r6('px')} AS mid FROM ev WHERE event_type = 'click' AND k < 50
    UNION ALL SELECT 'Z' || symbol, ms, {r6('px * 2')} FROM ev WHERE event_type = 'click' AND k < 50"""),
)
register(
    "S9_normalize_contexts",
    lambda s, d: wire.normalize_contexts(decoded(s, d)).select("symbol", F.expr("recv_ts_ns div 1000000").alias("recv_ms"), *rounded("day_ntl_vlm", "mark_px", "mid_px", "circulating_supply")),
    ob.base(f"""SELECT symbol, ms AS recv_ms, CAST(k * 1000 AS DOUBLE) AS day_ntl_vlm, CASE WHEN k % 7 <> 0 THEN {r6('px')} END AS mark_px, CASE WHEN k % 5 <> 0 THEN {r6('px')} END AS mid_px,
      CAST(NULL AS DOUBLE) AS circulating_supply FROM ev WHERE event_type = 'click' AND k >= 50 AND k <> 63"""),
)
_CANDLES = "event_type = 'view' AND k <> 64"
register(
    "S10_normalize_candles",
    lambda s, d: wire.normalize_candles(decoded(s, d)).select("symbol", "interval", "open_ts_ms", "close_ts_ms", "trade_count", *rounded("open", "high", "low", "close", "volume_base")),
    ob.base(f"""SELECT symbol, '1m' AS interval, ms // 60000 * 60000 AS open_ts_ms, ms // 60000 * 60000 + 59999 AS close_ts_ms, CAST(k + 1 AS BIGINT) AS trade_count, {r6('px')} AS open, {r6('px * 1.01::DOUBLE')} AS high,
      {r6('px * 0.99::DOUBLE')} AS low, {r6('px')} AS close, CAST(k AS DOUBLE) AS volume_base FROM ev WHERE {_CANDLES}"""),
)


def _split(s, d):
    decoded_frames = decoded(s, d)
    parts = [
        build(decoded_frames).select(F.lit(name).alias("kind"), (F.col("problem") if name == "rejects" else F.lit("")).alias("problem"))
        for name, build in wire.NORMALIZERS.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("kind", "problem").agg(F.count(F.lit(1)).alias("rows"))


register(
    "S4_split_events",
    _split,
    ob.base(f"""
    , k AS (
      SELECT CASE WHEN event_type = 'purchase' THEN CASE WHEN k IN (50, 51) THEN 'rejects' ELSE 'trades' END
        WHEN event_type = 'signup' AND k < 70 THEN CASE WHEN k = 60 AND seq % 5 <> 0 THEN 'rejects' ELSE 'quotes' END WHEN event_type = 'signup' THEN 'books'
        WHEN event_type = 'click' AND k < 50 THEN 'mids' WHEN event_type = 'click' THEN CASE WHEN k = 63 THEN 'rejects' ELSE 'contexts' END
        WHEN event_type = 'view' THEN CASE WHEN k = 64 THEN 'rejects' ELSE 'candles' END WHEN k % 3 = 0 THEN 'control' ELSE 'rejects' END AS kind,
        CASE WHEN event_type = 'error' AND k % 3 = 1 THEN 'private or trading channel' WHEN event_type = 'error' THEN 'unsupported public channel' WHEN event_type = 'purchase' THEN 'invalid payload of trades'
        WHEN event_type = 'signup' THEN 'invalid payload of bbo' WHEN event_type = 'click' THEN 'invalid payload of activeSpotAssetCtx' ELSE 'invalid payload of candle' END AS problem,
        CASE WHEN event_type = 'purchase' AND k NOT IN (50, 51) THEN 2 WHEN event_type = 'click' AND k < 50 THEN 2 ELSE 1 END AS n FROM ev)
    SELECT kind, CASE WHEN kind = 'rejects' THEN problem ELSE '' END AS problem, CAST(sum(n) AS BIGINT) AS rows FROM k WHERE kind <> 'control' GROUP BY 1, 2"""),
)


def _checked(s, d):
    """Hourly answers checked against a request for the first half of the tape of 60-second candles."""
    first, last = views.first_ms(s, d), views.now_ms(s, d)
    rows = wire.normalize_candles(decoded(s, d))
    return wire.validate_candle_response(rows, F.col("symbol"), F.lit("1m"), F.lit(first), F.lit((first + last) // 2)).groupBy(
        F.coalesce("problem", F.lit("ok")).alias("verdict")
    ).agg(F.count(F.lit(1)).alias("candles"))


register(
    "S11_validate_candle_response",
    _checked,
    ob.base(f""", b AS (SELECT min(ms) AS a, (min(ms) + max(ms)) // 2 AS z FROM ev)
    SELECT CASE WHEN ms // 60000 * 60000 + 59999 < a OR ms // 60000 * 60000 > z THEN 'outside the requested range' ELSE 'ok' END AS verdict, count(*) AS candles FROM ev, b WHERE {_CANDLES} GROUP BY 1"""),
)
register(
    "S12_stamp_receive_time",
    lambda s, d: wire.stamp_receive_time(wire.normalize_trades(decoded(s, d)), F.col("exchange_ts_ms") * 1_000_000 + 7).select("tid", "recv_ts_ns"),
    ob.base(f"SELECT seq + o AS tid, ms * 1000000 + 7 AS recv_ts_ns FROM ev, (SELECT unnest([0, 10000000]) AS o) WHERE {_TR}"),
)


def _broken_lines(s, d):
    """A line that is no record for every error event of the tape."""
    errors = views.read(s, d, "events").filter("event_type = 'error'")
    return errors.select(F.concat(F.lit('{"half a line": '), F.col("event_id").cast("string")).alias("value"))


def _raw_round_trip(s, d):
    """Capture written as rolled, compressed JSON lines and read back."""
    path = scratch(s, "raw")
    files.write_raw(files.raw_from_frames(frames(s, d)), path, "r1", rows_per_file=5_000)
    _broken_lines(s, d).write.text(f"{path}/run=broken")
    rows = files.parse_raw(files.raw_lines(s, path))
    return rows.groupBy(F.coalesce("problem", "channel").alias("channel")).agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum("seq"), F.lit(0)).alias("seq_sum"))


_CHANNEL = """CASE event_type WHEN 'purchase' THEN 'trades' WHEN 'signup' THEN CASE WHEN k < 70 THEN 'bbo' ELSE 'l2Book' END WHEN 'click' THEN CASE WHEN k < 50 THEN 'allMids' WHEN k % 2 = 0 THEN 'activeAssetCtx' ELSE 'activeSpotAssetCtx' END
  WHEN 'view' THEN 'candle' ELSE CASE k % 3 WHEN 0 THEN 'pong' WHEN 1 THEN 'userFills' ELSE 'l4Book' END END"""
register(
    "S1_read_raw",
    _raw_round_trip,
    ob.base(f"SELECT {_CHANNEL} AS channel, count(*) AS messages, CAST(sum(seq) AS BIGINT) AS seq_sum FROM ev GROUP BY 1 UNION ALL SELECT 'unreadable line', count(*), 0 FROM events WHERE event_type = 'error'"),
)


def typed(s, d):
    tables = wire.split_events(frames(s, d))
    tables.pop("rejects")
    return tables


def _totals(tables):
    """Rows and a checksum per typed table."""
    sums = {"trades": "notional", "quotes": "bid_price", "books": "exchange_ts_ms", "mids": "mid", "contexts": "day_ntl_vlm", "candles": "close"}
    out = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("rows"), (F.round(F.sum(sums[name]), 2) + 0).cast("double").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


_TOTALS = ob.base(f"""SELECT 'trades' AS kind, 2 * count(*) AS rows, round(2 * sum(px * (k % 9 + 1)), 2) AS total FROM ev WHERE {_TR}
UNION ALL SELECT 'quotes', count(*), round(sum(px * 0.999::DOUBLE), 2) FROM ev WHERE event_type = 'signup' AND k < 70 AND NOT (k = 60 AND seq % 5 <> 0)
UNION ALL SELECT 'books', count(*), CAST(sum(ms) AS DOUBLE) FROM ev WHERE event_type = 'signup' AND k >= 70
UNION ALL SELECT 'mids', 2 * count(*), round(3 * sum(px), 2) FROM ev WHERE event_type = 'click' AND k < 50
UNION ALL SELECT 'contexts', count(*), CAST(sum(k * 1000) AS DOUBLE) FROM ev WHERE event_type = 'click' AND k >= 50 AND k <> 63
UNION ALL SELECT 'candles', count(*), round(sum(px), 2) FROM ev WHERE {_CANDLES}""")


def _normalized(s, d):
    path = scratch(s, "normalized")
    files.write_normalized(typed(s, d), path, "r1")
    _broken_lines(s, d).write.text(f"{path}/run=broken")
    return _with_rejects(files.read_normalized(s, path, fail=False))


def _with_rejects(tables):
    rejects = tables.pop("rejects")
    return _totals(tables).unionByName(rejects.agg(F.lit("rejects").alias("kind"), F.count(F.lit(1)).alias("rows"), F.lit(0.0).alias("total")))


_REJECTS = " UNION ALL SELECT 'rejects', count(*), 0.0::DOUBLE FROM events WHERE event_type = 'error'"
register("S2_read_normalized", _normalized, _TOTALS + _REJECTS)


def _exported(s, d):
    path = scratch(s, "events")
    files.export_events_parquet(typed(s, d), path)
    return path


def _export_read(s, d):
    """An export in which documents of a later version were appended."""
    path = _exported(s, d)
    later = _broken_lines(s, d).select(F.lit(-1).cast("long").alias("row_index"), F.lit("other").alias("event_type"), F.lit(0).cast("long").alias("recv_ts_ns"), F.lit(None).cast("string").alias("hl_coin"), F.col("value").alias("event_json"))
    later.write.mode("append").parquet(f"{path}/events")
    return _with_rejects(files.read_events_parquet(s, path, fail=False))


register("S3_read_events_parquet", _export_read, _TOTALS + _REJECTS)


def _answers(s, d):
    """REST answers, one per symbol: its candles of the tape; symbols with an odd number hold a bad candle or no array."""
    rows = wire.normalize_candles(decoded(s, d))
    candle = F.struct(
        F.col("open_ts_ms").alias("t"), F.col("close_ts_ms").alias("T"), F.col("symbol").alias("s"), F.col("interval").alias("i"), F.col("open").cast("string").alias("o"),
        F.col("close").cast("string").alias("c"), F.col("high").cast("string").alias("h"), F.col("low").cast("string").alias("l"), F.col("volume_base").cast("string").alias("v"), F.col("trade_count").alias("n"),
    )
    number = F.substring("symbol", 2, 9).cast("int")
    answers = rows.groupBy("symbol").agg(F.to_json(F.sort_array(F.collect_list(candle))).alias("json"))
    spoiled = F.when(number % 4 == 1, F.regexp_replace("json", r'"h":"[^"]*"', '"h":"0.000001"')).when(number % 4 == 3, F.lit("busy")).otherwise(F.col("json"))
    return answers.withColumn("json", spoiled)


def _rest(s, d):
    answers, now = _answers(s, d), views.now_ms(s, d)
    good = wire.candle_snapshot(answers, now).groupBy("symbol", "completion").agg(F.count(F.lit(1)).alias("candles"))
    bad = wire.rejected_responses(answers).select("symbol", F.col("problem").alias("completion"), F.lit(0).cast("long").alias("candles"))
    return good.unionByName(bad)


register(
    "S10_rest_candle_answers",
    _rest,
    ob.base(f"""SELECT symbol, CASE CAST(substr(symbol, 2) AS INT) % 4 WHEN 1 THEN 'invalid candle in the answer' WHEN 3 THEN 'unreadable answer'
        ELSE CASE WHEN ms // 60000 * 60000 + 59999 < (SELECT max(ms) FROM ev) THEN 'closed' ELSE 'open' END END AS completion,
      CASE WHEN CAST(substr(symbol, 2) AS INT) % 2 = 1 THEN 0 ELSE count(*) END AS candles
    FROM ev WHERE {_CANDLES} GROUP BY symbol, 2"""),
)


def _mismatches(s, d):
    """Answers checked against requests for the next symbol (ids divisible by three) or another interval (by five)."""
    rows = wire.normalize_candles(decoded(s, d))
    other = F.when(F.col("trade_count") % 3 == 0, F.lit("S99")).otherwise(F.col("symbol"))
    interval = F.when(F.col("trade_count") % 5 == 0, F.lit("5m")).otherwise(F.lit("1m"))
    checked = wire.validate_candle_response(rows, other, interval, F.lit(0), F.lit(views.first_ms(s, d)))
    return checked.groupBy(F.coalesce("problem", F.lit("ok")).alias("verdict")).agg(F.count(F.lit(1)).alias("candles"))


register(
    "S11_candle_response_mismatches",
    _mismatches,
    ob.base(f"""SELECT CASE WHEN (k + 1) % 3 = 0 THEN 'wrong coin' WHEN (k + 1) % 5 = 0 THEN 'wrong interval' WHEN ms // 60000 * 60000 > (SELECT min(ms) FROM ev) THEN 'outside the requested range' ELSE 'ok' END AS verdict,
      count(*) AS candles FROM ev WHERE {_CANDLES} GROUP BY 1"""),
)


def _inventory(s, d):
    """Candles written in one file per symbol, then inventoried."""
    path = scratch(s, "candles")
    views.candles(s, d).repartition("symbol").write.partitionBy("symbol").parquet(path)
    found = files.file_inventory(s.read.parquet(path), "open_ts_ms", "close_ts_ms")
    name = F.regexp_extract("path", "symbol=([^/]+)", 1)
    return found.filter("bytes > 0").select(name.alias("symbol"), "rows", "start_ts_ms", "end_ts_ms")


register(
    "S15_write_run",
    lambda s, d: _run_files(s, d),
    ob.base(f"SELECT 'r1' AS run, CAST(sum(CASE WHEN event_type = 'purchase' OR (event_type = 'click' AND k < 50) THEN 2 ELSE 1 END) AS BIGINT) AS lines FROM ev WHERE ({_TR}) OR (event_type = 'signup' AND k < 70 AND NOT (k = 60 AND seq % 5 <> 0)) OR (event_type = 'signup' AND k >= 70) OR (event_type = 'click' AND k <> 63) OR ({_CANDLES})"),
)


def _run_files(s, d):
    path = scratch(s, "run")
    files.write_normalized(typed(s, d), path, "r1")
    lines = s.read.text(path, recursiveFileLookup=True).select(F.regexp_extract("_metadata.file_path", "run=([^/]+)", 1).alias("run"))
    return lines.groupBy("run").agg(F.count(F.lit(1)).alias("lines"))


def _row_index(s, d):
    rows = s.read.parquet(f"{_exported(s, d)}/events")
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"), F.sum("row_index").alias("row_sum")
    )


register(
    "S16_export_events_parquet",
    _row_index,
    ob.base(f"""
    , d AS (
      SELECT ms, seq * 1048576 + o AS i, 'trade' AS t, 0 AS z FROM ev, (SELECT unnest([0, 1]) AS o) WHERE {_TR}
      UNION ALL SELECT ms, seq * 1048576, 'top_of_book', 0 FROM ev WHERE event_type = 'signup' AND k < 70 AND NOT (k = 60 AND seq % 5 <> 0)
      UNION ALL SELECT ms, seq * 1048576, 'order_book', 0 FROM ev WHERE event_type = 'signup' AND k >= 70
      UNION ALL SELECT ms, seq * 1048576, 'all_mids', o FROM ev, (SELECT unnest([0, 1]) AS o) WHERE event_type = 'click' AND k < 50
      UNION ALL SELECT ms, seq * 1048576, 'asset_context', 0 FROM ev WHERE event_type = 'click' AND k >= 50 AND k <> 63
      UNION ALL SELECT ms, seq * 1048576, 'candle', 0 FROM ev WHERE {_CANDLES})
    , n AS (SELECT t, row_number() OVER (ORDER BY ms, i, t, z) - 1 AS r FROM d)
    SELECT t AS event_type, count(*) AS rows, min(r) AS first_row, max(r) AS last_row, CAST(sum(r) AS BIGINT) AS row_sum FROM n GROUP BY 1"""),
)


def _features(s, d):
    path = scratch(s, "features")
    files.export_features_parquet(views.feature_table(s, d, "daily"), path)
    files.check_manifest(files.read_manifest(s, path), need="parquet_feature_schema_version")
    back = s.read.parquet(f"{path}/features")
    return back.select(
        "row_index", "snapshot_ts_ms", "symbol", "confidence_score", "confidence_level", "confidence_reasons_json",
        *rounded("price", "spread_bps", "momentum_score"), (F.get_json_object("snapshot_json", "$.symbol") == F.col("symbol")).alias("same"),
    )


register(
    "S17_export_features_parquet",
    _features,
    ob.daily(f"""SELECT row_number() OVER (ORDER BY now_ms, symbol) - 1 AS row_index, now_ms AS snapshot_ts_ms, symbol, CAST(confidence_score AS BIGINT) AS confidence_score, confidence_level,
      CASE WHEN len(reasons) = 0 THEN '[]' ELSE '["' || array_to_string(reasons, '","') || '"]' END AS confidence_reasons_json, {r6('price')} AS price, {r6('spread_bps')} AS spread_bps, {r6('momentum_score')} AS momentum_score, TRUE AS same FROM snap"""),
)
register(
    "S18_file_inventory",
    _inventory,
    ob.base("SELECT symbol, count(*) AS rows, min(open_ts) AS start_ts_ms, max(close_ts) AS end_ts_ms FROM cd GROUP BY 1"),
)


def _registry(s, d):
    """A run, its gaps and confidence registered, read back, and repeated inserts refused; a tape without silences has no gap to repeat, its run is always there."""
    from tapewright.errors import ContractError
    from tapewright.plans.q_run import silences
    from tapewright.sources.registry import SCHEMAS, Registry, verify_parity

    reg = Registry(s, scratch(s, "registry"))
    written = {"runs": s.createDataFrame([("r1", 0, 1, "h", "1", "g", True, True, True, 0)], SCHEMAS["runs"]), "data_gaps": silences(s, d)}
    for table, rows in written.items():
        reg.insert(table, rows)
    refused = 1
    for table in written:
        again = reg.read(table).limit(1)
        if again.isEmpty():
            continue
        try:
            reg.insert(table, again)
            refused = 0
        except ContractError:
            pass
    rows, at = views.feature_table(s, d, "now"), views.now_ms(s, d)
    reports = [verify_parity(reg, "r1", at, rows), verify_parity(reg, "r1", at, rows)]
    both = reports[0].unionByName(reports[1])
    return both.agg(
        F.count_if("baseline_written").alias("written"), F.count_if("matched").alias("matched"), F.lit(refused).alias("refused")
    ).withColumn("gaps", F.lit(reg.gaps("r1").count()).cast("long"))


register(
    "R4_registry_tables",
    _registry,
    ob.base(f""", p AS (SELECT ms - lag(ms) OVER (PARTITION BY symbol ORDER BY ms, seq) AS g FROM ev)
    SELECT CAST(1 AS BIGINT) AS written, CAST(2 AS BIGINT) AS matched, 1 AS refused, count(*) AS gaps FROM p WHERE g >= {8 * HOUR}"""),
)
