"""Registered queries: streams replayed from files, compared with SQL over the same tables."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tapewright.operators import alerts
from tapewright.plans import oracle_base as ob
from tapewright.plans import registry, views
from tapewright.plans.frames import frames
from tapewright.plans.oracle_base import DAY, HOUR, r6
from tapewright.plans.q_run import _MATCHES, PLAYBOOK
from tapewright.plans.q_sources import _TOTALS, _broken_lines, _totals, scratch
from tapewright.plans.q_state import _BOOK_SQL, _CU
from tapewright.plans.registry import register, rounded
from tapewright.plans.views import SCALED
from tapewright.session import cut_lineage
from tapewright.sources import files, wire
from tapewright.streaming import ingest, state
from tapewright.streaming.market import StreamParams, market_events, market_state

_LOCK = threading.Lock()


#: Rows of one micro-batch and of one file: beyond them a stream has more micro-batches, not larger ones.
BATCH_ROWS = 2_000_000
FILE_ROWS = 250_000


def as_stream(s, df: DataFrame, name: str, order: str | None = None, parts: int = 3, batch_rows: int = BATCH_ROWS, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write a table as files and read them back as a stream of at least ``parts`` micro-batches of about ``batch_rows`` rows at most.

    Every micro-batch has the same number of files. With ``order`` they are written one after the other, so the stream delivers them in order.
    """
    path, rows = scratch(s, name), df.count()
    parts = max(parts, -(-rows // batch_rows))
    files_of = max(1, -(-rows // (parts * file_rows)))
    if order is None:
        df.repartition(parts * files_of).write.parquet(path)
    else:
        staged = scratch(s, f"{name}-parts")
        cuts = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], min(0.01, 0.1 / parts))))
        part = F.array_size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col(order))) if cuts else F.lit(0)
        df.withColumn("_part", part).write.partitionBy("_part").parquet(staged)
        written = s.read.schema(StructType([*df.schema.fields, StructField("_part", IntegerType())])).parquet(staged)
        for k in range(len(cuts) + 1):
            own = written.filter(F.col("_part") == k).drop("_part")
            (own.coalesce(1) if files_of == 1 else own.repartition(files_of)).write.mode("append").parquet(path)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", files_of).parquet(path)


def collected(s, stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all available files and read what it wrote, with the batch number."""
    path = scratch(s, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/b={batch_id}")

    with _LOCK:
        before = {k: s.conf.get(k, None) for k in state.STATE_STORE}
        try:
            for key, value in state.STATE_STORE.items():
                s.conf.set(key, value)
            query = (
                stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch(s, f"{name}-cp"))
                .trigger(availableNow=True).start()
            )
            query.awaitTermination()
        finally:
            for key, value in before.items():
                s.conf.set(key, value) if value is not None else s.conf.unset(key)
    return s.read.option("basePath", path).parquet(f"{path}/b=*").drop("b")


#: Frames of one capture file (one task, as gzip cannot be split) and files of one micro-batch at most.
CAPTURE_ROWS = 50_000
CAPTURE_FILES = 64


def _ingested(s, d):
    """Recorded capture, with lines that are no records among it, streamed into raw and typed tables; run once per session."""
    key = (s.sparkContext.applicationId, d, "ingested")
    if key not in views._TABLES:
        capture, out = scratch(s, "capture"), scratch(s, "ingest")
        files_of = max(3, -(-frames(s, d).count() // CAPTURE_ROWS))
        files.write_raw(files.raw_from_frames(frames(s, d)).repartition(files_of), capture, "r1")
        _broken_lines(s, d).repartition(max(1, files_of // 5)).write.mode("append").text(f"{capture}/run=r1")
        per_batch = min(CAPTURE_FILES, -(-files_of // 3))
        query = ingest.run_ingest(ingest.frame_stream(s, capture + "/run=r1", per_batch), out, scratch(s, "ingest-cp"), availableNow=True)
        query.awaitTermination()
        views._TABLES[key] = out
    out = views._TABLES[key]
    return {name: s.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}/batch=*") for name in wire.NORMALIZERS}


register(
    "S20_streaming_source",
    lambda s, d: _totals({name: df for name, df in _ingested(s, d).items() if name != "rejects"}),
    _TOTALS,
)
register(
    "S20_streaming_rejects",
    lambda s, d: _ingested(s, d)["rejects"].groupBy("problem").agg(F.count(F.lit(1)).alias("rows")),
    f"""SELECT problem, rows FROM ({registry.SQL["S4_split_events"]}) WHERE kind = 'rejects'
    UNION ALL SELECT 'unreadable line', count(*) FROM events WHERE event_type = 'error' HAVING count(*) > 0""",
)


def _published(s, d):
    values = ingest.latest_values(
        as_stream(s, views.trades(s, d), "trades"), as_stream(s, views.quotes_onesided(s, d).drop("k", "px"), "quotes")
    )
    path = scratch(s, "published")
    ingest.publish_latest(values, path, scratch(s, "published-cp"), compact_every=2, availableNow=True).awaitTermination()
    return ingest.read_published(s, path).select(
        "symbol", "last_update_ms", *rounded("last_trade_price", "bid_px", "bid_sz", "ask_px", "ask_sz")
    )


register(
    "S21_streaming_sink",
    _published,
    ob.base(f"""
    , t AS (SELECT symbol, arg_max(price, (ts, seq)) AS p, max(ts) AS tt FROM tr GROUP BY 1)
    , q AS (SELECT symbol, ts AS qt_ts, bid, bsz, ask, asz FROM qt QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) = 1)
    SELECT symbol, greatest(tt, qt_ts) AS last_update_ms, {r6('p')} AS last_trade_price, {r6('bid')} AS bid_px, {r6('bsz')} AS bid_sz, {r6('ask')} AS ask_px, {r6('asz')} AS ask_sz FROM t FULL JOIN q USING (symbol)"""),
)


def _state(s, d):
    """Final state per symbol of the tape with late copies, streamed in arrival order."""
    tape = as_stream(s, views.trades_dup(s, d), "tape", order="ingest_seq")
    rows = collected(s, state.symbol_state(tape, 7 * DAY, 3 * DAY, 10 * DAY), "update", "state")
    payload = [c for c in rows.columns if c not in ("symbol", "batch")]
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*payload), "batch").alias("w")).select("symbol", "w.*")


register(
    "D14_streaming_state",
    lambda s, d: _state(s, d).select("symbol", "last_update_ms", "duplicate_trade_count", "retained", *rounded("last_trade_price")),
    ob.base(f""", {ob.ACCEPTED}
    , a AS (SELECT symbol, CAST(sum(copies) AS BIGINT) AS duplicate_trade_count FROM acc GROUP BY 1)
    SELECT symbol, max(ts) AS last_update_ms, any_value(duplicate_trade_count) AS duplicate_trade_count, count(*) AS retained, {r6('arg_max(price, (ts, seq))')} AS last_trade_price
    FROM kept JOIN a USING (symbol) GROUP BY 1"""),
)
register(
    "F18_streaming_windows",
    lambda s, d: _state(s, d).select("symbol", *rounded("ret", "rv"), *rounded("flow", digits=3)),
    ob.base(f""", {ob.ACCEPTED}
    , l AS (SELECT *, max(ts) OVER (PARTITION BY symbol) AS n FROM kept)
    , w AS (SELECT symbol, price, row_number() OVER o AS rn, lag(price) OVER o AS p0 FROM l WHERE ts >= n - {7 * DAY} WINDOW o AS (PARTITION BY symbol ORDER BY ts, seq))
    , f AS (SELECT symbol, sum(CASE WHEN side = 'buy' THEN notional ELSE -notional END) AS flow FROM l WHERE ts >= n - {3 * DAY} GROUP BY 1)
    , r AS (SELECT symbol, CASE WHEN count(*) > 1 THEN arg_max(price, rn) / arg_min(price, rn) - 1 END AS ret, CASE WHEN count(*) < 3 THEN 0 ELSE stddev_pop((price - p0) / p0) END AS rv FROM w GROUP BY 1)
    SELECT symbol, {r6('ret')} AS ret, {r6('rv')} AS rv, round(flow, 3) + 0 AS flow FROM r JOIN f USING (symbol)"""),
)


STREAMED = StreamParams(SCALED, pane_ms=12 * HOUR, candles=None)


def _market(s, d):
    """Final state per symbol of all six streams, interleaved in arrival order; run once per session."""
    key = (s.sparkContext.applicationId, d, "streamed market")
    if key not in views._TABLES:
        events = market_events(
            trades=views.trades_dup(s, d), quotes=views.quotes_onesided(s, d), books=views.books(s, d), contexts=views.contexts(s, d),
            mids=views.mids(s, d), candles=views.candle_updates(s, d),
        )
        rows = collected(s, market_state(as_stream(s, events, "market", order="ingest_seq"), STREAMED), "update", "market")
        payload = [c for c in rows.columns if c not in ("symbol", "batch")]
        views._TABLES[key] = cut_lineage(rows.groupBy("symbol").agg(F.max_by(F.struct(*payload), "batch").alias("w")).select("symbol", "w.*"))
    return views._TABLES[key]


register(
    "D14_streaming_quotes",
    lambda s, d: _market(s, d).filter("quote_ts_ms IS NOT NULL").select("symbol", "quote_ts_ms", *rounded("bid_px", "bid_sz", "ask_px", "ask_sz")),
    registry.SQL["D4_latest_quote"],
)
register("D14_streaming_merged_mid", lambda s, d: _market(s, d).filter("mid_px IS NOT NULL").select("symbol", *rounded("mid_px")), registry.SQL["D7_merged_mid"])
register("D14_streaming_mids", lambda s, d: _market(s, d).filter("all_mids_px IS NOT NULL").select("symbol", *rounded("all_mids_px")), registry.SQL["D7_latest_mids"])
register(
    "D14_streaming_books",
    lambda s, d: _market(s, d).filter("book_ts_ms IS NOT NULL").select(
        "symbol", "book_ts_ms", F.expr("book_recv_ts_ns div 1000000").alias("book_recv_ms"),
        (F.round(F.get_json_object("book_levels", "$.bids[0].price").cast("double"), 6) + 0).alias("best_bid"),
    ),
    registry.SQL["D5_latest_book"],
)
register(
    "D14_streaming_contexts",
    lambda s, d: _market(s, d).filter("context_recv_ts_ns IS NOT NULL").select("symbol", *rounded("day_ntl_vlm", "prev_day_px", "mark_px", "context_mid_px")),
    registry.SQL["D6_latest_context"],
)
register(
    "D14_streaming_candles",
    lambda s, d: _market(s, d).filter("candles > 0").select("symbol", "candles", "closed_candles", "newest_open_ts_ms", *rounded("newest_close")),
    ob.base(f"""{_CU}
    , cl AS (SELECT *, EXISTS (SELECT 1 FROM cu x WHERE x.symbol = cw.symbol AND x.open_ts > cw.open_ts AND x.seq > cw.seq) AS closed FROM cw)
    SELECT symbol, count(*) AS candles, count(*) FILTER (closed) AS closed_candles, max(open_ts) AS newest_open_ts_ms, {r6('arg_max(close, open_ts)')} AS newest_close FROM cl GROUP BY 1"""),
)
register(
    "D14_streaming_clock",
    lambda s, d: _market(s, d).select("symbol", "last_update_ms"),
    ob.base(f"""{_BOOK_SQL}{_CU}
    SELECT symbol, max(ms) AS last_update_ms FROM (
      SELECT symbol, ts AS ms FROM trd UNION ALL SELECT symbol, ts FROM qt UNION ALL SELECT symbol, ts FROM cx UNION ALL SELECT symbol, ts FROM md
      UNION ALL SELECT symbol, open_ts + {6 * HOUR - 1} FROM cu
      UNION ALL SELECT symbol, ts FROM (SELECT *, max(recv) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS newest FROM bk) WHERE recv = newest)
    GROUP BY 1"""),
)

# Windows end at the newest trade or quote of each symbol.
_NOW = f""", {ob.ACCEPTED}
    , nw AS (SELECT symbol, max(ts) AS now_ms FROM (SELECT symbol, ts FROM trd UNION ALL SELECT symbol, ts FROM qt) GROUP BY 1)"""
_QUOTE_SQL = ob.FEATURES[ob.FEATURES.index("qwin AS (") : ob.FEATURES.index("mu AS (")].strip().rstrip(",")
_FROM_QUOTES = f"{_NOW}, qseen AS (SELECT q.*, now_ms FROM qt q JOIN nw USING (symbol)), {_QUOTE_SQL}"
register(
    "F18_streaming_imbalance",
    lambda s, d: _market(s, d).filter("quote_ts_ms IS NOT NULL").select("symbol", "now_ms", *rounded("bbo_ofi_proxy_30s", digits=3)),
    ob.base(f"{_FROM_QUOTES} SELECT symbol, now_ms, round(ofi, 3) + 0 AS bbo_ofi_proxy_30s FROM nw LEFT JOIN ofi USING (symbol, now_ms) WHERE symbol IN (SELECT symbol FROM qt)"),
)
register(
    "F18_streaming_resilience",
    lambda s, d: _market(s, d).select("symbol", "spread_recovery_ms", "resilience_state", *rounded("spread_shock_bps")),
    ob.base(f"""{_FROM_QUOTES}
    SELECT symbol, spread_recovery_ms, coalesce(resilience_state, 'unknown') AS resilience_state, {r6('spread_shock_bps')} AS spread_shock_bps FROM nw LEFT JOIN shock USING (symbol, now_ms)"""),
)
_Z = "CASE WHEN count(*) >= 3 AND stddev_pop({0}) FILTER (open_ts < last) > 0 THEN (max({0}) FILTER (open_ts = last) - avg({0}) FILTER (open_ts < last)) / stddev_pop({0}) FILTER (open_ts < last) ELSE 0 END"
register(
    "F18_streaming_candle_z",
    lambda s, d: _market(s, d).filter("candles > 0").select("symbol", *rounded("volume_z_1h", "trade_count_z_1h")),
    ob.base(f"""{_CU}
    , z AS (SELECT *, max(open_ts) OVER (PARTITION BY symbol) AS last FROM cw)
    SELECT symbol, {r6(_Z.format('volume_base'))} AS volume_z_1h, {r6(_Z.format('trade_count'))} AS trade_count_z_1h FROM z GROUP BY 1"""),
)
register(
    "F18_streaming_returns",
    lambda s, d: _market(s, d).filter("last_trade_ts_ms IS NOT NULL").select(
        "symbol", "now_ms", *rounded("ret_1m", "ret_5m", "ret_1h", "rv_1m", "rv_5m", "rv_1h"), *rounded("signed_notional_flow_30s", digits=3)
    ),
    ob.base(f"""{_NOW}, seen AS (SELECT t.*, now_ms FROM kept t JOIN nw USING (symbol)), {ob._window('1m', 6 * HOUR)}, {ob._window('5m', DAY)}, {ob._window('1h', 7 * DAY)}
    , flow AS (SELECT symbol, now_ms, sum(CASE WHEN side = 'buy' THEN notional ELSE -notional END) AS flow FROM seen WHERE ts >= now_ms - {3 * DAY} GROUP BY 1, 2)
    SELECT symbol, now_ms, {', '.join(f'{r6(f"a_{w}.ret")} AS ret_{w}, {r6(f"coalesce(a_{w}.rv, 0)")} AS rv_{w}' for w in ('1m', '5m', '1h'))}, round(flow, 3) + 0 AS signed_notional_flow_30s
    FROM nw LEFT JOIN a_1m USING (symbol, now_ms) LEFT JOIN a_5m USING (symbol, now_ms) LEFT JOIN a_1h USING (symbol, now_ms) LEFT JOIN flow USING (symbol, now_ms) WHERE symbol IN (SELECT symbol FROM kept)"""),
)


def _rolling(s, d):
    tape = as_stream(s, views.trades_dup(s, d), "rolling", order="exchange_ts_ms")
    rows = collected(s, ingest.rolling_flow(tape, "2 days", "1 day", "31 days"), "update", "rolling")
    payload = ["flow", "vwap", "trades"]
    last = rows.groupBy("symbol", "window_end_ms").agg(F.max_by(F.struct(*payload), "batch").alias("w"))
    return last.select("symbol", "window_end_ms", "w.trades", (F.round("w.flow", 3) + 0).alias("flow"), (F.round("w.vwap", 9) + 0).alias("vwap"))


register(
    "F18_streaming_sliding_flow",
    _rolling,
    ob.base(f"""
    , e AS (SELECT *, unnest([ts // {DAY} + 1, ts // {DAY} + 2]) * {DAY} AS window_end_ms FROM tr)
    SELECT symbol, window_end_ms, count(*) AS trades, round(sum(CASE WHEN side = 'buy' THEN notional ELSE -notional END), 3) + 0 AS flow, round(sum(price * size) / sum(size), 9) + 0 AS vwap FROM e GROUP BY 1, 2"""),
)


def _alerts(s, d):
    """Daily snapshots streamed in time order through the stateful cooldowns."""
    stream = as_stream(s, views.feature_table(s, d, "daily"), "snapshots", order="now_ms")
    return collected(s, state.stream_alerts(stream, PLAYBOOK), "append", "alerts").select(
        "rule_id", "symbol", "at_ms", "cooldown_status", "cooldown_remaining_ms"
    )


_SEEN = "(" + ", ".join(alerts.ALERT_FIELDS[c].replace("confidence.score", "confidence_score") for c in alerts.ALERT_FIELDS) + ")"
register(
    "A8_streaming_alerts",
    _alerts,
    ob.daily(f"""{_MATCHES}
    , ch AS (SELECT symbol, now_ms AS at_ms, lag({_SEEN}) OVER (PARTITION BY symbol ORDER BY now_ms) IS DISTINCT FROM {_SEEN} OR row_number() OVER (PARTITION BY symbol ORDER BY now_ms) = 1 AS moved FROM snap)
    , h2 AS (SELECT hits.* FROM hits JOIN ch USING (symbol, at_ms) WHERE moved)
    , em AS (
      SELECT rule_id, symbol, min(at_ms) AS e FROM h2 GROUP BY 1, 2
      UNION ALL
      SELECT rule_id, symbol, (SELECT min(at_ms) FROM h2 h WHERE h.rule_id = em.rule_id AND h.symbol = em.symbol AND h.at_ms >= em.e + h.cooldown_ms) AS e FROM em WHERE e IS NOT NULL)
    , m AS (SELECT h.*, (SELECT max(e) FROM em WHERE em.rule_id = h.rule_id AND em.symbol = h.symbol AND e <= h.at_ms) AS le FROM h2 h)
    SELECT rule_id, symbol, at_ms, CASE WHEN le = at_ms THEN 'emitted' ELSE 'suppressed' END AS cooldown_status,
      CASE WHEN le <> at_ms THEN cooldown_ms - (at_ms - le) END AS cooldown_remaining_ms FROM m""").replace("WITH ", "WITH RECURSIVE ", 1),
)
