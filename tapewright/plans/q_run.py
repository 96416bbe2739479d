"""Registered queries: alerts, analogs, gaps, replay, metadata, operations, annotations."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.errors import ContractError
from tapewright.operators import alerts, analog, annotate, gaps, metadata, ops, replay, state
from tapewright.plans import oracle_base as ob
from tapewright.plans import views
from tapewright.plans.oracle_base import DAY, HOUR, r6
from tapewright.plans.q_scores import daily, now
from tapewright.plans.registry import joined, register, rounded
from tapewright.session import checkpoint_dir, cut_lineage
from tapewright.sources.registry import SCHEMAS, registered_market

PLAYBOOK = {
    "schema_version": 1,
    "id": "watch",
    "description": "mixed rules",
    "rules": [
        {
            "id": "shock",
            "description": "",
            "severity": "critical",
            "condition": {"type": "spread_shock_and_low_confidence", "min_spread_shock_bps": 100.0, "max_confidence_score": 90},
            "cooldown_ms": 2 * DAY,
            "source_interval_ms": DAY,
            "action": "local_only",
        },
        {
            "id": "tree",
            "description": "",
            "severity": "watch",
            "condition": {
                "type": "any",
                "conditions": [
                    {
                        "type": "all",
                        "conditions": [
                            {"type": "field_threshold", "field": "tob_imbalance", "op": "gt", "value": 0.2},
                            {"type": "not", "condition": {"type": "field_threshold", "field": "spread_bps", "op": "gte", "value": 10.0}},
                        ],
                    },
                    {"type": "field_threshold", "field": "confidence_score", "op": "eq", "value": 100.0},
                ],
            },
            "cooldown_ms": 3 * DAY,
            "source_interval_ms": DAY,
            "action": "local_only",
        },
    ],
}
_NOT = "'not(condition matched false or unavailable)'"
_ALL = f"tob_imbalance > 0.2 AND NOT coalesce(spread_bps >= 10, FALSE)"
_MATCHES = f"""
, hits AS (
  SELECT 'shock' AS rule_id, symbol, now_ms AS at_ms, {2 * DAY} AS cooldown_ms, confidence_score,
    printf('spread shock %.1f bps with confidence %d (%s)', spread_shock_bps, confidence_score, confidence_level) AS reason
  FROM snap WHERE spread_shock_bps >= 100 AND confidence_score <= 90
  UNION ALL
  SELECT 'tree', symbol, now_ms, {3 * DAY}, confidence_score, 'any(' || CASE WHEN {_ALL} THEN printf('tob_imbalance %.4f > 0.2000; ', tob_imbalance) || {_NOT}
    ELSE printf('confidence_score %.4f == 100.0000', CAST(confidence_score AS DOUBLE)) END || ')'
  FROM snap WHERE ({_ALL}) OR confidence_score = 100)"""


def matches(s, d):
    return alerts.evaluate_alerts(daily(s, d), PLAYBOOK)


register(
    "A1_compile_condition",
    lambda s, d: daily(s, d).select("symbol", "now_ms", alerts.compile_condition(PLAYBOOK["rules"][1]["condition"])[0].alias("matched")),
    ob.daily(f"SELECT symbol, now_ms, coalesce({_ALL}, FALSE) OR confidence_score = 100 AS matched FROM snap"),
)
register(
    "A3_evaluate_alerts",
    lambda s, d: matches(s, d).select("rule_id", "symbol", "at_ms", "reason", "confidence_score"),
    ob.daily(f"{_MATCHES} SELECT rule_id, symbol, at_ms, reason, confidence_score FROM hits"),
)


def _cooldown_sql(seed: str) -> str:
    """Emissions by recursion: the first match that is due, then the first due after each emission."""
    sql = ob.daily(f"""{_MATCHES}, {seed}
    , em AS (
      SELECT rule_id, symbol, min(at_ms) AS e FROM hits LEFT JOIN seed USING (rule_id, symbol)
      WHERE last IS NULL OR greatest(at_ms - last, 0) >= cooldown_ms GROUP BY 1, 2
      UNION ALL
      SELECT rule_id, symbol, (SELECT min(at_ms) FROM hits h WHERE h.rule_id = em.rule_id AND h.symbol = em.symbol AND h.at_ms >= em.e + h.cooldown_ms) AS e
      FROM em WHERE e IS NOT NULL)
    , m AS (SELECT h.*, (SELECT max(e) FROM em WHERE em.rule_id = h.rule_id AND em.symbol = h.symbol AND e <= h.at_ms) AS le, last FROM hits h LEFT JOIN seed USING (rule_id, symbol))
    SELECT rule_id, symbol, at_ms, CASE WHEN le = at_ms THEN 'emitted' ELSE 'suppressed' END AS cooldown_status,
      CASE WHEN le IS DISTINCT FROM at_ms THEN cooldown_ms - greatest(at_ms - coalesce(le, last), 0) END AS cooldown_remaining_ms FROM m""")
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_COOL = ["rule_id", "symbol", "at_ms", "cooldown_status", "cooldown_remaining_ms"]
register(
    "A4_apply_cooldown",
    lambda s, d: alerts.apply_cooldown(matches(s, d)).select(*_COOL),
    _cooldown_sql("seed AS (SELECT rule_id, symbol, CAST(NULL AS BIGINT) AS last FROM hits WHERE FALSE)"),
)


def _seeded(s, d):
    """Cooldowns carried over from a history in which each key's first match was emitted."""
    rows = alerts.apply_cooldown(matches(s, d))
    first = Window.partitionBy(*alerts.KEY).orderBy("at_ms")
    early = rows.withColumn("_n", F.row_number().over(first)).filter("_n <= 1").withColumn("at_ms", F.col("at_ms") - HOUR)
    return alerts.seed_cooldowns(early)


_SEED = f"seed AS (SELECT rule_id, symbol, min(at_ms) - {HOUR} AS last FROM hits GROUP BY 1, 2)"
register(
    "A5_seed_cooldowns",
    lambda s, d: alerts.apply_cooldown(matches(s, d), _seeded(s, d)).select(*_COOL),
    _cooldown_sql(_SEED),
)


def _history(s, d):
    """Evaluated alerts appended in two runs, read back newest first."""
    path = f"{checkpoint_dir(s)}/alerts-{uuid.uuid4().hex}"
    rows = cut_lineage(alerts.apply_cooldown(matches(s, d)))
    for run in (0, 1):
        alerts.append_history(rows.filter(F.floor(F.col("at_ms") / DAY) % 2 == run), path)
    return alerts.alert_history(s.read.parquet(path), limit=25).select("rule_id", "symbol", "at_ms")


register(
    "A6_alert_history",
    _history,
    ob.daily(f"{_MATCHES} SELECT rule_id, symbol, at_ms FROM hits ORDER BY at_ms DESC, rule_id DESC, symbol DESC LIMIT 25"),
)

# --- analogs --------------------------------------------------------------------------------------


def _clock(s, d):
    updates = views.trades(s, d).select(F.col("exchange_ts_ms").alias("ms"))
    times = analog.sample_clock(updates, DAY)
    return s.range(times.count).select((F.col("id") * times.step_ms + times.start_ms).alias("sample_ms"))


register(
    "N1_sample_clock",
    _clock,
    ob.base(f"SELECT unnest(range(a, a + CAST(ceil((b - a) / {DAY}.0) AS BIGINT) * {DAY} + 1, {DAY})) AS sample_ms FROM (SELECT min(ts) AS a, max(ts) AS b FROM tr)"),
)
register(
    "N1_sample_clock_exact",
    lambda s, d: analog.exact_clock(views.trades_dup(s, d).select(F.col("exchange_ts_ms").alias("ms"), "ingest_seq"), 5 * HOUR),
    ob.base(f"""
    , rec AS (SELECT DISTINCT newest AS ms FROM (SELECT max(ts) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS newest FROM trd))
    , chain AS (SELECT min(ms) AS ms FROM rec UNION ALL SELECT (SELECT min(rec.ms) FROM rec WHERE rec.ms >= chain.ms + {5 * HOUR}) FROM chain WHERE ms IS NOT NULL)
    SELECT ms AS sample_ms FROM chain WHERE ms IS NOT NULL UNION SELECT max(ms) FROM rec""").replace("WITH ", "WITH RECURSIVE ", 1),
)
register(
    "N2_analog_candidates",
    lambda s, d: analog.candidates_from(daily(s, d)).select("symbol", "now_ms", *rounded("momentum_score", "tob_imbalance")),
    ob.daily(f"SELECT symbol, now_ms, {r6('momentum_score')} AS momentum_score, {r6('tob_imbalance')} AS tob_imbalance FROM snap"),
)
_DIMS = ", ".join(
    f"CASE WHEN t.{f} IS NOT NULL AND c.{f} IS NOT NULL"
    + (f" AND NOT (abs(t.{f}) <= 2.220446049250313e-16 AND abs(c.{f}) <= 2.220446049250313e-16)" if f in analog.SCORE_FIELDS else "")
    + f" THEN struct_pack(k := -abs(t.{f} - c.{f}) / {scale}, f := '{f}') END"
    for f, scale in analog.FIELDS.items()
)
_PAIRS = f"""
, cand AS (SELECT * FROM snap)
, tgt AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY now_ms DESC) = 1)
, pr AS (SELECT t.symbol AS target_symbol, t.now_ms AS target_ms, c.symbol, c.now_ms, list_sort(list_filter([{_DIMS}], lambda x: x IS NOT NULL)) AS d
   FROM tgt t JOIN cand c ON NOT (t.symbol = c.symbol AND t.now_ms = c.now_ms))
, sc AS (SELECT *, sqrt(list_sum(list_transform(d, lambda x: x.k * x.k)) / len(d)) AS distance FROM pr WHERE len(d) >= 3)"""


def candidates(s, d):
    return analog.candidates_from(daily(s, d))


def _target(s, d):
    rows = candidates(s, d)
    first = rows.agg(F.min("symbol")).first()[0]
    return rows, analog.latest_target(rows, first)


def _distance(s, d):
    rows, target = _target(s, d)
    return analog.analog_distance(rows, target).select("symbol", "now_ms", *rounded("distance"))


register(
    "N3_analog_distance",
    _distance,
    ob.daily(f"""{_PAIRS} SELECT symbol, now_ms, {r6('distance')} AS distance FROM sc WHERE target_symbol = (SELECT min(symbol) FROM cand)
    UNION ALL SELECT symbol, now_ms, 0.0::DOUBLE FROM tgt WHERE symbol = (SELECT min(symbol) FROM cand)"""),
)


def _search(s, d):
    rows, target = _target(s, d)
    return analog.analog_search(rows, target, limit=7)[0].select("symbol", "now_ms", *rounded("distance"))


register(
    "N4_analog_search",
    _search,
    ob.daily(f"{_PAIRS} SELECT symbol, now_ms, {r6('distance')} AS distance FROM sc WHERE target_symbol = (SELECT min(symbol) FROM cand) ORDER BY sc.distance, symbol, now_ms LIMIT 7"),
)


def _drivers(s, d):
    rows, target = _target(s, d)
    found = analog.analog_search(rows, target, limit=7)[0]
    return found.select("symbol", "now_ms", F.array_join("drivers.field", ",").alias("drivers"))


register(
    "N5_analog_drivers",
    _drivers,
    ob.daily(f"{_PAIRS} SELECT symbol, now_ms, array_to_string(list_transform(d[1:3], lambda x: x.f), ',') AS drivers FROM sc WHERE target_symbol = (SELECT min(symbol) FROM cand) ORDER BY sc.distance, symbol, now_ms LIMIT 7"),
)
register(
    "N6_analog_search_many",
    lambda s, d: analog.analog_search_many(candidates(s, d), analog.latest_targets(candidates(s, d)), k=4).select(
        "target_symbol", "target_ms", "symbol", "now_ms", "rank", "candidate_count", *rounded("distance")
    ),
    ob.daily(f"""{_PAIRS} SELECT target_symbol, target_ms, symbol, now_ms, CAST(row_number() OVER (PARTITION BY target_symbol ORDER BY distance, symbol, now_ms) AS INTEGER) AS rank,
      count(*) OVER (PARTITION BY target_symbol) AS candidate_count, {r6('distance')} AS distance FROM sc
      QUALIFY row_number() OVER (PARTITION BY target_symbol ORDER BY sc.distance, symbol, now_ms) <= 4"""),
)


def _indexed(s, d):
    """Write the candidates as an index, read it back, search its own target."""
    rows = candidates(s, d)
    symbol = rows.agg(F.max("symbol")).first()[0]
    path = f"{checkpoint_dir(s)}/index-{uuid.uuid4().hex}"
    analog.write_index(rows, path, "driver-tables", symbol)
    table, manifest = analog.read_index(s, path)
    found = analog.analog_search(table, analog.latest_target(table, manifest["target_symbol"]), limit=5)[0]
    return found.select("symbol", "now_ms", *rounded("distance"))


register(
    "N7_analog_index",
    _indexed,
    ob.daily(f"{_PAIRS} SELECT symbol, now_ms, {r6('distance')} AS distance FROM sc WHERE target_symbol = (SELECT max(symbol) FROM cand) ORDER BY sc.distance, symbol, now_ms LIMIT 5"),
)

# --- gaps -----------------------------------------------------------------------------------------


def messages(s, d):
    """Every event as a received message; the event type plays the connection."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = views.read(s, d, "events")
    return rows.select(
        F.lit("r1").alias("run_id"),
        views.symbol_of_user(),
        F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")).alias("conn_id"),
        (views.epoch_ms("ts") * 1_000_000).alias("recv_ts_ns"),
        F.col("event_id").alias("seq"),
    )


SILENCE = 8 * HOUR * 1_000_000


def silences(s, d):
    """Silence per symbol, one connection; a gap counts as recovered when it lasted over 10 hours."""
    rows = messages(s, d).withColumn("conn_id", F.lit(1).cast("long"))
    found = gaps.detect_gaps(rows, SILENCE, per_symbol=True)
    return found.withColumn("recovered", F.col("ended_at_ns") - F.col("started_at_ns") > F.lit(10 * HOUR * 1_000_000))


TRACKED = [f"S{k:02d}" for k in range(20)]
register(
    "G1_detect_gaps_by_connection",
    lambda s, d: gaps.detect_gaps(messages(s, d), 30 * 60 * 10**9, symbols=TRACKED).select(
        "gap_id", "conn_id", "started_at_ns", "ended_at_ns", "reason", joined("affected_symbols")
    ),
    ob.base("""
    , ms AS (SELECT ms * 1000000 AS t, seq, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS BIGINT) AS c FROM ev)
    , p AS (SELECT t, c, lag(t) OVER (ORDER BY t, seq) AS t0, lag(c) OVER (ORDER BY t, seq) AS c0 FROM ms)
    SELECT 'r1:' || c0 || ':' || t0 || ':' || t AS gap_id, c0 AS conn_id, t0 AS started_at_ns, t AS ended_at_ns,
      CASE WHEN c <> c0 THEN 'connection changed' ELSE 'no market-data event for 1800 seconds' END AS reason, '__TRACKED__' AS affected_symbols
    FROM p WHERE t0 IS NOT NULL AND (c <> c0 OR t - t0 >= 1800000000000)""".replace("__TRACKED__", ",".join(TRACKED))),
)
_GAPS = f"""
, p AS (SELECT symbol, ms * 1000000 AS t, lag(ms * 1000000) OVER (PARTITION BY symbol ORDER BY ms, seq) AS t0 FROM ev)
, gp AS (SELECT 'r1:1:' || t0 || ':' || t || ':' || symbol AS gap_id, symbol, t0 AS a, t AS b, t - t0 > {10 * HOUR * 1_000_000} AS recovered FROM p WHERE t - t0 >= {SILENCE})"""
register(
    "G1_detect_gaps_by_silence",
    lambda s, d: silences(s, d).select("gap_id", joined("affected_symbols"), "started_at_ns", "ended_at_ns", "recovered"),
    ob.base(f"{_GAPS} SELECT gap_id, symbol AS affected_symbols, a AS started_at_ns, b AS ended_at_ns, recovered FROM gp"),
)


def attempts(s, d):
    """Backfill attempts of the silence gaps from the 6h candles."""
    found = silences(s, d)
    none = s.createDataFrame([], "run_id string, gap_id string, source string, interval string")
    requests = gaps.pending_backfill(found, none, "8h").withColumn("interval", F.lit("6h"))
    rows = gaps.backfill_rows(requests, views.candles(s, d), DAY)
    return found, rows, gaps.backfill_attempts(found, rows, "6h", views.now_ms(s, d))


def _restored(s, d):
    """Attempts in which three or more candles count as a full restore."""
    found, _, tried = attempts(s, d)
    impact = F.when(F.col("rows_written") >= 3, "restored").otherwise(F.col("confidence_impact"))
    return found, tried.withColumn("confidence_impact", impact)


_OVER = "c.symbol = gp.symbol AND c.close_ts >= gp.a // 1000000 AND c.open_ts <= gp.b // 1000000"
_TRIED = f"{_GAPS}, att AS (SELECT gap_id, any_value(gp.symbol) AS symbol, count(c.open_ts) AS n FROM gp LEFT JOIN cd c ON {_OVER} WHERE NOT recovered GROUP BY 1)"
register(
    "G2_gap_symbols",
    lambda s, d: gaps.gap_symbols(*_restored(s, d)),
    ob.base(f"{_TRIED} SELECT DISTINCT symbol FROM att WHERE n < 3"),
)
register(
    "G3_pending_backfill",
    lambda s, d: gaps.pending_backfill(
        silences(s, d), attempts(s, d)[2].filter("rows_written >= 3").withColumn("interval", F.lit("1h")), "1h"
    ).select("gap_id", "symbol", "start_time_ms", "end_time_ms"),
    ob.base(f"{_TRIED} SELECT gap_id, gp.symbol AS symbol, a // 1000000 AS start_time_ms, b // 1000000 AS end_time_ms FROM gp JOIN att USING (gap_id) WHERE n < 3"),
)
register(
    "G4_backfill_from_candles",
    lambda s, d: attempts(s, d)[1].select("gap_id", "symbol", "open_ts_ms", *rounded("close")),
    ob.base(f"{_GAPS} SELECT gap_id, gp.symbol AS symbol, c.open_ts AS open_ts_ms, {r6('c.close')} AS close FROM gp JOIN cd c ON {_OVER} WHERE NOT recovered"),
)
register(
    "G5_backfill_summary",
    lambda s, d: gaps.backfill_summary(attempts(s, d)[2], runs=s.range(1).select(F.lit("r1").alias("run_id"))),
    ob.base(f"""{_TRIED} SELECT 'r1' AS run_id, count(*) AS gaps_examined, CAST(0 AS BIGINT) AS gaps_repaired, count(*) FILTER (n > 0) AS gaps_partially_repaired,
      count(*) FILTER (n = 0) AS gaps_unrepaired, CAST(sum(n) AS BIGINT) AS rows_written, CAST(0 AS BIGINT) AS requests_failed FROM att"""),
)

# --- replay ---------------------------------------------------------------------------------------


RUN_TABLES = {
    "trades": views.trades_dup, "quotes": views.quotes_onesided, "contexts": views.contexts, "mids": views.mids, "books": views.books, "candles": views.candles,
}


def _recorded(s, d):
    """A registry with one clean run: a file entry per stream, an open gap of the active symbols, a restored one of all; once per session."""
    from tapewright.sources.registry import Registry

    key = (s.sparkContext.applicationId, d, "recorded run")
    if key not in views._TABLES:
        root = f"{checkpoint_dir(s)}/run-{uuid.uuid4().hex}"
        reg, files_ = Registry(s, f"{root}/registry"), []
        for name, view in RUN_TABLES.items():
            view(s, d).drop("k", "px").write.parquet(f"{root}/{name}")
            size = s.read.parquet(f"{root}/{name}").count()
            files_.append((f"{root}/{name}", name, None, 0, 0, size, 0, 0, "r1"))
        reg.insert("runs", s.createDataFrame([("r1", 0, 1, "h", "1", "g", True, True, True, 2), ("r2", 0, None, "h", "1", "g", True, True, False, 0)], SCHEMAS["runs"]))
        reg.insert("files", s.createDataFrame(files_, SCHEMAS["files"]))
        gap = lambda name, symbols: symbols.agg(F.sort_array(F.collect_set("symbol")).alias("affected_symbols")).select(  # noqa: E731  a row per symbol
            F.lit(name).alias("gap_id"), F.lit("r1").alias("run_id"), F.lit(1).cast("long").alias("conn_id"), F.lit(1).cast("long").alias("started_at_ns"),
            F.lit(2).cast("long").alias("ended_at_ns"), F.lit("silence").alias("reason"), "affected_symbols", F.lit(False).alias("recovered"),
        )
        reg.insert("data_gaps", gap("g1", views.active_symbols(s, d)).unionByName(gap("g2", views.symbols(s, d))))
        reg.insert("backfill_attempts", s.createDataFrame([("a1", "r1", "g2", "public", "1m", 1, 2, 5, "repaired", 10, "restored"), ("a2", "r1", "g1", "public", "1m", 1, 2, 4, "unrepaired", 0, "degraded")], SCHEMAS["backfill_attempts"]))
        views._TABLES[key] = reg
    return views._TABLES[key]


def _replayed(s, d):
    """The registered run, all six streams, at its newest update."""
    snapshots, at = replay.replay(registered_market(_recorded(s, d), "r1", views.SCALED.retention_ms), None, views.OPTIONS)
    return snapshots.select("symbol", F.lit(at).alias("at_ms"), F.col("confidence.score").alias("score"), *rounded("price", "ret_1h", "volume_z_1h"))


register(
    "R1_replay",
    _replayed,
    ob.single(
        f"""SELECT symbol, now_ms AS at_ms, CAST(greatest(confidence_score - CASE WHEN symbol IN (SELECT symbol FROM act) THEN 35 ELSE 0 END, 0) AS INTEGER) AS score,
          {r6('price')} AS price, {r6('ret_1h')} AS ret_1h, {r6('volume_z_1h')} AS volume_z_1h FROM snap"""
    ).replace(
        ob.SINGLE_TIME,
        "act AS (SELECT symbol FROM ev GROUP BY 1 HAVING avg(px) > (SELECT avg(px) FROM ev)), times AS (SELECT max(x) AS now_ms FROM "
        "(SELECT max(ts) AS x FROM trd UNION ALL SELECT max(ts) FROM qt UNION ALL SELECT max(ts) FROM md UNION ALL SELECT max(ts) FROM cx UNION ALL SELECT max(close_ts) FROM cd))",
    ),
)


def _registered(s, d):
    """What the registry holds of the run, and that replays of an unclean or unknown run and a second writer are refused."""
    reg, refused = _recorded(s, d), 0
    for run in ("r2", "r3"):
        try:
            registered_market(reg, run, views.SCALED.retention_ms)
        except ContractError:
            refused += 1
    files_ = reg.files("r1").select(F.lit("files").alias("table"), F.col("event_type").alias("entry"), F.col("rows").alias("n"))
    gaps_ = reg.gaps("r1").select(F.lit("gaps"), "gap_id", F.size("affected_symbols").cast("long"))
    tried = reg.attempts("r1").select(F.lit("attempts"), "attempt_id", "rows_written")
    return files_.union(gaps_).union(tried).union(s.createDataFrame([("runs", "refused", refused)], "a string, b string, c long"))


register(
    "R4_registry_run",
    _registered,
    ob.base("""
    , act AS (SELECT symbol FROM ev GROUP BY 1 HAVING avg(px) > (SELECT avg(px) FROM ev))
    SELECT 'files' AS "table", 'trades' AS entry, count(*) AS n FROM trd UNION ALL SELECT 'files', 'quotes', count(*) FROM qt UNION ALL SELECT 'files', 'contexts', count(*) FROM cx
    UNION ALL SELECT 'files', 'mids', count(*) FROM md UNION ALL SELECT 'files', 'books', count(*) FROM qfull UNION ALL SELECT 'files', 'candles', count(*) FROM cd
    UNION ALL SELECT 'gaps', 'g1', count(*) FROM act UNION ALL SELECT 'gaps', 'g2', count(DISTINCT symbol) FROM ev
    UNION ALL SELECT 'attempts', 'a1', 10 UNION ALL SELECT 'attempts', 'a2', 0 UNION ALL SELECT 'runs', 'refused', 2"""),
)


def _two(s, d):
    rows, end = daily(s, d), views.daily_times(s, d).end_ms
    day = lambda ms: replay.confidence_of(rows.filter(F.col("now_ms") == ms))
    seen = views.active_symbols(s, d)
    return day(end - DAY), day(end).join(seen, "symbol", "left_semi")


_TWO = f"""
, e AS (SELECT max(now_ms) AS m FROM times)
, act AS (SELECT symbol FROM ev GROUP BY 1 HAVING avg(px) > (SELECT avg(px) FROM ev))
, b AS (SELECT symbol, confidence_score AS s, confidence_level AS l, reasons AS r FROM snap, e WHERE now_ms = m - {DAY})
, r AS (SELECT symbol, confidence_score AS s, confidence_level AS l, reasons AS r FROM snap, e WHERE now_ms = m AND symbol IN (SELECT symbol FROM act))
, df AS (
  SELECT coalesce(b.symbol, r.symbol) AS symbol, CASE WHEN b.symbol IS NULL THEN 'missing' WHEN r.symbol IS NULL THEN 'extra' ELSE 'drift' END AS kind,
    CASE WHEN b.symbol IS NULL THEN r.symbol || ': missing confidence baseline' WHEN r.symbol IS NULL THEN b.symbol || ': baseline has no replayed row'
      ELSE b.symbol || ': baseline score=' || b.s || ' level=' || b.l || ' reasons=[' || array_to_string(b.r, ',') || ']; replay score=' || r.s || ' level=' || r.l || ' reasons=[' || array_to_string(r.r, ',') || ']' END AS detail
  FROM b FULL JOIN r ON b.symbol = r.symbol WHERE (b.s, b.l, b.r) IS DISTINCT FROM (r.s, r.l, r.r))"""
register("R2_parity_diff", lambda s, d: replay.parity_diff(*_two(s, d)), ob.daily(f"{_TWO} SELECT symbol, kind, detail FROM df"))
register(
    "R2_parity_report",
    lambda s, d: replay.parity_report(*_two(s, d)),
    ob.daily(f"""{_TWO} SELECT count(*) FILTER (kind = 'drift') AS drift_count, count(*) FILTER (kind = 'missing') AS missing_count,
      count(*) FILTER (kind = 'extra') AS extra_count, count(*) = 0 AS matched FROM df"""),
)
register(
    "R3_dataset_digest",
    lambda s, d: replay.dataset_digest(views.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")),
    """WITH h AS (SELECT sha256('{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_returnflag":"' || l_returnflag || '","l_suppkey":' || l_suppkey || '}') AS h FROM lineitem),
    l AS (SELECT h, CAST('0x' || substr(h, 1, 15) AS BIGINT) AS a, CAST('0x' || substr(h, 16, 15) AS BIGINT) AS b, CAST('0x' || substr(h, 31, 15) AS BIGINT) AS c, CAST('0x' || substr(h, 46, 15) AS BIGINT) AS d FROM h)
    SELECT count(*) AS row_count, sha256(count(*) || ':' || sum(a) || ':' || sum(b) || ':' || sum(c) || ':' || sum(d)) AS digest FROM l""",
)

# --- metadata -------------------------------------------------------------------------------------


def _tokens(s, d):
    nation = views.read(s, d, "nation").select(
        F.col("n_nationkey").alias("index"), F.col("n_name").alias("name"), F.lit(2).alias("szDecimals"), F.lit(8).alias("weiDecimals"),
        (F.col("n_regionkey") < 3).alias("isCanonical"), F.concat(F.lit("0x"), F.col("n_nationkey")).alias("tokenId"),
    )
    region = views.read(s, d, "region").select(
        (F.col("r_regionkey") + 100).alias("index"), F.col("r_name").alias("name"), F.lit(2).alias("szDecimals"), F.lit(8).alias("weiDecimals"),
        F.lit(True).alias("isCanonical"), F.concat(F.lit("1x"), F.col("r_regionkey")).alias("tokenId"),
    )
    return nation.unionByName(region)


def _universe(s, d):
    places = views.read(s, d, "nation").select("n_nationkey", "n_regionkey")
    rows = views.read(s, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("s_suppkey").cast("int").alias("position"), F.col("s_name").alias("name"), F.array("n_nationkey", F.col("n_regionkey") + 100).alias("tokens"),
        F.col("s_suppkey").cast("int").alias("index"), (F.col("s_acctbal") > 0).alias("isCanonical"),
    )


_SYMBOLS = """WITH sy AS (SELECT s_suppkey, s_acctbal, n_nationkey, n_regionkey, n_name || '/' || r_name AS display_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
register(
    "E1_symbols_from_meta",
    lambda s, d: metadata.checked_symbols(_tokens(s, d), _universe(s, d)).select(
        "symbol", "display_name", "spot_index", "base_token_index", "quote_token_index", "is_canonical"
    ),
    f"{_SYMBOLS} SELECT '@' || s_suppkey AS symbol, display_name, CAST(s_suppkey AS INTEGER) AS spot_index, n_nationkey AS base_token_index, n_regionkey + 100 AS quote_token_index, s_acctbal > 0 AND n_regionkey < 3 AS is_canonical FROM sy",
)


def _contexts(s, d):
    rows = views.read(s, d, "supplier")
    text = lambda c: c.cast("string")
    return rows.select(
        F.col("s_suppkey").cast("int").alias("position"),
        F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("@"), F.col("s_suppkey"))).alias("coin"),
        text(F.col("s_acctbal")).alias("dayNtlVlm"), text(F.col("s_acctbal")).alias("prevDayPx"), text(F.col("s_suppkey")).alias("markPx"),
        F.lit(None).cast("string").alias("midPx"), text(F.col("s_suppkey") * 2).alias("circulatingSupply"),
    )


def _detail_json(s, d):
    """Token details documents of the nations, built from the orders' dates and balances."""
    cust = views.read(s, d, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("top"), F.count(F.lit(1)).alias("n"))
    rows = views.read(s, d, "nation").join(cust, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    doc = F.to_json(
        F.struct(
            F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 != 0, F.lower("n_name")).otherwise(" ").alias("deployer"),
            F.concat(F.lit("2024-03-0"), (F.col("n_regionkey") + 1).cast("string"), F.lit("T10:20:30.125")).alias("deployTime"),
            F.col("top").cast("string").alias("seededUsdc"), F.col("n").alias("maxSupply"), F.when(F.col("n_regionkey") == 1, F.col("n") / 8).alias("circulatingSupply"),
        )
    )
    return rows.select(F.concat(F.lit("0x"), F.col("n_nationkey")).alias("token_id"), doc.alias("json"))


_DETAIL = """, cu AS (SELECT c_nationkey, max(c_acctbal) AS top, count(*) AS n FROM customer GROUP BY 1)
, dt AS (SELECT n_nationkey, '0x' || n_nationkey AS token_id, n_name AS name, CASE WHEN n_nationkey % 4 <> 0 THEN lower(n_name) END AS deployer,
   epoch_us(TIMESTAMP '2024-03-01 10:20:30.125') // 1000 + n_regionkey * 86400000 AS deploy_time_ms, CASE WHEN top >= 0 THEN top END AS seeded_usdc, CAST(n AS DOUBLE) AS max_supply,
   CASE WHEN n_regionkey = 1 THEN n / 8 END AS circulating_supply FROM nation LEFT JOIN cu ON n_nationkey = c_nationkey)"""
_FETCHED = 1_710_000_000_000
_E2 = ["symbol", "metadata_source", "deploy_time_ms"]
register(
    "E2_market_contexts",
    lambda s, d: metadata.market_contexts(
        metadata.checked_symbols(_tokens(s, d), _universe(s, d)), _contexts(s, d), metadata.token_details(_detail_json(s, d)), _FETCHED, _FETCHED
    ).select(*_E2, joined("cohort_tags"), *rounded("day_ntl_vlm", "prev_day_px", "mark_px", "circulating_supply")),
    f"""{_SYMBOLS}{_DETAIL}
    , j AS (SELECT '@' || s_suppkey AS symbol, s_suppkey, s_acctbal AS v, s_suppkey % 3 <> 0 AS k, dt.*, {_FETCHED} - deploy_time_ms AS age FROM sy JOIN dt USING (n_nationkey))
    , c AS (SELECT *, coalesce(circulating_supply, CASE WHEN k THEN CAST(s_suppkey * 2 AS DOUBLE) END) AS circ FROM j)
    , t AS (SELECT *, list_filter([CASE WHEN seeded_usdc > 0 THEN 'fresh_liquidity' END, CASE WHEN circ / max_supply <= 0.25 THEN 'low_float' END, CASE WHEN age <= {14 * DAY} THEN 'new_listing' END], lambda x: x IS NOT NULL) AS kn FROM c)
    SELECT symbol, 'spotMetaAndAssetCtxs+tokenDetails' AS metadata_source, deploy_time_ms,
      array_to_string(list_concat(kn, CASE WHEN deployer IS NULL OR seeded_usdc IS NULL OR max_supply IS NULL OR circ IS NULL OR len(kn) = 0 THEN ['unknown_metadata'] ELSE [] END), ',') AS cohort_tags,
      CASE WHEN k AND v >= 0 THEN v END AS day_ntl_vlm, CASE WHEN k AND v > 0 THEN v END AS prev_day_px, CASE WHEN k AND s_suppkey > 0 THEN CAST(s_suppkey AS DOUBLE) END AS mark_px, {r6('circ')} AS circulating_supply FROM t""",
)
register(
    "E3_token_details",
    lambda s, d: metadata.token_details(_detail_json(s, d)),
    f"{_SYMBOLS}{_DETAIL} SELECT token_id, name, deployer, deploy_time_ms, seeded_usdc, max_supply, circulating_supply FROM dt",
)
_META = f"""WITH su AS (SELECT l_suppkey, epoch_us(min(l_shipdate)) // 1000 AS dep, sum(l_quantity) AS mx, sum(l_quantity) FILTER (l_linestatus = 'F') AS ci FROM lineitem GROUP BY 1),
mm AS (SELECT 'P' || s_suppkey AS symbol, n_name || '/' || r_name AS display_name, s_suppkey, dep, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS deployer, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS seeded_usdc, mx, ci,
  (SELECT min(dep) + {10 * DAY} FROM su) AS nw FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN su ON s_suppkey = l_suppkey),
m2 AS (SELECT *, greatest(nw - dep, 0) AS age, list_filter([CASE WHEN deployer IS NULL THEN 'deployer' END, CASE WHEN dep IS NULL THEN 'deploy_time_ms' END, CASE WHEN seeded_usdc IS NULL THEN 'seeded_usdc' END,
  CASE WHEN mx IS NULL THEN 'max_supply' END, CASE WHEN ci IS NULL THEN 'circulating_supply' END], lambda x: x IS NOT NULL) AS unk FROM mm),
m3 AS (SELECT *, list_filter([CASE WHEN seeded_usdc > 0 THEN 'fresh_liquidity' END, CASE WHEN ci / mx <= 0.25 THEN 'low_float' END, CASE WHEN age <= {14 * DAY} AND dep IS NOT NULL THEN 'new_listing' END], lambda x: x IS NOT NULL) AS kn FROM m2),
me AS (SELECT *, list_concat(kn, CASE WHEN len(unk) > 0 OR len(kn) = 0 THEN ['unknown_metadata'] ELSE [] END) AS tags FROM m3)"""


def enriched(s, d):
    inputs = views.metadata_inputs(s, d)
    at = inputs.agg(F.min("deploy_time_ms")).first()[0] + 10 * DAY
    return metadata.enrich_metadata(inputs, at, at)


register(
    "E4_enrich_metadata",
    lambda s, d: enriched(s, d).select("symbol", "display_name", "listing_age_ms", joined("cohort_tags"), joined("unknown_fields")),
    f"{_META} SELECT symbol, display_name, CASE WHEN dep IS NOT NULL THEN age END AS listing_age_ms, array_to_string(tags, ',') AS cohort_tags, array_to_string(unk, ',') AS unknown_fields FROM me",
)
register(
    "E5_attach_metadata",
    lambda s, d: metadata.attach_metadata(
        _shop_rows(s, d), enriched(s, d)
    ).select("symbol", F.col("metadata.feed_identifier").alias("feed"), F.array_join("metadata.cohort_tags", ",").alias("tags")),
    f"""{_META}, rows AS (SELECT DISTINCT symbol FROM (SELECT 'P' || l_suppkey AS symbol FROM lineitem UNION ALL SELECT n_name || '/' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey)),
    k AS (SELECT symbol AS key, s_suppkey, symbol AS feed, tags FROM me UNION ALL SELECT display_name, s_suppkey, symbol, tags FROM me),
    o AS (SELECT key, arg_max(feed, s_suppkey) AS feed, arg_max(tags, s_suppkey) AS tags FROM k GROUP BY 1)
    SELECT rows.symbol AS symbol, o.feed AS feed, array_to_string(o.tags, ',') AS tags FROM rows LEFT JOIN o ON rows.symbol = o.key""",
)


def _shop_rows(s, d):
    from tapewright.operators.scoring import METADATA_TYPE

    places = views.read(s, d, "nation").join(views.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = places.select(F.concat_ws("/", "n_name", "r_name").alias("symbol"))
    rows = views.lineitem_trades(s, d).select("symbol").unionByName(named).distinct()
    return rows.withColumn("metadata", F.lit(None).cast(METADATA_TYPE))


def _markets(s, d):
    volume = views.liquidity(s, d).withColumnRenamed("liquidity", "day_ntl_vlm")
    return views.metadata_inputs(s, d).join(volume, "symbol", "left")


register(
    "E6_select_universe",
    lambda s, d: metadata.select_universe(_markets(s, d), 15, exclude=["p3", "P17"]).select("symbol", "display_name", *rounded("day_ntl_vlm", digits=2)),
    f"""{_META} SELECT symbol, display_name, round(v, 2) + 0 AS day_ntl_vlm FROM me LEFT JOIN (SELECT l_suppkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey
    WHERE symbol NOT IN ('P3', 'P17') ORDER BY v DESC NULLS LAST, symbol LIMIT 15""",
)


def _cache(s, d):
    rows = enriched(s, d)
    newer = rows.filter(F.col("seeded_usdc").isNotNull()).withColumns(
        {"metadata_fetched_at_ms": F.col("metadata_fetched_at_ms") + 5, "deployer": F.lit("new")}
    )
    older = rows.withColumns({"metadata_fetched_at_ms": F.col("metadata_fetched_at_ms") - 5, "deployer": F.lit("old")})
    return metadata.metadata_cache(metadata.metadata_cache(rows, newer), older).select("symbol", "deployer", "spot_index")


register(
    "E7_metadata_cache",
    _cache,
    f"{_META} SELECT symbol, CASE WHEN seeded_usdc IS NOT NULL THEN 'new' ELSE deployer END AS deployer, CAST(s_suppkey AS INTEGER) AS spot_index FROM me",
)

# --- operations -----------------------------------------------------------------------------------

STATES = ["connected", "connecting", "stale", "ping_sent", "reconnecting", "disconnected"]


def _health_inputs(s, d):
    """One health row per supplier, its balance and key spread over the inputs."""
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    return views.read(s, d, "supplier").select(
        "s_suppkey", F.lit(True).alias("read_only"), F.lit(False).alias("wallet_enabled"), (k % 50 == 7).alias("trading_enabled"),
        F.get(F.array(*[F.lit(x) for x in STATES]), (k % 6).cast("int")).alias("connection_state"),
        F.lit(100).alias("writer_warn_at"), (k % 4 * 50).alias("writer_backlog"), F.when(k % 5 != 0, F.floor(F.abs(bal)) * 10).alias("last_message_age_ms"),
        F.floor(F.abs(bal) * 1.2).alias("lag_ms"), F.lit(0).cast("long").alias("gap_count"), (k % 3).alias("connection_gap_count"),
    )


register(
    "H1_health_status",
    lambda s, d: ops.health_status(_health_inputs(s, d)).select("s_suppkey", "status", F.array_join("degraded_reasons", ";").alias("reasons")),
    """WITH h AS (SELECT s_suppkey AS k, ['connected', 'connecting', 'stale', 'ping_sent', 'reconnecting', 'disconnected'][s_suppkey % 6 + 1] AS c, floor(abs(s_acctbal)) * 10 AS age, floor(abs(s_acctbal) * 1.2::DOUBLE) AS lag FROM supplier),
    r AS (SELECT *, list_filter([CASE WHEN k % 50 = 7 THEN 'read-only safety violation' END, CASE c WHEN 'disconnected' THEN 'connection disconnected' WHEN 'reconnecting' THEN 'connection reconnecting' WHEN 'stale' THEN 'connection stale' END,
      CASE WHEN k % 4 * 50 > 100 THEN 'writer backlog high' END, CASE WHEN k % 5 <> 0 AND age >= 60000 THEN 'stale inbound data' END, CASE WHEN lag >= 10000 THEN 'data lag high' END, CASE WHEN k % 3 > 0 THEN 'data gaps detected' END], lambda x: x IS NOT NULL) AS rs FROM h)
    SELECT k AS s_suppkey, array_to_string(rs, ';') AS reasons, CASE WHEN k % 50 = 7 OR c = 'disconnected' THEN 'interrupted' WHEN len(rs) > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM r""",
)


def _latency(s, d):
    k = F.col("o_orderkey") % 1000
    base = views.epoch_ms("o_orderdate")
    return views.read(s, d, "orders").select(
        "o_orderpriority", base.alias("exchange_ts_ms"), (base + k - 50).alias("recv_ts_ms"), (base + k * 2).alias("feature_done_ts_ms"), (base + k * 3 + 7).alias("render_done_ts_ms"),
    )


register(
    "H2_latency_percentiles",
    lambda s, d: ops.latency_percentiles(_latency(s, d), ["o_orderpriority"]),
    """SELECT o_orderpriority, count(*) AS samples, quantile_disc(greatest(o_orderkey % 1000 - 50, 0), 0.5) AS data_lag_ms_p50, quantile_disc(greatest(o_orderkey % 1000 - 50, 0), 0.95) AS data_lag_ms_p95,
      quantile_disc(o_orderkey % 1000 * 2, 0.95) AS feature_lag_ms_p95, quantile_disc(o_orderkey % 1000 * 3 + 7, 0.95) AS render_lag_ms_p95 FROM orders GROUP BY 1""",
)


def _telemetry(s, d):
    return views.read(s, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("reconnect_attempts"), F.count_if(F.col("value") > 100).alias("parser_drops"), F.floor(F.max("value")).alias("stale_duration_ms"),
        F.floor(F.min("value")).alias("unrepaired_gap_duration_ms"), F.when(F.col("event_type") > "p", F.floor(F.max("value") * 10)).alias("repair_latency_ms"),
    )


register(
    "H3_ops_metrics",
    lambda s, d: ops.ops_metrics(_telemetry(s, d), labels=["event_type"]).select(
        F.concat_ws("=", F.lit("event_type"), F.col("labels")["event_type"]).alias("labels"), "name", "kind", "value"
    ),
    """WITH a AS (SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) AS p, floor(max(value)) AS mx, floor(min(value)) AS mn, floor(max(value) * 10) AS r FROM events GROUP BY 1)
    SELECT 'event_type=' || event_type AS labels, 'market_reconnect_attempts_total' AS name, 'counter' AS kind, CAST(n AS DOUBLE) AS value FROM a
    UNION ALL SELECT 'event_type=' || event_type, 'market_parser_drops_total', 'counter', CAST(p AS DOUBLE) FROM a
    UNION ALL SELECT 'event_type=' || event_type, 'market_stale_duration_ms_total', 'counter', mx FROM a
    UNION ALL SELECT 'event_type=' || event_type, 'market_unrepaired_gap_duration_ms', 'gauge', mn FROM a
    UNION ALL SELECT 'event_type=' || event_type, 'market_repair_latency_ms', 'gauge', r FROM a WHERE event_type > 'p'""",
)


def _soak(s, d):
    rows = messages(s, d)
    rejects = rows.filter("conn_id = 2")
    return ops.soak_summary(rows, rows.filter("conn_id <> 2"), gaps.detect_gaps(rows.withColumn("conn_id", F.lit(1).cast("long")), 10 * 60 * 10**9), rejects)


register(
    "H4_soak_summary",
    _soak,
    ob.base("""
    , p AS (SELECT ms - lag(ms) OVER (ORDER BY ms, seq) AS g FROM ev)
    SELECT 'r1' AS run_id, count(*) AS messages, count(DISTINCT event_type) - 1 AS reconnects, count(*) FILTER (event_type <> 'error') AS events,
      count(DISTINCT symbol) FILTER (event_type <> 'error') AS symbols, (SELECT count(*) FROM p WHERE g >= 600000) AS gaps, count(*) FILTER (event_type = 'error') AS parser_drops FROM ev"""),
)

# --- annotations ----------------------------------------------------------------------------------


def notes(pdf: pd.DataFrame):
    """Example user function: a note per wide spread and one per strong imbalance."""
    for i, (symbol, spread, skew) in enumerate(zip(pdf["symbol"], pdf["spread_bps"], pdf["tob_imbalance"])):
        if spread > 10:
            yield i, symbol, "wide", f"spread above ten"
        if abs(skew) > 0.4:
            yield i, symbol, "wallet skew" if skew > 0.9 else "skew", "one-sided book"


_COLS = ["symbol", "spread_bps", "tob_imbalance"]
register(
    "U1_annotate_rows",
    lambda s, d: annotate.accepted_annotations(annotate.annotate_rows(daily(s, d), notes, _COLS)),
    ob.daily("""SELECT symbol, now_ms, 'wide' AS label, 'spread above ten' AS detail FROM snap WHERE spread_bps > 10 AND coalesce(tob_imbalance <= 0.9, TRUE)
    UNION ALL SELECT symbol, now_ms, 'skew', 'one-sided book' FROM snap WHERE abs(tob_imbalance) > 0.4 AND tob_imbalance <= 0.9"""),
)


def _freshness(s, d):
    rows, end = daily(s, d), views.daily_times(s, d).end_ms
    found = annotate.accepted_annotations(annotate.annotate_rows(rows.filter(F.col("spread_bps") > 20), notes, _COLS))
    return annotate.annotation_freshness(views.symbols(s, d), found, end, 3 * DAY)


register(
    "U2_annotation_freshness",
    _freshness,
    ob.daily(f"""
    , n AS (SELECT symbol, max(now_ms) AS at FROM snap WHERE spread_bps > 20 AND coalesce(tob_imbalance <= 0.9, TRUE) GROUP BY 1)
    SELECT sy.symbol AS symbol, n.at AS annotated_at_ms, CASE WHEN n.at IS NULL THEN 'unavailable' WHEN (SELECT max(now_ms) FROM times) - n.at <= {3 * DAY} THEN 'fresh' ELSE 'stale' END AS freshness
    FROM sy LEFT JOIN n ON sy.symbol = n.symbol"""),
)
