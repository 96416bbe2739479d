"""Wire decoding rejects, file round trips, manifests, digests, index weights, analogs, gaps."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tapewright.errors import ContractError
from tapewright.operators import analog, composite, gaps, metadata, replay
from tapewright.sources import files, wire


def frames(spark, docs):
    rows = [(d if isinstance(d, str) else json.dumps(d), 1, 1, i) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "value string, recv_ts_ns bigint, conn_id bigint, seq bigint")


TRADE = {"coin": "A", "side": "B", "px": "1.5", "sz": "2", "hash": "h", "time": 5, "tid": 7}
BOOK = {"coin": "A", "time": 1, "levels": [[{"px": "2", "sz": "1", "n": 1}, {"px": "1", "sz": "0", "n": 1}], [{"px": "3", "sz": "1", "n": 1}]]}


@pytest.mark.parametrize(
    "doc",
    [
        "not json",
        {"data": {}},
        {"channel": "userFills", "data": {}},
        {"channel": "mystery", "data": {}},
        {"channel": "trades", "data": [{**TRADE, "px": "NaN"}]},
        {"channel": "trades", "data": [TRADE, {**TRADE, "side": "?"}]},
        {"channel": "trades", "data": [{**TRADE, "time": -1}]},
        {"channel": "bbo", "data": {"coin": "A", "time": 1, "bbo": [{"px": "3", "sz": "1", "n": 1}, {"px": "2", "sz": "1", "n": 1}]}},
        {"channel": "l2Book", "data": {**BOOK, "levels": [BOOK["levels"][0][::-1], BOOK["levels"][1]]}},
        {"channel": "l2Book", "data": {**BOOK, "levels": [[{"px": "1", "sz": "1", "n": 1}] * 21, []]}},
        {"channel": "allMids", "data": {"mids": {"A": "1", "B": "0"}}},
        {"channel": "activeAssetCtx", "data": {"coin": "A", "ctx": {"markPx": "-1"}}},
        {"channel": "candle", "data": {"t": 5, "T": 1, "s": "A", "i": "1m", "o": 1, "c": 1, "h": 1, "l": 1, "v": 0, "n": 0}},
        {"channel": "candle", "data": [{"t": 1, "T": 5, "s": "A", "i": "1m", "o": 1, "c": 1, "h": 0.5, "l": 1, "v": 0, "n": 0}]},
    ],
)
def test_rejected_frames(spark, doc):
    parts = wire.split_events(frames(spark, [doc]))
    assert parts["rejects"].count() == 1
    assert all(df.count() == 0 for name, df in parts.items() if name != "rejects")


def test_accepted_frames(spark):
    docs = [
        {"channel": "trades", "data": [TRADE, {**TRADE, "side": "Sell", "tid": 8}]},
        {"channel": "bbo", "data": {"coin": "A", "time": 1, "bbo": [None, {"px": "2", "sz": "1", "n": 3}]}},
        {"channel": "l2Book", "data": BOOK},
        {"channel": "activeSpotAssetCtx", "data": {"coin": "A", "ctx": {"markPx": 0, "midPx": "", "dayNtlVlm": "7"}}},
        {"channel": "candle", "data": {"t": "1", "T": 5, "s": "A", "i": "1m", "o": "1", "c": 1, "h": 2, "l": 1, "v": "0", "n": 3}},
        {"channel": "pong"},
    ]
    parts = wire.split_events(frames(spark, docs))
    assert [(r.side, r.unique_trade_id) for r in parts["trades"].orderBy("tid").collect()] == [("buy", "A:5:7"), ("sell", "A:5:8")]
    quote = parts["quotes"].first()
    assert quote.bid_price is None and (quote.ask_price, quote.ask_order_count) == (2.0, 3)
    context = parts["contexts"].first()
    assert context.mark_px is None and context.mid_px is None and context.day_ntl_vlm == 7.0
    assert parts["candles"].first().high == 2.0 and parts["books"].first().bids[1].size == 0.0
    assert parts["rejects"].count() == 0


def test_round_trips_and_manifest(spark, tmp_path):
    capture = frames(spark, [{"channel": "trades", "data": [TRADE]}, {"channel": "l2Book", "data": BOOK}])
    files.write_raw(files.raw_from_frames(capture), f"{tmp_path}/raw", "r1")
    back = files.read_raw(spark, f"{tmp_path}/raw")
    assert {json.loads(r.value)["channel"] for r in back.collect()} == {"trades", "l2Book"}
    tables = wire.split_events(back)
    tables.pop("rejects")
    files.export_events_parquet(tables, f"{tmp_path}/ev")
    got = files.read_events_parquet(spark, f"{tmp_path}/ev")
    assert got["trades"].first().notional == 3.0 and got["trades"].first().side == "buy"
    with pytest.raises(Exception):
        files.export_events_parquet(tables, f"{tmp_path}/ev")
    files.write_manifest(spark, f"{tmp_path}/old", {**files.EVENT_MANIFEST, "manifest_version": 9})
    with pytest.raises(ContractError):
        files.read_events_parquet(spark, f"{tmp_path}/old")


def test_row_index_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(6)
    got = [r.row_index for r in files.with_row_index(df, ["k"]).orderBy("k").collect()]
    assert got == list(range(1000))


def test_digest_ignores_order_but_not_content(spark):
    a, b = spark.range(50).repartition(3), spark.range(50).orderBy(F.desc("id"))
    digest = lambda df: replay.dataset_digest(df).first().digest
    assert digest(a) == digest(b) != digest(spark.range(51))
    with pytest.raises(ContractError):
        replay.check_digest(a, "0" * 64)


def iterated_weights(liquidity):
    raw = {k: math.sqrt(v) for k, v in liquidity.items() if v > 0}
    cap, free, mass, out = max(0.1, 1 / len(raw)), set(raw), 1.0, {}
    while free:
        total = sum(raw[s] for s in free)
        over = [s for s in free if mass * raw[s] / total > cap + 1e-15]
        if not over:
            out |= {s: mass * raw[s] / total for s in free}
            break
        for s in over:
            free.discard(s)
            out[s] = cap
            mass = max(mass - cap, 0.0)
    whole = sum(out.values())
    return {k: v / whole for k, v in out.items()}


@pytest.mark.parametrize("shape", [lambda i: 1.0 + i, lambda i: 10.0**i, lambda i: 2.0 ** (i % 4) * (i + 1) ** 3])
@pytest.mark.parametrize("n", [3, 12, 30])
def test_capped_weights(spark, shape, n):
    liquidity = {f"S{i}": shape(i) for i in range(n)}
    df = spark.createDataFrame([*liquidity.items(), ("bad", -1.0), ("inf", float("inf"))], "symbol string, liquidity double")
    got = {r.symbol: r.weight for r in composite.capped_sqrt_weights(df).collect()}
    want = iterated_weights(liquidity)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_composite_chains(spark):
    rows = [("A", 0, 100.0, 110.0), ("B", 0, 100.0, 96.0), ("A", 60_000, 110.0, 110.0), ("B", 60_000, 96.0, 96.0)]
    df = spark.createDataFrame(
        [(s, "1m", o, o + 59_999, 1, p, max(p, c), min(p, c), c, 1.0, 1, o) for s, o, p, c in rows],
        "symbol string, interval string, open_ts_ms bigint, close_ts_ms bigint, recv_ts_ns bigint, open double, high double, low double, close double, volume_base double, trade_count bigint, ingest_seq bigint",
    )
    liquidity = spark.createDataFrame([("A", 1.0), ("B", 1.0)], "symbol string, liquidity double")
    got = composite.composite_index(df, liquidity, 4).orderBy("open_ts_ms").collect()
    assert [r.close for r in got] == pytest.approx([103.0, 103.0])
    assert (got[0].advances, got[0].declines, got[0].stale_symbols, got[0].coverage_state) == (1, 1, 2, "healthy")
    assert composite.composite_problems(composite.composite_index(df, liquidity, 4)).count() == 0


def candidate_rows(spark):
    rows = [(f"S{i % 4}", i, float(i % 7), (i % 5) / 5.0, None if i % 3 == 0 else float(i), None, 0.1 * i, 0.0 if i % 2 else 5.0, float(i % 9)) for i in range(60)]
    return spark.createDataFrame(rows, "symbol string, now_ms bigint, " + ", ".join(f"{f} double" for f in analog.FIELDS))


def test_many_targets_equal_single_searches(spark, monkeypatch):
    rows = candidate_rows(spark)
    targets = analog.latest_targets(rows)
    monkeypatch.setattr(analog, "TARGETS_PER_BLOCK", 3)
    many = analog.analog_search_many(rows, targets, k=5).collect()
    for t in targets.collect():
        single, report = analog.analog_search(rows, analog.latest_target(rows, t.symbol), limit=5)
        mine = sorted((r for r in many if r.target_symbol == t.symbol), key=lambda r: r["rank"])
        assert [(r.symbol, r.now_ms) for r in mine] == [(r.symbol, r.now_ms) for r in single.collect()]
        assert {r.candidate_count for r in mine} == {report["candidate_count"]}


def test_too_few_candidates(spark):
    rows = candidate_rows(spark)
    found, report = analog.analog_search(rows, analog.latest_target(rows, "S0"), min_candidates=1_000)
    assert found.count() == 0 and report["insufficient_evidence"].startswith("insufficient")


def test_exact_sample_clock(spark):
    times = [5, 90, 104, 105, 300, 305, 1_000]
    updates = spark.createDataFrame([(t,) for t in times], "ms bigint")
    assert analog.sample_clock(updates, 100, exact=True) == [5, 105, 300, 1_000]


def test_gaps_across_chunks(spark, tiny_chunks):
    rows = [("r", 1 if i < 20 else 2, (i + (100 if i >= 30 else 0)) * 10**9, i) for i in range(40)]
    found = gaps.detect_gaps(spark.createDataFrame(rows, "run_id string, conn_id bigint, recv_ts_ns bigint, seq bigint"), symbols=["A"])
    assert sorted((r.started_at_ns // 10**9, r.ended_at_ns // 10**9, r.conn_id) for r in found.collect()) == [(19, 20, 1), (29, 130, 2)]


def test_named_pair_and_unknown_token(spark):
    tokens = spark.createDataFrame([("PURR", 1, 0, 0, True, "x"), ("USDC", 0, 8, 8, True, "y")], "name string, index int, szDecimals int, weiDecimals int, isCanonical boolean, tokenId string")
    pairs = spark.createDataFrame([(0, "p", [1, 0], 0, True)], "position int, name string, tokens array<int>, index int, isCanonical boolean")
    assert metadata.checked_symbols(tokens, pairs).first().symbol == "PURR/USDC"
    broken = spark.createDataFrame([(0, "p", [1, 9], 0, True)], pairs.schema)
    with pytest.raises(ContractError):
        metadata.checked_symbols(tokens, broken)


def test_unusable_lines_fail_or_are_kept_as_rejects(spark, tmp_path):
    import zstandard

    good = json.dumps({"recv_ts_ns": 1, "conn_id": 2, "seq": 3, "channel": "trades", "payload": '{"channel": "trades"}'})
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.ndjson").write_text(good + "\n{half\n" + '{"seq": 4, "payload": "x"}\n')
    rows = files.parse_raw(files.raw_lines(spark, f"{tmp_path}/raw"))
    assert sorted(str(r.problem) for r in rows.collect()) == ["None", "no channel", "unreadable line"]
    with pytest.raises(Exception, match="unreadable line|no channel"):
        files.read_raw(spark, f"{tmp_path}/raw").collect()
    (tmp_path / "zst").mkdir()
    (tmp_path / "zst" / "b.ndjson.zst").write_bytes(zstandard.compress((good + "\n").encode() * 3))
    (tmp_path / "zst" / "c.ndjson").write_text(good + "\n")
    assert [r.seq for r in files.read_raw(spark, f"{tmp_path}/zst").collect()] == [3] * 4
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "d.txt").write_text('{"AllMids": {"recv_ts_ns": 5, "mids_by_hl_coin": {"A": 1.5}}}\n{"Future": {}}\nnothing\n')
    tables = files.read_normalized(spark, f"{tmp_path}/docs", fail=False)
    assert tables["mids"].count() == 1 and tables["rejects"].count() == 2
    with pytest.raises(Exception, match="unreadable document"):
        files.read_normalized(spark, f"{tmp_path}/docs")["mids"].collect()


def test_registry_reads_errors_as_errors(spark, tmp_path):
    from tapewright.sources.registry import Registry

    registry = Registry(spark, str(tmp_path))
    assert registry.read("runs").count() == 0
    run = spark.createDataFrame([("r1", 1, 2, "h", "v", "g", True, True, True, 0)], "run_id string, started_at_ms bigint, ended_at_ms bigint, config_hash string, app_version string, git_sha string, raw_enabled boolean, normalized_enabled boolean, clean_shutdown boolean, gap_count bigint")
    registry.insert("runs", run)
    file = spark.createDataFrame([("p1", "trade", None, 1, 2, 3, 4, 5, "r1"), ("p2", "trade", None, 1, 2, 3, 4, 5, "r1")], "path string, event_type string, symbol string, start_ts_ms bigint, end_ts_ms bigint, rows bigint, bytes bigint, created_at_ms bigint, run_id string")
    registry.insert("files", file)
    for table, rows in (("runs", run), ("files", file.withColumn("path", F.lit("same"))), ("files", file.filter("path = 'p2'"))):
        with pytest.raises(ContractError):
            registry.insert(table, rows)
    assert registry.read("runs").count() == 1 and [r.path for r in registry.files("r1").collect()] == ["p1", "p2"]
    (tmp_path / "symbols").mkdir()
    (tmp_path / "symbols" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        registry.read("symbols").collect()


def test_equal_times_emit_once_and_long_runs_stream(spark):
    from tapewright.operators import alerts

    schema = "playbook_id string, rule_id string, symbol string, at_ms bigint, cooldown_ms bigint"
    ties = spark.createDataFrame([("p", "r", "A", 5, 100), ("p", "r", "A", 5, 100), ("p", "r", "A", 105, 100), ("p", "r", "B", 5, 0), ("p", "r", "B", 5, 0)], schema)
    got = alerts.apply_cooldown(ties).groupBy("symbol", "cooldown_status").count().collect()
    assert {(r.symbol, r.cooldown_status): r["count"] for r in got} == {("A", "emitted"): 2, ("A", "suppressed"): 1, ("B", "emitted"): 2}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        run = spark.range(200_000).select(F.lit("p").alias("playbook_id"), F.lit("r").alias("rule_id"), F.lit("A").alias("symbol"), F.col("id").alias("at_ms"), F.lit(7).cast("long").alias("cooldown_ms"))
        seeds = spark.createDataFrame([("p", "r", "A", 3)], "playbook_id string, rule_id string, symbol string, last_emitted_ms bigint")
        out = alerts.apply_cooldown(run, seeds)
        assert out.filter("cooldown_status = 'emitted' AND at_ms % 7 <> 3").isEmpty()
        assert out.filter("cooldown_status = 'emitted'").count() == (200_000 - 10 + 6) // 7
        assert out.filter("at_ms < 10").agg(F.max("cooldown_remaining_ms")).first()[0] == 7
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_of_two_registry_writers_one_is_refused(spark, tmp_path, monkeypatch):
    from tapewright.errors import ContractError
    from tapewright.sources.registry import SCHEMAS, Registry

    def symbol(name):
        return spark.createDataFrame([(name, name, 0, 1)], SCHEMAS["symbols"])

    one, two = Registry(spark, str(tmp_path)), Registry(spark, str(tmp_path))
    one.insert("symbols", symbol("A"))
    claim = Registry._claim

    def late(self, table, number):
        """The other writer commits between this writer's check and its claim."""
        monkeypatch.setattr(Registry, "_claim", claim)
        two.insert("symbols", symbol("B"))
        return claim(self, table, number)

    monkeypatch.setattr(Registry, "_claim", late)
    with pytest.raises(ContractError, match="another writer"):
        one.insert("symbols", symbol("B"))
    assert sorted(r.symbol for r in one.read("symbols").collect()) == ["A", "B"]
    assert one._claim("symbols", 3)  # a writer that dies before its rows are in place
    with pytest.raises(ContractError, match="under way"):
        two.insert("symbols", symbol("C"))
    two.abandon("symbols")
    two.insert("symbols", symbol("C"))
    assert one.read("symbols").count() == 3


def test_plain_captures_whose_names_end_like_packed_ones(spark, tmp_path):
    import zstandard

    for name in ("a.json", "frozenzst", "zst", "t", "best", "part.txt"):
        (tmp_path / name).write_text(f"{name}\n")
    (tmp_path / "b.zst").write_bytes(zstandard.ZstdCompressor().compress(b"packed\n"))
    lines = sorted(r.value for r in files.raw_lines(spark, str(tmp_path)).collect())
    assert lines == sorted(["a.json", "frozenzst", "zst", "t", "best", "part.txt", "packed"])


def counted(spark, df, column):
    """The table with a counter of how often its rows were computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(count, "string").asNondeterministic()(column)), seen


def test_frames_and_documents_are_decoded_once(spark, tmp_path):
    mids = [{"channel": "allMids", "data": {"mids": {"A": str(i + 1)}}} for i in range(20)]
    rows, seen = counted(spark, frames(spark, [*mids, {"channel": "trades", "data": "broken"}]), "value")
    tables = wire.split_events(rows)
    rejects = tables.pop("rejects").collect()
    assert [json.loads(r.value)["channel"] for r in rejects] == ["trades"]
    files.export_events_parquet(tables, f"{tmp_path}/ev")
    assert seen.value == 21
    back = files.read_events_parquet(spark, f"{tmp_path}/ev", fail=False)
    assert sorted(r.mid for r in back["mids"].collect()) == [float(i + 1) for i in range(20)]
    assert all("from_json" not in t._jdf.queryExecution().toString() for t in back.values())


def test_a_bad_document_ends_the_reading_of_every_table(spark, tmp_path):
    rows = spark.createDataFrame([(0, "all_mids", 5, None, '{"AllMids": {"recv_ts_ns": 5, "mids_by_hl_coin": {"A": 1.5}}}'), (1, "x", 5, None, "nothing")],
                                 "row_index long, event_type string, recv_ts_ns long, hl_coin string, event_json string")
    rows.write.parquet(f"{tmp_path}/ev/events")
    files.write_manifest(spark, f"{tmp_path}/ev", files.EVENT_MANIFEST)
    with pytest.raises(Exception, match="unreadable document: nothing"):
        files.read_events_parquet(spark, f"{tmp_path}/ev")["mids"].collect()
    tables = files.read_events_parquet(spark, f"{tmp_path}/ev", fail=False)
    assert tables["mids"].count() == 1 and [r.line for r in tables["rejects"].collect()] == ["nothing"]


def test_lines_are_numbered_without_a_sort(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "with_row_index", lambda *a: pytest.fail("all lines were sorted"))
    (tmp_path / "docs").mkdir()
    for name, count in (("b", 300), ("a", 200), ("c", 1)):
        lines = [json.dumps({"AllMids": {"recv_ts_ns": i, "mids_by_hl_coin": {name: i + 1.0}}}) for i in range(count)]
        (tmp_path / "docs" / f"{name}.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several blocks a file
    try:
        rows = files.read_normalized(spark, f"{tmp_path}/docs")["mids"].orderBy("ingest_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.ingest_seq for r in rows] == list(range(501))
    assert [(r.symbol, r.mid) for r in rows] == [(n, i + 1.0) for n, c in (("a", 200), ("b", 300), ("c", 1)) for i in range(c)]
