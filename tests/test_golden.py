"""Feature values against plain formulas: a feed, random windows, resilience, metrics, confidence."""

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tapewright.operators import features, metrics, scoring, state
from tapewright.operators.features import Market
from tapewright.sources import wire

TRADE = (
    "symbol string, recv_ts_ns bigint, exchange_ts_ms bigint, side string, price double, size double, notional double, "
    "hash string, tid bigint, unique_trade_id string, ingest_seq bigint"
)
QUOTE = (
    "symbol string, recv_ts_ns bigint, exchange_ts_ms bigint, bid_price double, bid_size double, ask_price double, "
    "ask_size double, ingest_seq bigint"
)
CANDLE = (
    "symbol string, interval string, open_ts_ms bigint, close_ts_ms bigint, recv_ts_ns bigint, open double, high double, "
    "low double, close double, volume_base double, trade_count bigint, provenance string, completion string, ingest_seq bigint"
)


def trades(spark, rows, symbol="A"):
    full = []
    for i, (ts, price, tid, *rest) in enumerate(rows):
        side, size = (rest + ["buy", 1.0][len(rest):]) if rest else ("buy", 1.0)
        full.append((symbol, ts * 10**6, ts, side, price, size, price * size, "h", tid, f"{symbol}:{ts}:{tid}", i))
    return spark.createDataFrame(full, TRADE)


def quotes(spark, rows, symbol="A"):
    return spark.createDataFrame(
        [(symbol, ts * 10**6, ts, b, bs, a, s, 1000 + i) for i, (ts, b, bs, a, s) in enumerate(rows)], QUOTE
    )


def candles(spark, rows, symbol="A"):
    full = [(symbol, "1m", o, o + 59_999, o * 10**6, 1.0, 1.0, 1.0, 1.0, v, n, "web_socket", "open", i) for i, (o, v, n) in enumerate(rows)]
    return spark.createDataFrame(full, CANDLE)


def one(spark, now, t=(), q=(), c=None, **extra):
    tape = trades(spark, list(t))
    accepted = state.dedup_trades(state.arrived_in_time(tape))
    market = Market(
        trades=state.keep_newest(accepted), quotes=quotes(spark, list(q)), candles=None if c is None else candles(spark, c),
        duplicates=state.duplicate_counts(accepted), **extra,
    )
    return features.snapshot(market, now).first()


NOON = 1_722_513_600_000
COIN = "WREN"


def message(channel, data):
    return {"channel": channel, "data": data}


def day_feed():
    """A small capture of our own making: one message of each kind and a second trade ninety seconds later."""
    bought = {"coin": COIN, "side": "B", "px": "8.25", "sz": "40", "hash": "0x1f", "time": NOON + 250, "tid": 901}
    sold = {"coin": COIN, "side": "A", "px": "8.58", "sz": "15", "hash": "0x2e", "time": NOON + 90_250, "tid": 902}
    touch = {"coin": COIN, "time": NOON + 1_000, "bbo": [{"px": "8.20", "sz": "500", "n": 7}, {"px": "8.30", "sz": "260", "n": 1}]}
    context = {"coin": COIN, "ctx": {"dayNtlVlm": 730_000.25, "prevDayPx": 8.0, "markPx": 8.4, "midPx": 8.41, "circulatingSupply": 12_000_000}}
    bar = {"t": NOON, "T": NOON + 59_999, "s": COIN, "i": "1m", "o": 8.2, "c": 8.25, "h": 8.31, "l": 8.19, "v": 640.0, "n": 17}
    return [
        message("candle", [bar]), message("activeAssetCtx", context), message("trades", [bought]),
        message("allMids", {"mids": {COIN: "8.26", "FINCH": "3.5"}}), message("bbo", touch), message("trades", [sold]),
    ]


def feed_market(spark, frames):
    rows = [(json.dumps(f), 0, i) for i, f in enumerate(frames)]
    parts = wire.split_events(spark.createDataFrame(rows, "value string, recv_ts_ns bigint, seq bigint"))
    assert parts["rejects"].count() == 0
    return Market(
        trades=state.dedup_trades(parts["trades"]), quotes=parts["quotes"], contexts=parts["contexts"], mids=parts["mids"],
        books=None, candles=parts["candles"], symbols=spark.createDataFrame([(COIN,)], "symbol string"),
    )


def test_feed_snapshot(spark):
    row = features.snapshot(feed_market(spark, day_feed()), NOON + 95_250).first()
    bid, ask = 8.20 * 500, 8.30 * 260
    gain = (8.58 - 8.25) / 8.25
    assert row.price == 8.58 and row.mark_px == 8.4 and row.day_ntl_vlm == 730_000.25
    assert row.mid_px == pytest.approx((8.20 + 8.30) / 2)
    assert row.spread_bps == pytest.approx(0.10 / 8.25 * 10_000)
    assert row.tob_depth_usd == pytest.approx(bid + ask)
    assert row.tob_imbalance == pytest.approx((bid - ask) / (bid + ask))
    assert row.ret_1m is None and row.ret_5m == pytest.approx(gain) and row.ret_1h == row.ret_5m
    assert [row.rv_1m, row.rv_5m, row.rv_1h, row.volume_z_1h, row.trade_count_z_1h] == [0.0] * 5
    assert row.signed_notional_flow_30s == pytest.approx(-8.58 * 15) and row.bbo_ofi_proxy_30s is None
    assert row.liquidity_score == pytest.approx((bid + ask) / 100)
    assert row.momentum_score == pytest.approx(50 + 100 * gain)
    assert row.mean_reversion_score == pytest.approx(50 - 100 * gain)
    assert row.updated_ms_ago == 5_000 and row.staleness_state == "fresh"
    assert row.resilience_state == row.tradeability_state == row.adverse_selection_proxy == "unknown"
    assert row.confidence.score == 100 and row.confidence.reasons == []
    assert row.score_breakdown.adjusted_total == row.score_breakdown.raw_total


def random_tape(seed, now, n, back_ms):
    """Trades at random times up to ``now``: (time, price, id, side, size), in order of time."""
    rng = random.Random(seed)
    times = sorted(rng.sample(range(now - back_ms, now), n))
    return [(t, round(rng.uniform(40, 60), 2), 10 + k, rng.choice(["buy", "sell"]), round(rng.uniform(0.5, 9), 1)) for k, t in enumerate(times)]


def steps(prices):
    return [(b - a) / a for a, b in zip(prices, prices[1:])]


def test_windows_and_candle_scores(spark):
    now = NOON
    tape = random_tape(11, now, 60, 1_500_000)
    rng = random.Random(12)
    bars = [(now - 60_000 * k, rng.uniform(50, 90), rng.randint(5, 40)) for k in range(12, -1, -1)]
    row = one(spark, now, tape, c=bars)
    for label, window in (("1m", 60_000), ("5m", 300_000), ("1h", 3_600_000)):
        prices = [x[1] for x in tape if x[0] >= now - window]
        assert row[f"ret_{label}"] == pytest.approx((prices[-1] - prices[0]) / prices[0])
        assert row[f"rv_{label}"] == pytest.approx(statistics.pstdev(steps(prices)))
    flow = sum((1 if x[3] == "buy" else -1) * x[1] * x[4] for x in tape if x[0] >= now - 30_000)
    assert row.signed_notional_flow_30s == pytest.approx(flow)
    for name, column in (("volume_z_1h", 1), ("trade_count_z_1h", 2)):
        earlier = [b[column] for b in bars[:-1]]
        assert row[name] == pytest.approx((bars[-1][column] - statistics.mean(earlier)) / statistics.pstdev(earlier))


def test_candles_received_later_are_not_seen(spark):
    bars = [(NOON - 60_000 * k, 10.0 + k * k % 7, 3 + k) for k in range(8, -1, -1)]
    early = one(spark, NOON - 150_000, c=bars)
    only = one(spark, NOON - 150_000, c=[b for b in bars if b[0] <= NOON - 150_000])
    assert early.volume_z_1h == only.volume_z_1h != one(spark, NOON, c=bars).volume_z_1h


def metric(row, name):
    return next(m for m in row.microstructure_metrics if m.name == name)


def touch_change(before, now, side):
    """Notional that joined the bid or left the ask between two quotes (time, bid, size, ask, size)."""
    p0, s0, p1, s1 = (*before[1:3], *now[1:3]) if side == "bid" else (*before[3:5], *now[3:5])
    better = p1 > p0 if side == "bid" else p1 < p0
    change = p1 * s1 if better else p1 * (s1 - s0) if p1 == p0 else -p0 * s0
    return change if side == "bid" else -change


@pytest.mark.parametrize("chunked", [False, True])
def test_research_metrics(spark, chunked):
    from tapewright.operators.ordered import ROWS_PER_CHUNK_CONF

    now = NOON
    tape = random_tape(21, now, 120, 320_000)
    rng = random.Random(22)
    touch = [(now - 29_000 + 700 * k, 49 + rng.randint(0, 3) / 4, rng.randint(1, 30), 51 - rng.randint(0, 3) / 4, rng.randint(1, 30)) for k in range(40)]
    touch = [tuple(map(float, q)) for q in touch]
    if chunked:
        spark.conf.set(ROWS_PER_CHUNK_CONF, "2")
    try:
        row = one(spark, now, tape, [(int(q[0]), *q[1:]) for q in touch])
    finally:
        spark.conf.unset(ROWS_PER_CHUNK_CONF)
    minute = [x for x in tape if x[0] >= now - 60_000]
    long = [x[1] for x in tape if x[0] >= now - 300_000]
    gain = (minute[-1][1] - minute[0][1]) / minute[0][1]
    traded = sum(x[1] * x[4] for x in minute)
    assert metric(row, "public_trade_vwap_1m").value == pytest.approx(traded / sum(x[4] for x in minute))
    assert metric(row, "public_trade_return_1m").value == pytest.approx(gain)
    assert metric(row, "amihud_1m").value == pytest.approx(abs(gain) / traded)
    moves = [b - a for a, b in zip(long, long[1:])]
    covariance = statistics.mean(a * b for a, b in zip(moves, moves[1:]))
    assert covariance < 0 and metric(row, "roll_effective_spread").value == pytest.approx(2 * math.sqrt(-covariance))
    rates = steps(long)
    assert metric(row, "bipower_variation_5m").value == pytest.approx(math.pi / 2 * sum(abs(a * b) for a, b in zip(rates, rates[1:])))
    imbalance = sum(touch_change(a, b, side) for a, b in zip(touch, touch[1:]) for side in ("bid", "ask"))
    assert metric(row, "bbo_ofi_proxy_30s").value == pytest.approx(imbalance)
    recent = [x for x in tape if x[0] >= now - 30_000]
    net = sum((1 if x[3] == "buy" else -1) * x[1] * x[4] for x in recent)
    assert metric(row, "signed_flow_toxicity_proxy_30s").value == pytest.approx(abs(net) / sum(x[1] * x[4] for x in recent))
    assert [m.name for m in row.microstructure_metrics] == metrics.NAMES


def test_metric_support_and_contract(spark):
    row = one(spark, NOON, random_tape(31, NOON, 9, 50_000))
    assert metric(row, "public_trade_vwap_1m").support == "canonical" and metric(row, "amihud_1m").support == "proxy"
    few = one(spark, NOON, random_tape(32, NOON, 2, 50_000))
    assert metric(few, "public_trade_vwap_1m").support == "unavailable" and metric(few, "public_trade_vwap_1m").value is None
    actual = spark.createDataFrame([("same", 7.5), ("off", 7.75), ("few", 2.0), ("odd", float("nan"))], "k string, value double")
    expected = spark.createDataFrame([("same", 7.5, 4), ("off", 7.5, 4), ("few", 2.0, 1), ("odd", 1.0, 9)], "k string, expected_value double, observations int")
    got = {r.k: r.verdict for r in metrics.validate_metric(actual, expected, metrics.CANONICAL_CONTRACTS[0], ["k"]).collect()}
    assert got == {"same": "ok", "off": "drift", "few": "insufficient", "odd": "not_finite"}


def spread_quotes(start, spreads, every_ms):
    """Quotes around 64 whose spreads (in basis points of the mid) are given."""
    return [(start + k * every_ms, 64 * (1 - w / 20_000), 6.0, 64 * (1 + w / 20_000), 8.0) for k, w in enumerate(spreads)]


def test_shock_that_recovers(spark):
    widths = [12.0, 9.0, 15.0, 140.0, 60.0, 14.0]
    row = one(spark, NOON + 15_000, random_tape(41, NOON + 15_000, 6, 9_000), spread_quotes(NOON, widths, 2_500))
    assert row.spread_shock_bps == pytest.approx(140 - statistics.median(widths[:3]))
    assert row.spread_recovery_ms == 2 * 2_500 and row.resilience_state == "normal"


@pytest.mark.parametrize(("tail", "label"), [([120.0], "recovering"), ([150.0], "shock"), ([150.0, 150.0, 150.0, 149.0, 149.0], "brittle")])
def test_shock_that_stays(spark, tail, label):
    widths = [10.0, 20.0, 30.0, 40.0, 150.0, *tail]
    now = NOON + 2_500 * len(widths)
    row = one(spark, now, q=spread_quotes(NOON, widths, 2_500))
    assert row.spread_shock_bps == pytest.approx(150 - 25.0) and row.spread_recovery_ms is None
    assert row.resilience_state == label


def test_shock_window_has_no_quote_limit(spark):
    widths = [10.0] * 20 + [500.0] + [10.0] * 700
    row = one(spark, NOON + 58_000, q=spread_quotes(NOON, widths, 80))
    assert row.spread_shock_bps == pytest.approx(490.0) and row.resilience_state == "normal"


def test_duplicate_trade_lowers_confidence(spark):
    now = 1_000_000
    row = one(spark, now, [(now - 20_000, 100.0, 1), (now - 20_000, 100.0, 1), (now - 10_000, 101.0, 2)])
    assert (row.confidence.score, row.confidence.level, row.confidence.reasons) == (90, "high", ["duplicate_events"])
    assert row.ret_1m == pytest.approx(0.01)


def test_sparse_and_gap_reasons(spark):
    gap = spark.createDataFrame([("A",)], "symbol string")
    row = one(spark, 100_000, [(1_000, 35.0, 1)], [(500, 34.9, 0.5, 35.4, 0.4)], gap_symbols=gap)
    assert row.confidence.reasons == ["reconnect_gap", "stale_quote", "sparse_trades", "incomplete_window"]
    assert row.confidence.score == 0 and row.confidence.level == "untrusted"
    assert row.incomplete_window_reason == "need at least two trades for return windows"


def test_fee_profile(spark):
    profile = scoring.FeeProfile("blended", 100, 400, 150, 2_000, 5_000, taker_fill_ratio_hundredths=5_000)
    assert profile.check().round_trip_cost_bps == pytest.approx(2 * (4 * 0.5 + 1 * 0.5) + 1.5)
    with pytest.raises(ValueError):
        scoring.FeeProfile("x", 1, 1, 1, 9, 5).check()
    with pytest.raises(ValueError):
        scoring.FeeProfile("Bad Name", 1, 1, 1, 1, 5).check()


def test_late_and_old_trades(spark, tiny_chunks):
    h = 3_600_000
    tape = trades(spark, [(10 * h, 1.0, 1), (10 * h - 100, 2.0, 2), (8 * h, 3.0, 3), (10 * h - 100, 2.0, 2), (11 * h, 4.0, 4), (10 * h + 5, 5.0, 5), (9 * h, 9.0, 6)])
    kept = {(r.tid, r.copies) for r in state.retain_recent(tape).collect()}
    assert kept == {(1, 0), (4, 0), (5, 0)}
    assert state.last_trade(tape).first().last_trade_price == 4.0
    counts = state.duplicate_counts(state.dedup_trades(state.arrived_in_time(tape))).first()
    assert counts.duplicate_trade_count == 1


def test_candle_completion(spark):
    rows = spark.createDataFrame(
        [("A", "1m", o, o + 59_999, r, 1.0, 1.0, 1.0, 1.0, float(r), 1, "web_socket", "open", i) for i, (o, r) in enumerate([(0, 5), (60_000, 6), (0, 9), (120_000, 7), (60_000, 3)])],
        CANDLE,
    )
    got = {r.open_ts_ms: (r.completion, r.volume_base) for r in state.upsert_candles(rows).collect()}
    assert got == {0: ("closed", 9.0), 60_000: ("closed", 6.0), 120_000: ("open", 7.0)}


def test_grid_equals_single_times(spark):
    t = [(1_000 * i, 100.0 + (i * 7 % 5), i) for i in range(1, 80)]
    q = [(1_500 * i, 99.0, 1.0 + i % 3, 99.0 + 0.1 * (i % 9 + 1), 2.0) for i in range(1, 60)]
    market = Market(trades=state.dedup_trades(trades(spark, t)), quotes=quotes(spark, q))
    times = features.DecisionTimes(20_000, 15_000, 5)
    cols = ["symbol", "now_ms", "price", "mid_px", "spread_bps", "spread_shock_bps", "resilience_state", "ret_1m", "rv_1m", "bbo_ofi_proxy_30s", "signed_notional_flow_30s", "updated_ms_ago"]
    many = {r.now_ms: r for r in features.snapshots_at(market, times).select(cols).collect()}
    for i in range(times.count):
        at = times.start_ms + i * times.step_ms
        past = Market(trades=market.trades.filter(F.col("exchange_ts_ms") <= at), quotes=market.quotes.filter(F.col("exchange_ts_ms") <= at))
        single = features.snapshot(past, at).select(cols).first()
        for c in cols:
            a, b = many[at][c], single[c]
            assert a == pytest.approx(b) if isinstance(b, float) else a == b
