"""Pane sums against whole windows, and the streamed market in small pieces against SQL."""

import os
import statistics

import numpy as np
import pytest

import __spark_entry__ as entry
from compare import compare, duck
from tapewright.plans import views
from tapewright.streaming import ingest
from tapewright.streaming.market import market_events
from tapewright.streaming.panes import QuoteSum, TradeSum, imbalance, resilience, spreads_of, weighted_median

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("cuts", [[], [1], [3, 3, 7], list(range(1, 20))])
def test_trade_sums_join(cuts):
    rng = np.random.default_rng(1)
    price, amount = rng.uniform(90, 110, 20), rng.normal(size=20)
    joined = TradeSum()
    for part in zip(np.split(price, cuts), np.split(amount, cuts)):
        joined = joined.then(TradeSum.of(*part))
    steps = np.diff(price) / price[:-1]
    assert joined.n == 20 and joined.pairs == 19
    assert joined.total_return == pytest.approx(price[-1] / price[0] - 1)
    assert joined.volatility == pytest.approx(statistics.pstdev(steps))
    assert joined.flow == pytest.approx(amount.sum())


def test_short_trade_windows():
    assert TradeSum().total_return is None and TradeSum().volatility == 0.0
    two = TradeSum.of(np.array([100.0]), np.array([1.0])).then(TradeSum.of(np.array([101.0]), np.array([-1.0])))
    assert two.total_return == pytest.approx(0.01) and two.volatility == 0.0 and two.flow == 0.0


def plain_resilience(ts, sides, brittle_after_ms):
    bps = spreads_of(sides[:, 0], sides[:, 2])
    rows = [(t, b) for t, b in zip(ts, bps) if not np.isnan(b)]
    if len(rows) < 2:
        return None, None, "unknown"
    at = max(range(len(rows)), key=lambda k: (rows[k][1], -k))
    if not at:
        return 0.0, None, "normal"
    base, top = statistics.median(b for _, b in rows[:at]), rows[at][1]
    if top - base < 25 or top < 2 * base:
        return 0.0, None, "normal"
    elapsed = rows[-1][0] - rows[at][0]
    if rows[-1][1] <= max(1.5 * base, base + 10):
        return top - base, elapsed, "normal"
    return top - base, None, "brittle" if elapsed > brittle_after_ms else "recovering" if rows[-1][1] < top else "shock"


def plain_imbalance(sides):
    total = 0.0
    for (b0, bs0, a0, as0), (b1, bs1, a1, as1) in zip(sides, sides[1:]):
        if not np.isnan(b0 + bs0 + b1 + bs1):
            total += b1 * bs1 if b1 > b0 else b1 * (bs1 - bs0) if b1 == b0 else -b0 * bs0
        if not np.isnan(a0 + as0 + a1 + as1):
            total -= a1 * as1 if a1 < a0 else a1 * (as1 - as0) if a1 == a0 else -a0 * as0
    return total if len(sides) > 1 else None


def test_quote_sums_join():
    rng = np.random.default_rng(2)
    seen = set()
    for trial in range(300):
        n = int(rng.integers(0, 14))
        mid, half = 100 + rng.integers(-2, 3, n) * 0.01, rng.choice([0.01, 0.02, 0.05, 0.4], n, p=[0.5, 0.2, 0.1, 0.2])
        sides = np.column_stack([mid - half, rng.integers(1, 9, n).astype(float), mid + half, rng.integers(1, 9, n).astype(float)])
        sides[rng.random((n, 4)) < 0.04] = np.nan
        ts = np.sort(rng.integers(0, 30_000, n))
        cuts = np.sort(rng.integers(0, n + 1, 3))
        ends = [0, *cuts.tolist(), n]
        parts = [QuoteSum.of(ts[a:b], sides[a:b]) for a, b in zip(ends, ends[1:])]

        def before(k):
            bps = spreads_of(sides[:, 0], sides[:, 2])[ends[k] : ends[k] + parts[k].top_at]
            return bps[~np.isnan(bps)]

        found, plain = resilience(parts, before, 10_000), plain_resilience(ts, sides, 10_000)
        assert found[1:] == plain[1:] and found[0] == (plain[0] if plain[0] is None else pytest.approx(plain[0]))
        seen.add(found[2])
        plain_flow = plain_imbalance(sides)
        assert imbalance(parts) == (None if plain_flow is None else pytest.approx(plain_flow))
    assert seen == {"unknown", "normal", "brittle", "recovering", "shock"}


def test_weighted_median():
    rng = np.random.default_rng(3)
    for _ in range(100):
        values = rng.integers(0, 6, int(rng.integers(1, 9))).astype(float)
        distinct, counts = np.unique(values, return_counts=True)
        assert weighted_median(distinct[::-1], counts[::-1]) == statistics.median(values)


def test_unknown_stream_is_refused(spark):
    with pytest.raises(ValueError):
        market_events(tickers=spark.range(1))


def test_compaction_keeps_the_state_and_bounds_the_folders(spark, tmp_path):
    path, rng, expected = str(tmp_path / "published"), np.random.default_rng(4), {}
    for version in range(23):
        rows = [(f"S{k}", float(version), version) for k in rng.choice(9, 3, replace=False)]
        expected.update({symbol: price for symbol, price, _ in rows})
        spark.createDataFrame(rows, "symbol string, price double, version int").write.parquet(f"{path}/v={version}")
        if version % 5 == 4:
            before = {r.symbol: r.price for r in ingest.read_published(spark, path).collect()}
            assert ingest.compact_published(spark, path) == version
            assert {r.symbol: r.price for r in ingest.read_published(spark, path).collect()} == before == expected
            assert len(os.listdir(path)) <= 14
    assert {r.symbol: r.price for r in ingest.read_published(spark, path).collect()} == expected
    assert ingest.compact_published(spark, path) == 22 == ingest.compact_published(spark, path)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not mounted")
def test_streamed_market_does_not_depend_on_arrow_batches(spark):
    """Every streamed value equals its SQL when the rows of a key reach Python three at a time."""
    con, key = duck(SF), (spark.sparkContext.applicationId, SF, "streamed market")
    views._TABLES.pop(key, None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for name in sorted(entry.registry.QUERIES):
            if name.startswith(("D14_streaming", "F18_streaming")) and name != "F18_streaming_sliding_flow":
                assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name], tolerance=2e-6) is None, name
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        views._TABLES.pop(key, None)
