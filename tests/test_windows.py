"""Windows by panes against brute force, single instants against grids, the two-level fill, the exact sample clock."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tapewright.operators import analog, features, timegrid
from tapewright.operators.sliding import sliding
from tapewright.operators.timegrid import DecisionTimes, Newest, Total, as_of, grid
from tapewright.plans import views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("start", "step", "count"), [(1000, 100, 12), (1003, 7, 60), (1500, 2000, 3), (1700, timegrid.WHOLE_TAPE_MS, 1)])
def test_sliding_equals_brute_force(spark, start, step, count):
    rng = random.Random(start)
    ticks = [(rng.choice("ab"), rng.choice([rng.randrange(0, 2400), 1000, 1100, 900]), k, rng.randrange(1, 50)) for k in range(400)]
    df = spark.createDataFrame(ticks, "symbol string, ts long, seq long, v long").repartition(4)
    times = DecisionTimes(start, step, count)
    parts = {"n": ("sum", F.lit(1)), "s": ("sum", F.col("v")), "first": ("min", F.struct("ts", "seq")), "last": ("max", F.struct("ts", "seq"))}
    windows = {w: {"n", "s", "first", "last"} for w in (0, 5, 100, 250, 1000)}
    found = {(r.symbol, r.now_ms): r for r in sliding(df, "ts", times, windows, parts).collect()}
    for symbol in "ab":
        for k in range(count):
            now = start + k * step
            for w in windows:
                inside = [t for t in ticks if t[0] == symbol and now - w <= t[1] <= now]
                row = found.get((symbol, now))
                got = row[f"w{w}"] if row else None
                assert (got.n if got and got.n else 0) == len(inside)
                if inside:
                    assert got.s == sum(t[3] for t in inside)
                    assert tuple(got.first) == min((t[1], t[2]) for t in inside) and tuple(got.last) == max((t[1], t[2]) for t in inside)


def test_as_of_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    ticks = [(rng.choice("ab"), rng.randrange(0, 900), k, rng.randrange(9)) for k in range(60)]
    df = spark.createDataFrame(ticks, "symbol string, ts long, seq long, v long")
    times = DecisionTimes(100, 10, 70)
    frame = grid(spark.createDataFrame([("a",), ("b",), ("c",)], "symbol string"), times)
    pieces = [Newest("newest", df, "ts", ("seq",), {"v": F.col("v")}), Total("total", df, "ts", F.col("v"))]
    for size in (4096, 8):
        monkeypatch.setattr(timegrid, "POINTS_PER_BLOCK", size)
        rows = as_of(frame, pieces, times).collect()
        assert len(rows) == 210
        for r in rows:
            seen = [t for t in ticks if t[0] == r.symbol and t[1] <= r.now_ms]
            assert r.total == (sum(t[3] for t in seen) if seen else None)
            assert (r.newest.v if r.newest else None) == (max(seen, key=lambda t: t[2])[3] if seen else None)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not mounted")
def test_one_instant_equals_its_grid_point(spark):
    """Every column of a snapshot is the same whether its time stands alone or in a grid; candles get late corrections."""
    history = views.market_history(spark, SF)
    history.candles = views.candle_updates(spark, SF).withColumn("recv_ts_ns", F.col("recv_ts_ns") + (F.col("ingest_seq") % 4) * views.DAY * 1_000_000)
    history.books = views.books(spark, SF)
    times = views.daily_times(spark, SF)
    together = features.snapshots_at(history, times, views.OPTIONS)
    columns = [c for c in together.columns if c not in ("metadata", "microstructure_metrics", "score_breakdown")]
    rounded = [F.round(c, 7).alias(c) if t == "double" else F.col(c) for c, t in together.dtypes if c in columns]
    rows = {(r.symbol, r.now_ms): r for r in together.select(*rounded).collect()}
    picked = [times.start_ms + k * times.step_ms for k in (0, times.count // 2, times.count - 1)]
    for now in picked:
        alone = features.snapshot(history, now, views.OPTIONS).select(*rounded).collect()
        assert alone and [r for r in alone if r != rows[r.symbol, now]] == []


def test_exact_clock(spark):
    rng = random.Random(8)
    for gap, cadence in ((40, 300), (900, 300), (5, 1)):
        at, rows = 1000, []
        for k in range(400):
            at += rng.randrange(gap) * rng.choice([0, 1, 1, 20])
            rows.append((at - rng.choice([0, 0, 500]), k))
        clock, samples, newest = None, [], 0
        for ms, _ in rows:
            newest = max(newest, ms)
            if clock is None or newest >= clock + cadence:
                clock = newest
                samples.append(newest)
        expected = samples if samples[-1] == newest else [*samples, newest]
        updates = spark.createDataFrame(rows, "ms long, ingest_seq long").repartition(3)
        assert analog.sample_clock(updates, cadence, exact=True) == expected
    assert analog.sample_clock(updates.filter("ms < 0"), 5, exact=True) == []
