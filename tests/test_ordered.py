"""Ordered scans against brute force, with one hot key, heavy ties and tiny chunks."""

import random

from pyspark.sql import functions as F

from tapewright.operators.ordered import ROWS_PER_CHUNK_CONF, ordered_scan, split_hot_keys, value_at_rank


def tape(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        key = "HOT" if rng.random() < 0.5 else f"K{rng.randrange(6)}"
        ts = 500 if rng.random() < 0.3 else rng.randrange(1000)
        rows.append((key, ts, seq, float(rng.randrange(1, 100))))
    return rows


def brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        top = None
        for i, r in enumerate(mine):
            top = r[3] if top is None else max(top, r[3])
            out[(key, r[2])] = (mine[i - 1][3] if i else None, mine[i - 2][3] if i > 1 else None, top, i)
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "symbol string, ts long, seq long, px double").repartition(4)
    got = ordered_scan(df, ["symbol"], "ts", "seq", previous=["px"], depth=2, running_max={"top": "px"}, position="pos").collect()
    want = brute(rows)
    assert len(got) == len(rows)
    by_key = {}
    for r in got:
        prev, prev2, top, place = want[(r.symbol, r.seq)]
        assert (r.prev.px if r.prev else None) == prev
        assert (r.prev2.px if r.prev2 else None) == prev2
        assert r.top == top
        by_key.setdefault(r.symbol, []).append((place, r.pos))
    for pairs in by_key.values():
        positions = [pos for _, pos in sorted(pairs)]
        assert positions == sorted(set(positions))


def test_scan_without_hot_keys(spark):
    check(spark, tape(1))


def test_scan_across_chunks(spark, tiny_chunks):
    for seed in (2, 3):
        check(spark, tape(seed))


def test_depth_one_edges_are_plain_aggregates(spark, tiny_chunks):
    rows = tape(4)
    df = spark.createDataFrame(rows, "symbol string, ts long, seq long, px double")
    got = ordered_scan(df, ["symbol"], "ts", "seq", previous=["px"]).collect()
    want = brute(rows)
    assert {(r.symbol, r.seq): (r.prev.px if r.prev else None) for r in got} == {k: v[0] for k, v in want.items()}


def test_hot_key_is_cut_evenly(spark):
    spark.conf.set(ROWS_PER_CHUNK_CONF, "1000")
    try:
        df = spark.range(40_000).select(
            F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("HOT").alias("symbol"),
            F.when(F.col("id") % 2 == 0, 77).otherwise(F.col("id")).alias("ts").cast("long"),
            F.col("id").alias("seq"),
        )
        tagged, hot = split_hot_keys(df, ["symbol"], "ts", "seq")
        sizes = [r["count"] for r in tagged.filter("symbol = 'HOT'").groupBy("_chunk").count().collect()]
    finally:
        spark.conf.unset(ROWS_PER_CHUNK_CONF)
    assert hot and len(sizes) > 20
    # Half of the hot rows share one timestamp; the tie is split too.
    assert max(sizes) < 2_500


def test_burst_at_one_time_is_cut_by_its_own_ids(spark):
    """10,000 equal times with neighbouring ids in a tape whose ids span far more."""
    spark.conf.set(ROWS_PER_CHUNK_CONF, "1000")
    try:
        i = F.col("id")
        burst = (i >= 20_000) & (i < 30_000)
        df = spark.range(40_000).select(
            F.lit("HOT").alias("symbol"), F.when(burst, 20_000).otherwise(i).alias("ts").cast("long"), F.when(burst, i).otherwise(i * 1_000_003).alias("seq"), i.cast("double").alias("px")
        )
        tagged, _ = split_hot_keys(df, ["symbol"], "ts", "seq")
        chunks = tagged.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "seq")).alias("a"), F.max(F.struct("ts", "seq")).alias("b")).orderBy("_chunk").collect()
        scanned = ordered_scan(df, ["symbol"], "ts", "seq", previous=["px"], following=["px"]).select("ts", "seq", "px", "prev.px", "next.px").collect()
    finally:
        spark.conf.unset(ROWS_PER_CHUNK_CONF)
    assert max(r.n for r in chunks) <= 1_500
    assert all(tuple(x.b) < tuple(y.a) for x, y in zip(chunks, chunks[1:]))
    rows = sorted(map(tuple, scanned))
    prices = [r[2] for r in rows]
    assert [r[3] for r in rows] == [None, *prices[:-1]] and [r[4] for r in rows] == [*prices[1:], None]


def test_value_at_rank_narrows_many_values(spark):
    ranks = {"low": lambda n: F.lit(1), "middle": lambda n: F.floor((n + 1) / 2), "p95": lambda n: F.ceil(n * 95 / F.lit(100)), "top": lambda n: n}
    df = spark.range(1_000_000).select(F.pow((F.col("id") * 7919 % 1_000_003 + 1).cast("double"), F.lit(3)).alias("v"), (F.col("id") % 3).alias("k"))
    values = sorted((i * 7919 % 1_000_003 + 1) ** 3 for i in range(1_000_000))
    found = value_at_rank(df, [], "v", ranks).first()
    assert [found[c] for c in ranks] == [float(values[k - 1]) for k in (1, 500_000, 950_000, 1_000_000)]
    for row in value_at_rank(df.filter("k < 2"), ["k"], "v", ranks, at_once=300).collect():
        mine = sorted((i * 7919 % 1_000_003 + 1) ** 3 for i in range(row.k, 1_000_000, 3))
        n = len(mine)
        assert [row[c] for c in ranks] == [float(mine[j - 1]) for j in (1, (n + 1) // 2, -(-n * 95 // 100), n)]
    assert value_at_rank(df.filter("v < 0"), [], "v", ranks).collect()[0].low is None
