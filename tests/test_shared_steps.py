"""Steps that several results share are computed once, and a task holds a bounded part of a key."""

from pyspark.sql import functions as F

from tapewright.operators import features
from tapewright.operators.ordered import split_hot_keys
from tapewright.operators.timegrid import DecisionTimes


def test_quotes_are_ordered_once_for_all_windows(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value

    rows = [("A", i, i * 1000, 100.0 - i % 7, 1.0, 101.0 + i % 5, 2.0) for i in range(60)]
    quotes = spark.createDataFrame(rows, "symbol string, ingest_seq long, exchange_ts_ms long, bid_price double, bid_size double, ask_price double, ask_size double")
    quotes = quotes.withColumn("symbol", F.udf(count, "string").asNondeterministic()("symbol"))
    times = DecisionTimes(10_000, 10_000, 6)
    frame = spark.createDataFrame([("A", 10_000 * k) for k in range(1, 7)], "symbol string, now_ms long")
    found = features.quote_windows(quotes, times, features.FeatureParams(), frame, all_small=True).collect()
    assert len(found) == 6 and seen.value == 60


def test_a_large_key_is_cut_by_default(spark):
    rows = spark.range(2_500_000).select(F.lit(0).alias("key"), F.col("id").alias("ts"), F.col("id").alias("seq"))
    parts, hot = split_hot_keys(rows, ["key"], "ts", "seq")
    sizes = [r["count"] for r in parts.groupBy("_chunk").count().collect()]
    assert hot and sum(sizes) == 2_500_000 and max(sizes) <= 1_000_000
