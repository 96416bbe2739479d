"""Ordered per-key scans that stay balanced when one key holds a large share of the rows.

A plain ``Window.partitionBy(symbol)`` sends a whole symbol to one task. Here a key with more than
``rows_per_chunk`` rows is cut along its order into chunks of about equal size (per-key quantiles;
a timestamp that alone holds several chunks is cut by the quantiles of its own tie-break values). The window then runs
per (key, chunk), and a table with one row per chunk of a hot key carries the state across chunk
borders.

Size of what is collected and broadcast: only keys above ``rows_per_chunk`` enter the cut table and
its arrays hold ``rows(key) / rows_per_chunk`` numbers, so all cuts together are at most ``total_rows /
rows_per_chunk``, and so are the cuts of heavy timestamps. The carry table has one row per chunk of those keys. With the default of a million rows per chunk, 10^12 rows give a million cuts (8 MB).
The limit bounds the memory of a task, which sorts a whole chunk and holds it for its windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.session import cut_lineage

ROWS_PER_CHUNK = 1_000_000
ROWS_PER_CHUNK_CONF = "spark.tapewright.rowsPerChunk"
#: Most cuts of one key, and of one timestamp of it (a power of two): with the default chunk, 8e9 rows of one key; beyond that chunks grow.
MOST_SPLITS = 1 << 14


def rows_per_chunk(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_PER_CHUNK_CONF, str(ROWS_PER_CHUNK)))


def _cuts_at_or_below(cuts: Column, value: Column, splits: int) -> Column:
    """Number of sorted cuts that are <= value, by bisection over power-of-two strides."""
    strides = [F.lit(2**i) for i in reversed(range(splits.bit_length()))]
    return F.aggregate(
        F.array(*strides),
        F.lit(0),
        lambda found, step: found
        + F.when(F.get(cuts, found + step - 1) <= value, step).otherwise(F.lit(0)),
    )


def _quantiles(df: DataFrame, keys: list[str], value: str, sizes: DataFrame, splits: int) -> DataFrame:
    """Per key of ``sizes`` (keys, _m) the ``_m`` - 1 values that cut its rows into ``_m`` about equal parts."""
    fractions = [i / splits for i in range(1, splits)]
    cuts = (
        df.select(*keys, value)
        .join(F.broadcast(sizes), keys)
        .groupBy(*keys)
        .agg(F.percentile_approx(value, fractions, 4 * splits).alias("_q"), F.first("_m").alias("_m"))
        .select(
            *keys,
            F.transform(
                F.sequence(F.lit(1), F.col("_m") - 1),
                lambda j: F.get("_q", (F.ceil(j * F.lit(splits) / F.col("_m")) - 1).cast("int")),
            ).alias("_cuts"),
        )
    )
    return df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)


def _parts(rows: int, limit: int) -> int:
    """A power of two of parts that keeps each of them at about half the limit at most."""
    return min(MOST_SPLITS, max(2, 1 << max(0, -(-2 * rows // limit) - 1).bit_length()))


def hot_key_cuts(df: DataFrame, keys: list[str], ts: str, seq: str) -> tuple[DataFrame, DataFrame | None, int] | None:
    """Cut points of every key above the chunk limit, and of every heavy timestamp of such a key; None without such keys.

    Runs eagerly (a count per key, then quantiles of the hot keys only), so the plan that follows is
    either free of any splitting or holds the cuts as literals.
    """
    limit = rows_per_chunk(df)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    found = sizes.collect()
    if not found:
        return None
    spark = df.sparkSession
    splits = _parts(max(r["_n"] for r in found), limit)

    def sized(rows: list, schema) -> DataFrame:
        return spark.createDataFrame(rows, schema).select("*", F.least(F.lit(splits), F.ceil(2 * F.col("_n") / F.lit(limit))).cast("int").alias("_m")).drop("_n")

    cuts = _quantiles(df, keys, ts, sized(found, sizes.schema), splits)
    # a time that is a cut twice in a row holds at least one part
    again = F.exists(F.zip_with(F.slice("_cuts", 1, F.size("_cuts") - 1), F.slice("_cuts", 2, F.size("_cuts")), lambda a, b: a == b), lambda x: x)
    repeated = cuts.filter(again).select(*keys, F.explode("_cuts").alias(ts)).groupBy(*keys, ts).count().filter("count > 1").drop("count")
    heavy = None
    if not repeated.isEmpty():
        ties = df.join(F.broadcast(repeated), [*keys, ts]).groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit // 2)
        tied = ties.collect()
        if tied:
            heavy = _quantiles(df, [*keys, ts], seq, sized(tied, ties.schema), splits)
    return cuts, heavy, splits


def no_hot_key(tables: list[DataFrame], keys: list[str]) -> bool:
    """Whether no key of any of the tables needs chunks: one job for all of them."""
    counts = [t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select("_n") for t in tables]
    largest = reduce(DataFrame.union, counts).agg(F.max("_n").alias("_n")).first()["_n"] or 0
    return largest <= rows_per_chunk(tables[0])


def split_hot_keys(df: DataFrame, keys: list[str], ts: str, seq: str) -> tuple[DataFrame, bool]:
    """Add ``_chunk`` (ascending along (ts, seq) within a key) and ``_hot``; tells whether any key is hot.

    Keys at or below the limit keep a single chunk 0. ``ts`` and ``seq`` are whole numbers.
    """
    found = hot_key_cuts(df, keys, ts, seq)
    if found is None:
        return df.withColumn("_chunk", F.lit(0).cast("long")), False
    cuts, heavy, splits = found
    tagged = df.join(F.broadcast(cuts), keys, "left").withColumn("_hot", F.col("_cuts").isNotNull())
    place = _cuts_at_or_below(F.col("_cuts"), F.col(ts), splits)
    within = F.lit(0)
    if heavy is not None:  # all rows of a heavy time have the same place, and a place of their own within it
        tagged = tagged.join(F.broadcast(heavy.withColumnRenamed("_cuts", "_ties")), [*keys, ts], "left")
        parts = F.when(F.col("_ties").isNotNull(), _cuts_at_or_below(F.col("_ties"), F.col(seq), splits))
        # times before a heavy one that fall behind the same cut do not exist: cuts at a heavy time start with it
        within = F.coalesce(parts, F.lit(MOST_SPLITS))
    chunk = F.when(F.col("_hot"), place.cast("long") * (2 * MOST_SPLITS) + within).otherwise(F.lit(0)).cast("long")
    return tagged.withColumn("_chunk", chunk).drop("_cuts", "_ties"), True


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    ts: str,
    seq: str,
    *,
    previous: list[str] = (),
    depth: int = 1,
    running_max: dict[str, str] | None = None,
    position: str | None = None,
    following: list[str] = (),
    all_small: bool = False,
) -> DataFrame:
    """One pass in (ts, seq) order per key, exact across chunk borders.

    ``previous`` adds struct ``prev`` (and ``prev2`` for depth 2) with those columns of the rows
    before; ``following`` adds struct ``next`` of the row after; ``running_max`` adds inclusive running maxima; ``position`` adds a
    number that grows along the order (usable as the order key of ``min_by``/``max_by`` in hash aggregation). ``all_small`` says that
    ``no_hot_key`` has been asked before.
    """
    running_max = running_max or {}
    tagged, any_hot = (df.withColumn("_chunk", F.lit(0).cast("long")), False) if all_small else split_hot_keys(df, keys, ts, seq)
    order = Window.partitionBy(*keys, "_chunk").orderBy(ts, seq)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    added: dict[str, Column] = {"_rn": F.row_number().over(order).cast("long")}
    if previous:
        added["_l1"] = F.lag(F.struct(*previous), 1).over(order)
        if depth == 2:
            added["_l2"] = F.lag(F.struct(*previous), 2).over(order)
    if following:
        added["_n1"] = F.lead(F.struct(*following), 1).over(order)
    for name, source in running_max.items():
        added[f"_m_{name}"] = F.max(source).over(so_far)
    local = tagged.withColumns(added)
    if not any_hot:
        return _finish_scan(local, previous, depth, running_max, position, following)

    # One row per chunk of a hot key. Depth 1 needs no ordering of the rows, so it is a partial
    # aggregate over the scan; depth 2 also needs the row before the last one of each chunk.
    deep = bool(previous) and depth == 2
    edge_rows = (local if deep else tagged).filter("_hot")
    edge_aggs = [F.count(F.lit(1)).alias("_e_n")]
    if previous:
        last = F.struct(F.struct(*previous).alias("row"), *([F.col("_l1").alias("before")] if deep else []))
        edge_aggs.append(F.max_by(last, F.struct(ts, seq)).alias("_e_last"))
    if following:
        edge_aggs.append(F.min_by(F.struct(*following), F.struct(ts, seq)).alias("_e_first"))
    for name, source in running_max.items():
        edge_aggs.append(F.max(source).alias(f"_e_{name}"))
    chunk_order = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = chunk_order.rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    if previous:
        carry_cols.append(F.lag("_e_last.row", 1).over(chunk_order).alias("_c1"))
        if deep:
            carry_cols.append(
                F.coalesce(
                    F.lag("_e_last.before", 1).over(chunk_order),
                    F.lag("_e_last.row", 2).over(chunk_order),
                ).alias("_c2")
            )
    if following:
        carry_cols.append(F.lead("_e_first", 1).over(chunk_order).alias("_cn"))
    for name in running_max:
        carry_cols.append(F.max(f"_e_{name}").over(earlier).alias(f"_c_{name}"))
    out = local
    if carry_cols:
        carry = edge_rows.groupBy(*keys, "_chunk").agg(*edge_aggs).select(*keys, "_chunk", *carry_cols)
        out = local.join(F.broadcast(carry), [*keys, "_chunk"], "left")

    return _finish_scan(out, previous, depth, running_max, position, following)


def _finish_scan(out: DataFrame, previous, depth: int, running_max: dict[str, str], position: str | None, following) -> DataFrame:
    """Merge the in-chunk values with what was carried over the chunk border, drop the helpers."""
    carried = set(out.columns)

    def both(local: str, carry: str, merge) -> Column:
        return merge(F.col(local), F.col(carry)) if carry in carried else F.col(local)

    final: dict[str, Column] = {}
    if previous:
        final["prev"] = both("_l1", "_c1", F.coalesce)
        if depth == 2:
            final["prev2"] = F.col("_l2")
            if "_c1" in carried:
                border = F.when(F.col("_l1").isNull(), F.col("_c2")).otherwise(F.col("_c1"))
                final["prev2"] = F.coalesce(F.col("_l2"), border)
    if following:
        final["next"] = both("_n1", "_cn", F.coalesce)
    for name in running_max:
        final[name] = both(f"_m_{name}", f"_c_{name}", F.greatest)
    if position:
        final[position] = F.col("_chunk") * F.lit(2**30) + F.col("_rn")
    helpers = ["_chunk", "_hot", "_rn", "_l1", "_l2", "_c1", "_c2", "_n1", "_cn"]
    helpers += [f"_m_{n}" for n in running_max] + [f"_c_{n}" for n in running_max]
    return out.withColumns(final).drop(*helpers)


#: Distinct values of one key among which a rank is looked up by one running sum.
VALUES_AT_ONCE = 10_000
VALUE_PARTS = 1024


def value_at_rank(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], at_once: int = VALUES_AT_ONCE) -> DataFrame:
    """Per key the values at given ranks (1-based, as functions of the number of non-null values), without a sort of all rows.

    Equal values are counted map-side first. While a key has more than ``at_once`` distinct values left, they are cut into VALUE_PARTS parts by
    quantiles, the parts are counted, and only the part that holds a rank is kept, with its rank inside: about one round per
    factor of a thousand. A running sum over what is left tells the value. Keys without values have no row.
    """
    on = [*keys, "_name"]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), rank(F.col("_n")).cast("long").alias("_rank")) for name, rank in ranks.items()]))
    left = totals.agg(F.max("_d").alias("d")).first()["d"] or 0
    asked = totals.select(*keys, wanted.alias("_a")).select(*keys, "_a.*")
    kept = counts.join(asked, keys) if keys else counts.crossJoin(F.broadcast(asked))  # a row per rank
    while left > at_once:
        kept = cut_lineage(kept)
        cuts = kept.groupBy(*on).agg(F.percentile_approx("_v", [i / VALUE_PARTS for i in range(1, VALUE_PARTS)], 8 * VALUE_PARTS).alias("_cuts"))
        parted = cut_lineage(kept.join(cuts, on).withColumn("_part", _cuts_at_or_below(F.col("_cuts"), F.col("_v"), VALUE_PARTS)).drop("_cuts"))
        sums = parted.groupBy(*on, "_part").agg(F.sum("_c").alias("_in"), F.first("_rank").alias("_rank"), F.count(F.lit(1)).alias("_d"))
        before = F.sum("_in").over(Window.partitionBy(*on).orderBy("_part")) - F.col("_in")  # VALUE_PARTS rows
        found = sums.withColumn("_before", before).filter((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_in")))
        found = cut_lineage(found.select(*on, "_part", (F.col("_rank") - F.col("_before")).alias("_rank"), "_d"))
        smaller = found.agg(F.max("_d").alias("d")).first()["d"] or 0
        kept = parted.drop("_rank").join(found.drop("_d"), [*on, "_part"]).drop("_part")
        if smaller >= left:
            break  # cannot happen while quantiles cut
        left = smaller
    up = F.sum("_c").over(Window.partitionBy(*on).orderBy("_v"))
    held = kept.withColumn("_up", up).filter((F.col("_up") >= F.col("_rank")) & (F.col("_up") - F.col("_c") < F.col("_rank")))
    picked = [F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks]
    return held.groupBy(*keys).agg(*picked)


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Newest ``n`` rows per key. Spark keeps at most ``n`` per key and map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def lookup_join(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", max_rows: int = 500_000) -> DataFrame:
    """Join a per-symbol table: broadcast only after its row count has been checked.

    Beyond ``max_rows`` the join is left to a shuffle join, where adaptive execution splits skewed
    partitions.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return df.join(small, on, how)
