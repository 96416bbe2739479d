"""Sliding windows over a grid of decision times without a copy of a tick per time.

A tick at time t is seen by the window [now - w, now] at every grid point from the first one at or after t up to floor((t + w - start) / step). Grid
points lie f = floor(w / step) panes apart from the far end of their window, so a window is

* the whole panes k - f + 1 ... k, where pane k holds the ticks after point k - 1 up to point k, and
* of the pane before them the ticks within w mod step of its end.

Ticks are first added up per (symbol, pane, which windows reach back to them): a cell, so at most one row per tick and usually far fewer. For the whole
panes, blocks of f panes are scanned from both ends: a window covers the end of one block and the begin of the next,
so it takes one value of a running sum from each side, whatever f is. A single decision time is a grid with one point whose
step is longer than any window: every window is then a part of one pane, and there is nothing to scan.

What is added up are parts that join in any grouping: sums, minima and maxima (of structs, for first and last rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.operators.timegrid import DecisionTimes
from tapewright.session import cut_lineage

JOIN = {"sum": F.sum, "min": F.min, "max": F.max}


def pane_of(ts: str, times: DecisionTimes) -> Column:
    """Number of the first grid point at or after a time (below 0 before the grid)."""
    return F.ceil((F.col(ts) - times.start_ms) / F.lit(times.step_ms))


def sliding(
    ticks: DataFrame, ts: str, times: DecisionTimes, windows: dict[int, set[str]], parts: dict[str, tuple[str, Column]], frame: DataFrame | None = None
) -> DataFrame:
    """symbol, now_ms and for every window length a struct ``w<length>`` of its parts (rows without any tick are left out).

    ``windows`` names the parts of each length (milliseconds), ``parts`` how they are made of a tick; ``frame`` (symbol, now_ms)
    limits the result to given rows of the grid (all grid points of all symbols with ticks otherwise).
    """
    step, start, last = times.step_ms, times.start_ms, times.count - 1
    used = [name for name in parts if any(name in names for names in windows.values())]
    near = ticks.filter((F.col(ts) >= start - max(windows)) & (F.col(ts) <= times.end_ms)).withColumn("_k", pane_of(ts, times))
    back = F.col("_k") * step + start - F.col(ts)
    reach = [(back <= w % step).alias(f"_r{w}") for w in windows]
    cells = near.groupBy("symbol", "_k", *reach).agg(*[JOIN[parts[c][0]](parts[c][1]).alias(c) for c in used])
    lengths = [F.struct(F.lit(w).cast("long").alias("_w"), F.lit(w // step).cast("long").alias("_f")) for w in windows if w >= step]
    if lengths:  # read twice; without this the ticks would be ordered and added up twice
        cells = cut_lineage(cells)

    def seen_at(w: int) -> Column:
        at = F.col("_k") + w // step
        return F.when(F.col(f"_r{w}") & (at >= 0) & (at <= last), F.struct(F.lit(w).cast("long").alias("_w"), at.alias("_at")))

    edges = cells.select("symbol", F.explode(F.array_compact(F.array(*[seen_at(w) for w in windows]))).alias("_e"), *used)
    rows = edges.select("symbol", "_e._w", "_e._at", *used)
    if lengths:
        frame = ticks.select("symbol").distinct().select("symbol", times_column(times).alias("now_ms")) if frame is None else frame.select("symbol", "now_ms")
        rows = rows.unionByName(whole_panes(cells, frame, times, F.array(*lengths), {c: JOIN[parts[c][0]] for c in used}))
    joined = [JOIN[parts[c][0]](F.when(F.col("_w") == w, F.col(c))).alias(f"_{w}_{c}") for w, names in windows.items() for c in used if c in names]
    out = rows.groupBy("symbol", "_at").agg(*joined)
    structs = [F.struct(*[F.col(f"_{w}_{c}").alias(c) for c in used if c in names]).alias(f"w{w}") for w, names in windows.items()]
    return out.select("symbol", (F.col("_at") * step + start).alias("now_ms"), *structs)


def times_column(times: DecisionTimes) -> Column:
    """The grid points of a row, exploded."""
    points = F.sequence(F.lit(0).cast("long"), F.lit(times.count - 1).cast("long"))
    return F.explode(F.transform(points, lambda i: i * times.step_ms + times.start_ms))


def whole_panes(cells: DataFrame, frame: DataFrame, times: DecisionTimes, lengths: Column, joins: dict) -> DataFrame:
    """symbol, _w, _at and the parts over the panes _at - f + 1 ... _at, at most one row from each side of a block border."""
    held = cells.select("symbol", "_k", F.explode(lengths).alias("_l"), *joins)
    block = F.floor(F.col("_k") / F.col("_l._f"))
    held = held.select("symbol", "_l._w", block.alias("_block"), F.col("_k").alias("_pane"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_at"), *joins)
    points = frame.select("symbol", F.round((F.col("now_ms") - times.start_ms) / times.step_ms).cast("long").alias("_at"), F.explode(lengths).alias("_l"))
    at, f = F.col("_at"), F.col("_l._f")
    from_left = F.struct(F.floor(at / f).alias("_block"), at.alias("_pane"), F.lit(1).alias("_side"))
    from_right = F.struct(F.floor((at - f + 1) / f).alias("_block"), (at - f + 1).alias("_pane"), F.lit(2).alias("_side"))
    sides = F.when((at + 1) % f == 0, F.array(from_left)).otherwise(F.array(from_left, from_right))
    asked = points.select("symbol", "_l._w", "_at", F.explode(sides).alias("_s")).select("symbol", "_w", "_s._block", "_s._pane", "_s._side", "_at")
    both = held.unionByName(asked, allowMissingColumns=True)
    key = Window.partitionBy("symbol", "_w", "_block")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    left = key.orderBy("_pane", "_side").rowsBetween(*so_far)
    right = key.orderBy(F.desc("_pane"), "_side").rowsBetween(*so_far)
    # one order after the other, so that each side is sorted once
    scanned = both.withColumns({f"_left_{c}": join(c).over(left) for c, join in joins.items()}).withColumns({f"_right_{c}": join(c).over(right) for c, join in joins.items()})
    picked = [F.when(F.col("_side") == 1, F.col(f"_left_{c}")).otherwise(F.col(f"_right_{c}")).alias(c) for c in joins]
    return scanned.filter("_side > 0").select("symbol", "_w", "_at", *picked)
