"""Decision-time grids, and the newest values and running totals as of each time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Longer than any tape: the step of a grid with a single point.
WHOLE_TAPE_MS = 2**42
#: Grid points of one symbol that one task fills forward.
POINTS_PER_BLOCK = 4096


@dataclass(frozen=True)
class DecisionTimes:
    """Grid ``start, start + step, ...`` of ``count`` decision times (epoch milliseconds)."""

    start_ms: int
    step_ms: int = WHOLE_TAPE_MS
    count: int = 1

    @property
    def end_ms(self) -> int:
        return self.start_ms + self.step_ms * (self.count - 1)

    @staticmethod
    def at(now_ms: int) -> "DecisionTimes":
        return DecisionTimes(int(now_ms))

    @staticmethod
    def covering(first_ms: int, last_ms: int, step_ms: int) -> "DecisionTimes":
        """Every ``step_ms`` from ``first_ms``, plus the last time at or after ``last_ms``."""
        return DecisionTimes(int(first_ms), int(step_ms), -(-(last_ms - first_ms) // step_ms) + 1)


def grid(symbols: DataFrame, times: DecisionTimes) -> DataFrame:
    """A row per symbol and decision time, also for symbols without any tick yet."""
    points = F.sequence(F.lit(0).cast("long"), F.lit(times.count - 1).cast("long"))
    return symbols.select(
        "symbol", F.explode(F.transform(points, lambda i: i * times.step_ms + times.start_ms)).alias("now_ms")
    )


def first_seen_at(ts: str, times: DecisionTimes) -> Column:
    """First decision time at or after ``ts``: the pane a tick falls into."""
    index = F.greatest(F.ceil((F.col(ts) - times.start_ms) / times.step_ms), F.lit(0).cast("long"))
    return index * times.step_ms + times.start_ms


@dataclass(frozen=True)
class Newest:
    """The row that is greatest by ``order`` among those with ``ts`` up to a decision time: a struct of ``fields``."""

    name: str
    df: DataFrame
    ts: str
    order: tuple[str, ...]
    fields: dict[str, Column]

    def column(self) -> Column:
        return F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(self.order)], *[c.alias(n) for n, c in self.fields.items()])

    merge = staticmethod(F.max)


@dataclass(frozen=True)
class Total:
    """The sum of ``value`` over the rows with ``ts`` up to a decision time."""

    name: str
    df: DataFrame
    ts: str
    value: Column

    def column(self) -> Column:
        return self.value

    merge = staticmethod(F.sum)


def as_of(frame: DataFrame, pieces: list[Newest | Total], times: DecisionTimes, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add a column per piece to a frame of (keys, now_ms): all pieces in one aggregation, one join and one scan along the grid.

    Rows collapse to one per key and pane, combined map-side. The scan has two levels: blocks of grid points run on their own,
    and what a block ends with is carried into the later ones from a table with one row per block.
    """
    parts = [piece.df.filter(F.col(piece.ts) <= times.end_ms).select(*keys, first_seen_at(piece.ts, times).alias("now_ms"), piece.column().alias(piece.name)) for piece in pieces]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    on = [*keys, "now_ms"]
    out = frame.join(rows.groupBy(*on).agg(*[piece.merge(piece.name).alias(piece.name) for piece in pieces]), on, "left")
    if times.count == 1:
        return out
    out = out.withColumn("_block", F.floor((F.col("now_ms") - times.start_ms) / F.lit(times.step_ms * POINTS_PER_BLOCK)))
    in_block = Window.partitionBy(*keys, "_block").orderBy("now_ms").rowsBetween(Window.unboundedPreceding, 0)
    filled = out.withColumns({piece.name: piece.merge(piece.name).over(in_block) for piece in pieces})
    if times.count <= POINTS_PER_BLOCK:
        return filled.drop("_block")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = out.groupBy(*keys, "_block").agg(*[piece.merge(piece.name).alias(piece.name) for piece in pieces])
    carried = ends.select(*keys, "_block", *[piece.merge(piece.name).over(before).alias(f"_c_{piece.name}") for piece in pieces])
    both = filled.join(carried, [*keys, "_block"], "left")
    for piece in pieces:
        here, carry = F.col(piece.name), F.col(f"_c_{piece.name}")
        whole = F.greatest(here, carry) if isinstance(piece, Newest) else F.when(here.isNull() & carry.isNull(), None).otherwise(F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0)))
        both = both.withColumn(piece.name, whole)
    return both.drop("_block", *[f"_c_{piece.name}" for piece in pieces])
