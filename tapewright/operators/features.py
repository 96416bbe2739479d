"""Window features and feature snapshots: one row per symbol and decision time.

Decision times are a regular grid (one time is a grid of length one; both take the same path). Ticks are added up
per pane once and windows are joined from panes (``sliding``); no tick is copied per decision time. Adjacent-pair terms
use a ``prev`` column computed once over the whole tape: a pair belongs to window [t - w, t] when its later trade
is not after t and its earlier trade is not before t - w, that is all pairs of the window's trades but the first one's, which is taken
off again. Newest values and running totals of all streams are found together (``as_of``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.functions import book
from tapewright.functions.common import half_sign, signed
from tapewright.operators import metrics, scoring, state
from tapewright.operators.ordered import no_hot_key, ordered_scan
from tapewright.operators.sliding import pane_of, sliding
from tapewright.operators.timegrid import DecisionTimes, Newest, Total, as_of, grid
from tapewright.session import cut_lineage


@dataclass(frozen=True)
class FeatureParams:
    """Window lengths and limits; the defaults are the production values."""

    returns_ms: tuple[tuple[str, int], ...] = (("1m", 60_000), ("5m", 300_000), ("1h", 3_600_000))
    flow_ms: int = 30_000
    shock_ms: int = 60_000
    brittle_after_ms: int = 10_000
    vwap_ms: int = 60_000
    roll_ms: int = 300_000
    retention_ms: int = state.HOUR_MS
    stale_after_ms: int = state.STALE_AFTER_MS

    @property
    def longest_trade_window_ms(self) -> int:
        return max(self.flow_ms, self.vwap_ms, self.roll_ms, *(w for _, w in self.returns_ms))


@dataclass
class Market:
    """The typed event tables of one run; trades are already deduplicated (column ``copies``)."""

    trades: DataFrame
    quotes: DataFrame
    contexts: DataFrame | None = None
    mids: DataFrame | None = None
    books: DataFrame | None = None
    candles: DataFrame | None = None
    symbols: DataFrame | None = None
    duplicates: DataFrame | None = None
    gap_symbols: DataFrame | None = None

    def universe(self) -> DataFrame:
        if self.symbols is not None:
            return self.symbols.select("symbol").distinct()
        seen = self.trades.select("symbol").union(self.quotes.select("symbol"))
        for df in (self.contexts, self.mids, self.books, self.candles):
            if df is not None:
                seen = seen.union(df.select("symbol"))
        return seen.distinct()


# --- trade windows ------------------------------------------------------------------------------

def scan_trades(trades: DataFrame, all_small: bool = False) -> DataFrame:
    """Trades with ``prev`` (price, time of the trade before) in time order, arrival on ties."""
    return ordered_scan(
        trades, ["symbol"], "exchange_ts_ms", "ingest_seq", previous=["price", "exchange_ts_ms"], position="_pos", all_small=all_small
    )


#: What a snapshot reads of the ordered tape.
TAPE = ["symbol", "exchange_ts_ms", "ingest_seq", "tid", "side", "price", "size", "notional", "prev", "_pos"]
RETURN_PARTS = {"n", "first", "last", "steps", "step_sum", "step_squares"}
FLOW_PARTS = {"n", "flow"}


def trade_parts() -> dict[str, tuple[str, Column]]:
    """What a window adds up over its trades (``scan_trades``)."""
    step = book.simple_return(F.col("prev.price"), F.col("price"))
    return {
        "n": ("sum", F.lit(1).cast("long")),
        "first": ("min", F.struct("_pos", "price", step.alias("step"))),
        "last": ("max", F.struct("_pos", "price")),
        "steps": ("sum", F.when(step.isNotNull(), 1).otherwise(0).cast("long")),
        "step_sum": ("sum", step),
        "step_squares": ("sum", step * step),
        "flow": ("sum", signed("side", "notional")),
    }


#: A variance up to this share of the mean square is rounding.
ROUNDING = 1e-13


def deviation(n: Column, total: Column, squares: Column) -> Column:
    """Population deviation from a count, a sum and a sum of squares; 0 where only rounding is left."""
    mean_square = squares / n
    variance = mean_square - F.pow(total / n, 2)
    return F.when(n > 0, F.when(variance > mean_square * ROUNDING, F.sqrt(variance)).otherwise(F.lit(0.0)))


def window_return(w: Column) -> Column:
    """First-to-last return of a window; needs two trades."""
    return F.when(w["n"] >= 2, book.simple_return(w["first"]["price"], w["last"]["price"]))


def realized_vol(w: Column) -> Column:
    """Population deviation of adjacent returns inside a window; 0 below three trades."""
    own = w["first"]["step"]  # reaches back before the window
    off = F.coalesce(own, F.lit(0.0))
    spread = deviation(w["steps"] - F.when(own.isNotNull(), 1).otherwise(0), w["step_sum"] - off, w["step_squares"] - off * off)
    return F.when(w["n"] >= 3, spread).otherwise(F.lit(0.0))


def tape_windows(
    scanned: DataFrame, times: DecisionTimes, p: FeatureParams, frame: DataFrame | None = None, with_metrics: bool = False, all_small: bool = False
) -> DataFrame:
    """Returns and realised volatility per window and signed flow, per symbol and decision time; on demand also the inputs of the trade metrics."""
    windows: dict[int, set[str]] = {}

    def want(ms: int, names: set[str]) -> None:
        windows[ms] = windows.get(ms, set()) | names

    for _, ms in p.returns_ms:
        want(ms, RETURN_PARTS)
    want(p.flow_ms, FLOW_PARTS)
    parts = trade_parts()
    if with_metrics:
        parts |= metrics.metric_parts()
        want(p.vwap_ms, metrics.SHORT_PARTS)
        want(p.roll_ms, metrics.LONG_PARTS)
        want(p.flow_ms, metrics.FLOW_PARTS)
        near = scanned.filter((F.col("exchange_ts_ms") >= times.start_ms - max(windows)) & (F.col("exchange_ts_ms") <= times.end_ms))
        kept = near.select("symbol", "exchange_ts_ms", "tid", "side", "price", "size", "notional", "_pos", F.col("prev.price").alias("_before"))
        # the scan by trade id has a ``prev`` of its own
        scanned = metrics.metric_scan(kept, all_small)
        step = book.simple_return(F.col("_before"), F.col("price"))
        parts |= {
            "first": ("min", F.struct("_pos", "price", step.alias("step"))),
            "steps": ("sum", F.when(step.isNotNull(), 1).otherwise(0).cast("long")),
            "step_sum": ("sum", step),
            "step_squares": ("sum", step * step),
        }
    rows = sliding(scanned, "exchange_ts_ms", times, windows, parts, frame)
    out = []
    for label, ms in p.returns_ms:
        out += [window_return(F.col(f"w{ms}")).alias(f"ret_{label}"), realized_vol(F.col(f"w{ms}")).alias(f"rv_{label}")]
    out.append(F.col(f"w{p.flow_ms}.flow").alias("signed_notional_flow_30s"))
    if with_metrics:
        out += [c.alias(name) for name, c in metrics.metric_columns(p).items()]
    return rows.select("symbol", "now_ms", *out)


def trade_windows(scanned: DataFrame, times: DecisionTimes, p: FeatureParams = FeatureParams()) -> DataFrame:
    """``tape_windows`` of trades that were scanned by ``scan_trades``."""
    return tape_windows(scanned, times, p)


def history_return_and_vol(scanned: DataFrame) -> DataFrame:
    """Return and realised volatility over the whole tape given."""
    step = book.simple_return(F.col("prev.price"), F.col("price"))
    first, last = F.min_by("price", "_pos"), F.max_by("price", "_pos")
    spread = F.when(F.count(F.lit(1)) < 3, F.lit(0.0)).otherwise(F.stddev_pop(step))
    return scanned.groupBy("symbol").agg(book.simple_return(first, last).alias("ret_all"), spread.alias("rv_all"))


# --- quote windows ------------------------------------------------------------------------------

def queue_change(before: Column, now: Column, side: str) -> Column:
    """Notional added (bid) or removed (ask) at the touch between two quotes; 0 when a side is missing."""
    p0, s0 = before[f"{side}_price"], before[f"{side}_size"]
    p1, s1 = now[f"{side}_price"], now[f"{side}_size"]
    known = p0.isNotNull() & s0.isNotNull() & p1.isNotNull() & s1.isNotNull()
    better = (p1 > p0) if side == "bid" else (p1 < p0)
    change = F.when(better, p1 * s1).when(p1 == p0, p1 * (s1 - s0)).otherwise(-(p0 * s0))
    value = change if side == "bid" else -change
    return F.when(known, value).otherwise(F.lit(0.0))


QUOTE = ["exchange_ts_ms", "bid_price", "bid_size", "ask_price", "ask_size"]


def quote_windows(
    quotes: DataFrame, times: DecisionTimes, p: FeatureParams = FeatureParams(), frame: DataFrame | None = None, all_small: bool = False
) -> DataFrame:
    """Order-flow imbalance and spread-shock resilience over all quotes of the windows.

    Imbalance is a sum over adjacent quotes, whose earlier one is known from one ordered scan. The shock is the first
    widest spread; only where it is wide enough, and not the first, the median before it is asked for: the quotes of
    the panes between are joined with those windows and counted per distinct spread on the spot, so that counts are shuffled, not quotes.
    """
    on = ["symbol", "now_ms"]
    narrow = quotes.select("symbol", "ingest_seq", *QUOTE)
    scanned = ordered_scan(narrow, ["symbol"], "exchange_ts_ms", "ingest_seq", previous=QUOTE, position="_pos", all_small=all_small)
    change = queue_change(F.col("prev"), F.struct(*QUOTE), "bid") + queue_change(F.col("prev"), F.struct(*QUOTE), "ask")
    # the ordered quotes are read twice, and so are the windows below
    marked = cut_lineage(scanned.select(
        "symbol", "exchange_ts_ms", "_pos", change.alias("_change"), book.spread_bps("bid_price", "ask_price").alias("bps")
    ))
    valid = F.col("bps").isNotNull()
    parts = {
        "n": ("sum", F.lit(1).cast("long")),
        "first": ("min", F.struct("_pos", F.col("_change").alias("change"))),
        "change": ("sum", F.col("_change")),
        "spreads": ("sum", F.when(valid, 1).otherwise(0).cast("long")),
        "earliest": ("min", F.when(valid, F.col("_pos"))),
        "top": ("max", F.when(valid, F.struct("bps", (-F.col("_pos")).alias("back"), F.col("exchange_ts_ms").alias("ts")))),
        "newest": ("max", F.when(valid, F.struct("_pos", "bps", F.col("exchange_ts_ms").alias("ts")))),
    }
    windows: dict[int, set[str]] = {p.flow_ms: {"n", "first", "change"}}
    windows[p.shock_ms] = windows.get(p.shock_ms, set()) | {"spreads", "earliest", "top", "newest"}
    flow, shock = F.col(f"w{p.flow_ms}"), F.col(f"w{p.shock_ms}")
    rows = sliding(marked, "exchange_ts_ms", times, windows, parts, frame).select(
        *on,
        F.when(flow["n"] >= 2, flow["change"] - flow["first"]["change"]).alias("bbo_ofi_proxy_30s"),
        F.coalesce(shock["spreads"], F.lit(0)).alias("_n"), shock["top"].alias("_top"), shock["newest"].alias("_last"), shock["earliest"].alias("_earliest"),
    )
    rows = cut_lineage(rows)
    base = median_before(marked, rows, times, p.shock_ms)
    return spread_resilience(rows.join(base, on, "left"), p).select(
        *on, "bbo_ofi_proxy_30s", "spread_shock_bps", "spread_recovery_ms", "resilience_state"
    )


def median_before(marked: DataFrame, rows: DataFrame, times: DecisionTimes, window_ms: int) -> DataFrame:
    """_base: the median spread before the first widest one, of the windows that can hold a shock."""
    on = ["symbol", "now_ms"]
    wide = rows.filter((F.col("_top.bps") >= SHOCK_MIN_BPS) & (-F.col("_top.back") > F.col("_earliest")))
    since = F.col("now_ms") - window_ms
    panes = F.sequence(F.ceil((since - times.start_ms) / F.lit(times.step_ms)), F.ceil((F.col("_top.ts") - times.start_ms) / F.lit(times.step_ms)))
    asked = wide.select(*on, since.alias("_since"), (-F.col("_top.back")).alias("_at"), F.explode(panes).alias("_k"))
    held = marked.filter(F.col("bps").isNotNull() & (F.col("exchange_ts_ms") >= times.start_ms - window_ms) & (F.col("exchange_ts_ms") <= times.end_ms))
    held = held.select("symbol", pane_of("exchange_ts_ms", times).alias("_k"), "exchange_ts_ms", "_pos", "bps")
    before = held.join(asked, ["symbol", "_k"]).filter((F.col("exchange_ts_ms") >= F.col("_since")) & (F.col("_pos") < F.col("_at")))
    counts = before.groupBy(*on, "bps").agg(F.count(F.lit(1)).alias("_c"))
    window = Window.partitionBy(*on)
    up_to = F.sum("_c").over(window.orderBy("bps").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_up": up_to, "_all": F.sum("_c").over(window)})
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    holds = [(F.col("_up") >= k) & (F.col("_up") - F.col("_c") < k) for k in (low, high)]
    return ranked.groupBy(*on).agg(((F.max(F.when(holds[0], F.col("bps"))) + F.max(F.when(holds[1], F.col("bps")))) / 2).alias("_base"))


# Fixed values of the spread-shock rule.
SHOCK_MIN_BPS = 25.0
SHOCK_MULTIPLE = 2.0
RECOVERED_MULTIPLE = 1.5
RECOVERED_EXTRA_BPS = 10.0


def spread_resilience(rows: DataFrame, p: FeatureParams) -> DataFrame:
    """From the number of spreads, the first widest, the last one and the median before the widest."""
    rows = rows.withColumn("_max", F.col("_top.bps")).withColumn("_lift", F.greatest(F.col("_max") - F.col("_base"), F.lit(0.0)))
    enough = F.col("_n") >= 2
    shock = (F.col("_lift") >= SHOCK_MIN_BPS) & (F.col("_max") >= F.col("_base") * SHOCK_MULTIPLE)
    shock = enough & F.coalesce(shock, F.lit(False))
    elapsed = F.greatest(F.col("_last.ts") - F.col("_top.ts"), F.lit(0).cast("long"))
    calm = F.greatest(F.col("_base") * RECOVERED_MULTIPLE, F.col("_base") + RECOVERED_EXTRA_BPS)
    recovered = F.col("_last.bps") <= calm
    state_label = (
        F.when(~enough, "unknown")
        .when(~shock | recovered, "normal")
        .when(elapsed > p.brittle_after_ms, "brittle")
        .when(F.col("_last.bps") < F.col("_max"), "recovering")
        .otherwise("shock")
    )
    return (
        rows.withColumn("spread_shock_bps", F.when(enough, F.when(shock, F.col("_lift")).otherwise(F.lit(0.0))))
        .withColumn("spread_recovery_ms", F.when(shock & recovered, elapsed))
        .withColumn("resilience_state", state_label)
    )


def adverse_selection_proxy(resilience: str, flow: str, ofi: str, depth: str) -> Column:
    """Ordinal label from flow pressure on depth and flow/queue divergence."""
    known = F.col(flow).isNotNull() & F.col(ofi).isNotNull() & F.col(depth).isNotNull()
    pressure = F.abs(flow) / F.greatest(F.col(depth), F.lit(1.0))
    diverges = half_sign(flow) != half_sign(ofi)
    shaken = F.col(resilience).isin("brittle", "shock")
    return (
        F.when(~known, "unknown")
        .when(shaken & (pressure >= 1.0), "brittle")
        .when((diverges & (pressure >= 0.1)) | (pressure >= 0.5), "watch")
        .otherwise("normal")
    )


# --- candle anomalies ---------------------------------------------------------------------------

def candle_scores(candles: DataFrame, times: DecisionTimes, frame: DataFrame) -> DataFrame:
    """The frame with ``volume_z_1h``, ``trade_count_z_1h`` and ``_candle_ms`` (newest close) as of each decision time.

    An update counts from its receive time on. Per candle the update with the newest receive time up to the decision time is in force; the
    newest candle (over all intervals) is scored against the earlier candles of its interval. An update adds the difference to
    the one it replaces, so that numbers, sums and squares are running totals, for one time as for a grid.
    """
    on = ["symbol", "now_ms"]
    received = candles.withColumn("_recv_ms", F.expr("recv_ts_ns div 1000000"))
    version = Window.partitionBy("symbol", "interval", "open_ts_ms").orderBy("recv_ts_ns", "ingest_seq")
    old = F.lag(F.struct("volume_base", "trade_count")).over(version)
    updates = received.select("symbol", "interval", "_recv_ms", "volume_base", F.col("trade_count").cast("double").alias("trade_count"), old.alias("_old"))
    zero = F.lit(0.0)

    def added(name: str, power: int) -> Column:
        now, before = F.col(name), F.col(f"_old.{name}").cast("double")
        return F.coalesce(F.pow(now, power), zero) - F.coalesce(F.pow(before, power), zero)

    def known(name: str) -> Column:
        return (F.when(F.col(name).isNotNull(), 1).otherwise(0) - F.when(F.col(f"_old.{name}").isNotNull(), 1).otherwise(0)).cast("long")

    names = ("volume_base", "trade_count")
    totals = [Total(f"_{kind}_{c}", updates, "_recv_ms", value) for c in names for kind, value in (("n", known(c)), ("s", added(c, 1)), ("q", added(c, 2)))]
    newest = Newest(
        "_new", received, "_recv_ms", ("open_ts_ms", "recv_ts_ns", "ingest_seq"),
        {"interval": F.col("interval"), "volume_base": F.col("volume_base"), "trade_count": F.col("trade_count").cast("double")},
    )
    clock = Newest("_close", received, "_recv_ms", ("close_ts_ms",), {"ms": F.col("close_ts_ms")})
    rows = as_of(frame, [newest, clock], times).withColumns({"interval": F.col("_new.interval"), "_candle_ms": F.col("_close.ms")})
    kinds = candles.select("symbol", "interval").distinct()
    sums = as_of(frame.select(*on).join(kinds, "symbol"), totals, times, ("symbol", "interval"))

    def z(name: str) -> Column:
        own = F.col(f"_new.{name}")
        n = F.col(f"_n_{name}") - F.when(own.isNotNull(), 1).otherwise(0)
        total, squares = F.col(f"_s_{name}") - F.coalesce(own, zero), F.col(f"_q_{name}") - F.coalesce(own * own, zero)
        spread = F.when(n >= 2, deviation(n, total, squares))
        return F.when(F.col("_new").isNotNull(), F.when(spread > 0, (own - total / n) / spread).otherwise(zero))

    joined = rows.join(sums.select(*on, "interval", *[piece.name for piece in totals]), [*on, "interval"], "left")
    scores = {"volume_z_1h": z("volume_base"), "trade_count_z_1h": z("trade_count")}
    return joined.withColumns(scores).drop("interval", "_new", "_close", *[piece.name for piece in totals])


def candle_z(candles: DataFrame) -> DataFrame:
    """z-scores of each symbol's newest candle after all updates."""
    last = candles.agg(F.max(F.expr("recv_ts_ns div 1000000")).alias("ms")).first()["ms"]
    times = DecisionTimes.at(last if last is not None else 0)
    frame = candles.select("symbol").distinct().withColumn("now_ms", F.lit(times.start_ms).cast("long"))
    return candle_scores(candles, times, frame).select("symbol", "volume_z_1h", "trade_count_z_1h")


# --- snapshots ----------------------------------------------------------------------------------

SNAPSHOT_COLUMNS = [
    "symbol", "now_ms", "confidence", "price", "mid_px", "mark_px", "day_ntl_vlm", "bid_px", "bid_sz", "ask_px",
    "ask_sz", "spread_bps", "spread_shock_bps", "spread_recovery_ms", "resilience_state", "tradeability_state",
    "fee_aware_tradeability", "adverse_selection_proxy", "signed_notional_flow_30s", "bbo_ofi_proxy_30s",
    "microstructure_metrics", "tob_depth_usd", "tob_imbalance", "ret_1m", "ret_5m", "ret_1h", "rv_1m", "rv_5m",
    "rv_1h", "volume_z_1h", "trade_count_z_1h", "liquidity_score", "momentum_score", "mean_reversion_score",
    "score_breakdown", "metadata", "updated_ms_ago", "staleness_state", "incomplete_window_reason",
]


@dataclass(frozen=True)
class QualityInputs:
    """Run-level quality facts that lower every symbol's confidence."""

    parser_drop_count: int = 0
    writer_backlog: int = 0
    writer_backlog_warn_at: int = 0


@dataclass(frozen=True)
class SnapshotOptions:
    params: FeatureParams = field(default_factory=FeatureParams)
    quality: QualityInputs = field(default_factory=QualityInputs)
    fee_profile: scoring.FeeProfile | None = None


def snapshots_at(market: Market, times: DecisionTimes, options: SnapshotOptions = SnapshotOptions()) -> DataFrame:
    """Feature snapshot of every symbol at every decision time, seeing what had happened or been received by then."""
    p = options.params
    on = ["symbol", "now_ms"]
    frame = grid(market.universe(), times)
    streams = [df for df in (market.trades, market.quotes, market.contexts, market.mids, market.books) if df is not None]
    all_small = no_hot_key(streams, ["symbol"])
    # written once: newest trades and windows both read the ordered tape
    scanned = cut_lineage(scan_trades(market.trades, all_small).select(*TAPE))
    recv_ms = F.expr("recv_ts_ns div 1000000")

    # Sparse means fewer than two trades within the retention of the newest one.
    second = F.col("prev.exchange_ts_ms") >= F.col("exchange_ts_ms") - p.retention_ms
    quote = {c: F.col(c) for c in QUOTE}
    pieces: list[Newest | Total] = [
        Newest("_trade", scanned, "exchange_ts_ms", ("exchange_ts_ms", "ingest_seq"), {"price": F.col("price"), "ts": F.col("exchange_ts_ms"), "paired": F.coalesce(second, F.lit(False))}),
        Newest("_quote", market.quotes, "exchange_ts_ms", ("exchange_ts_ms", "ingest_seq"), quote),
        Newest("_mid", state.mid_updates(market.quotes, market.mids, all_small), "visible_ms", ("ingest_seq",), {"mid": F.col("mid")}),
    ]
    clocks = [F.col("_trade.ts"), F.col("_quote.exchange_ts_ms")]
    if market.duplicates is None:
        pieces.append(Total("duplicate_trade_count", market.trades, "exchange_ts_ms", F.col("copies")))
    if market.contexts is not None:
        seen = market.contexts.withColumn("visible_ms", recv_ms)
        fields = {c: F.col(c) for c in ("visible_ms", "day_ntl_vlm", "mark_px")}
        pieces.append(Newest("_context", seen, "visible_ms", ("recv_ts_ns", "ingest_seq"), fields))
        pieces.append(Newest("_fallback", state.first_context_mid(market.contexts, all_small), "fallback_ms", ("fallback_ms",), {"mid": F.col("fallback_mid")}))
        clocks.append(F.when(F.col("_context.visible_ms") > 0, F.col("_context.visible_ms")))
        mark, volume, fallback = F.col("_context.mark_px"), F.col("_context.day_ntl_vlm"), F.col("_fallback.mid")
    else:
        mark = volume = fallback = F.lit(None).cast("double")
    if market.mids is not None:
        seen = market.mids.withColumn("visible_ms", recv_ms).filter("visible_ms > 0")
        pieces.append(Newest("_mids", seen, "visible_ms", ("visible_ms",), {"visible_ms": F.col("visible_ms")}))
        clocks.append(F.col("_mids.visible_ms"))
    if market.books is not None:
        current = state.current_on_arrival(market.books, "recv_ts_ns", all_small)
        pieces.append(Newest("_book", current, "exchange_ts_ms", ("exchange_ts_ms",), {"exchange_ts_ms": F.col("exchange_ts_ms")}))
        clocks.append(F.col("_book.exchange_ts_ms"))
    rows = as_of(frame, pieces, times)
    if market.duplicates is not None:
        rows = rows.join(market.duplicates, "symbol", "left")
    if market.candles is not None:
        rows = rows.join(candle_scores(market.candles, times, frame), on, "left")
        clocks.append(F.col("_candle_ms"))
    else:
        empty = F.lit(None).cast("double")
        rows = rows.withColumns({"volume_z_1h": empty, "trade_count_z_1h": empty})
    if market.gap_symbols is not None:
        gaps = market.gap_symbols.select("symbol").distinct().withColumn("has_gap", F.lit(True))
        rows = rows.join(gaps, "symbol", "left").withColumn("has_gap", F.coalesce("has_gap", F.lit(False)))
    else:
        rows = rows.withColumn("has_gap", F.lit(False))

    rows = rows.join(quote_windows(market.quotes, times, p, frame, all_small), on, "left")
    rows = rows.join(tape_windows(scanned, times, p, frame, with_metrics=True, all_small=all_small), on, "left")

    vols = {f"rv_{label}": F.coalesce(F.col(f"rv_{label}"), F.lit(0.0)) for label, _ in p.returns_ms}
    rows = rows.withColumns(
        {
            **vols,
            "last_update_ms": F.greatest(*clocks),
            "mid_px": F.coalesce(F.col("_mid.mid"), fallback),
            "mark_px": mark,
            "day_ntl_vlm": volume,
            "bid_px": F.col("_quote.bid_price"),
            "bid_sz": F.col("_quote.bid_size"),
            "ask_px": F.col("_quote.ask_price"),
            "ask_sz": F.col("_quote.ask_size"),
            "resilience_state": F.coalesce("resilience_state", F.lit("unknown")),
            "sparse": ~F.coalesce(F.col("_trade.paired"), F.lit(False)),
            "last_trade_price": F.col("_trade.price"),
        }
    )
    return finish_snapshot(rows, options)


def finish_snapshot(rows: DataFrame, options: SnapshotOptions) -> DataFrame:
    """Derived columns of a snapshot from its raw parts: book, freshness, confidence, labels, scores."""
    rows = state.with_staleness(rows, F.col("now_ms"), options.params.stale_after_ms)
    sides = ("bid_px", "bid_sz", "ask_px", "ask_sz")
    rows = rows.withColumns(
        {
            "price": F.coalesce("last_trade_price", "mid_px", "mark_px"),
            "spread_bps": book.spread_bps("bid_px", "ask_px"),
            "tob_depth_usd": book.tob_depth_usd(*sides),
            "tob_imbalance": book.tob_imbalance(*sides),
            "incomplete_window_reason": F.when(
                F.col("sparse"), "need at least two trades for return windows"
            ),
        }
    )
    q = options.quality
    rows = rows.withColumn(
        "confidence",
        scoring.confidence(
            has_gap=F.col("has_gap"),
            stale=F.col("staleness_state") == "stale",
            sparse=F.col("sparse"),
            duplicates=F.coalesce(F.col("duplicate_trade_count") > 0, F.lit(False)),
            parser_drops=F.lit(q.parser_drop_count > 0),
            writer_backlog=F.lit(q.writer_backlog_warn_at > 0 and q.writer_backlog >= q.writer_backlog_warn_at),
        ),
    )
    rows = rows.withColumn(
        "adverse_selection_proxy",
        adverse_selection_proxy("resilience_state", "signed_notional_flow_30s", "bbo_ofi_proxy_30s", "tob_depth_usd"),
    )
    rows = rows.withColumn("tradeability_state", scoring.tradeability_state())
    rows = rows.withColumn("fee_aware_tradeability", scoring.fee_aware_tradeability(options.fee_profile))
    rows = scoring.with_scores(rows)
    rows = rows.withColumn("microstructure_metrics", metrics.metric_array())
    rows = rows.withColumn("metadata", F.lit(None).cast(scoring.METADATA_TYPE))
    return rows.select(*SNAPSHOT_COLUMNS)


def snapshot(market: Market, now_ms: int, options: SnapshotOptions = SnapshotOptions()) -> DataFrame:
    """Snapshot of every symbol at one decision time."""
    return snapshots_at(market, DecisionTimes.at(now_ms), options)
