"""Keyed streaming state of a whole market: trades, quotes, books, contexts, mids and candles of each symbol.

One event table (``market_events``) carries all six streams. Per symbol the state holds scalars (latest values, clocks, counts) and maps
keyed by time pane or candle, so that a micro-batch reads and writes the panes its rows fall into, and windows are
joined from pane sums. Panes leave the state when the symbol's own clock passes their retention; nothing is kept for wall time.

Order: rows of a micro-batch are taken in arrival order (``ingest_seq``) across all Arrow batches of the key, as narrow numpy columns, whose size the trigger
bounds (``maxFilesPerTrigger`` and the like). Micro-batches are taken as they come. The state after any batch equals the batch operators of
``operators.state`` and ``operators.features`` over the rows so far, evaluated at the newest exchange time of trades and quotes.

Copies of a trade have its exchange time (the wire id holds it), so a copy is looked for in its own pane only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapewright.operators.features import FeatureParams
from tapewright.streaming.panes import QuoteSum, TradeSum, imbalance, resilience, spreads_of


@dataclass(frozen=True)
class StreamParams:
    """Windows of ``features``, the width of a pane and the number of candles a symbol keeps (None: all)."""

    features: FeatureParams = field(default_factory=FeatureParams)
    pane_ms: int = 10_000
    candles: int | None = 512


#: Where the fields of each kind of event lie in the shared columns.
NUMBERS = {
    "trade": ("price", "notional"),
    "quote": ("bid_price", "bid_size", "ask_price", "ask_size"),
    "book": (),
    "context": ("day_ntl_vlm", "prev_day_px", "mark_px", "mid_px", "circulating_supply"),
    "mid": ("mid",),
    "candle": ("close", "volume_base", "trade_count"),
}
TEXTS = {"trade": ("unique_trade_id", "side"), "candle": ("interval", "completion")}
SLOTS = ["a", "b", "c", "d", "e"]
EVENT_COLUMNS = ["symbol", "kind", "ingest_seq", "exchange_ts_ms", "recv_ts_ns", "open_ts_ms", "close_ts_ms", "name", "flag", "levels", *SLOTS]


def market_events(**streams: DataFrame | None) -> DataFrame:
    """One table of the given streams: trades, quotes, books, contexts, mids, candles (batch or streaming)."""
    unknown = set(streams) - {f"{kind}s" for kind in NUMBERS}
    if unknown:
        raise ValueError(f"no such streams: {sorted(unknown)}")
    parts = []
    for kind, numbers in NUMBERS.items():
        df = streams.get(f"{kind}s")
        if df is None:
            continue

        def long(name: str, df=df):
            return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long")) if name in df.columns else F.lit(0).cast("long")

        texts = TEXTS.get(kind, ())
        levels = F.to_json(F.struct("bids", "asks")) if kind == "book" else F.lit(None).cast("string")
        parts.append(
            df.select(
                "symbol", F.lit(kind).alias("kind"), *[long(c).alias(c) for c in ("ingest_seq", "exchange_ts_ms", "recv_ts_ns", "open_ts_ms", "close_ts_ms")],
                *[(F.col(texts[k]) if texts else F.lit(None)).cast("string").alias(c) for k, c in enumerate(("name", "flag"))], levels.alias("levels"),
                *[(F.col(numbers[k]) if k < len(numbers) else F.lit(None)).cast("double").alias(c) for k, c in enumerate(SLOTS)],
            )
        )
    return reduce(DataFrame.unionByName, parts)


#: Scalars of a symbol: what a micro-batch always rewrites.
TOTALS = {
    "newest_trade": "bigint", "last_trade_price": "double", "last_trade_ts_ms": "bigint", "duplicate_trade_count": "bigint",
    "quote_ts_ms": "bigint", "bid_px": "double", "bid_sz": "double", "ask_px": "double", "ask_sz": "double",
    "mid_px": "double", "fallback_mid": "double",
    "book_recv_ts_ns": "bigint", "book_ts_ms": "bigint", "book_clock_ms": "bigint", "book_levels": "string",
    "context_recv_ts_ns": "bigint", "day_ntl_vlm": "double", "prev_day_px": "double", "mark_px": "double", "context_mid_px": "double", "circulating_supply": "double",
    "mids_recv_ts_ns": "bigint", "all_mids_px": "double",
    "candle_clock_ms": "bigint", "candles": "bigint", "closed_candles": "bigint", "newest_open_ts_ms": "bigint", "newest_close": "double",
    "volume_z_1h": "double", "trade_count_z_1h": "double",
}
COUNTS = ("duplicate_trade_count", "candles", "closed_candles")
PUBLISHED = [c for c in TOTALS if c not in ("newest_trade", "fallback_mid", "book_clock_ms", "candle_clock_ms")]
OPEN = "open_interval array<string>, open_ts array<bigint>, open_seq array<bigint>"


def output_schema(params: StreamParams) -> str:
    windows = [f"{name}_{label} double" for label, _ in params.features.returns_ms for name in ("ret", "rv")]
    own = [f"{c} {TOTALS[c]}" for c in PUBLISHED]
    tail = "signed_notional_flow_30s double, bbo_ofi_proxy_30s double, spread_shock_bps double, spread_recovery_ms bigint, resilience_state string"
    return ", ".join(["symbol string, now_ms bigint, last_update_ms bigint, retained bigint", *own, *windows, tail])


def number(x) -> float | None:
    return None if x is None or np.isnan(x) else float(x)


def newest_on_arrival(at: np.ndarray, before: int | None) -> np.ndarray:
    """Running maximum along arrival, going on from ``before``."""
    return np.maximum.accumulate(at if before is None else np.maximum(at, before))


def latest(at: np.ndarray, before: int | None) -> int | None:
    """Row of the largest value, the later one on ties; None if it is below ``before``."""
    k = len(at) - 1 - int(np.argmax(at[::-1]))
    return k if before is None or at[k] >= before else None


class Panes:
    """A map of panes in the state: rows (columns in time order, arrival on ties) and their sums."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, row_schema: str, sum_schema: str, width: int):
        self.rows = handle.getMapState(f"{name}_rows", "pane bigint", row_schema)
        self.sums = handle.getMapState(f"{name}_sums", "pane bigint", sum_schema)
        self.width = width

    def load(self, pane: int) -> list[list] | None:
        return [list(c) for c in self.rows.getValue((pane,))] if self.rows.containsKey((pane,)) else None

    def add(self, pane: int, columns: list[list], summed) -> None:
        """Put rows into a pane; the first two columns are time and arrival."""
        old = self.load(pane)
        merged = [a + b for a, b in zip(old, columns, strict=True)] if old else columns
        order = np.lexsort((np.array(merged[1]), np.array(merged[0]))).tolist()
        merged = [[c[k] for k in order] for c in merged]
        self.rows.updateValue((pane,), tuple(merged))
        self.sums.updateValue((pane,), summed(merged))

    def window(self, since: int) -> tuple[int, list[tuple[int, tuple]]]:
        """The pane that ``since`` falls into, and the sums of all later panes in order."""
        edge = since // self.width
        later = sorted(((key[0], value) for key, value in self.sums.iterator() if key[0] > edge), key=lambda kv: kv[0])
        return edge, later

    def expire(self, cutoff: int) -> None:
        """Drop the panes that end before ``cutoff``."""
        for key in [k for k in self.sums.keys() if (k[0] + 1) * self.width <= cutoff]:
            self.rows.removeKey(key)
            self.sums.removeKey(key)


class MarketState(StatefulProcessor):
    """All state of a symbol; one output row per micro-batch."""

    def __init__(self, params: StreamParams) -> None:
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        width = self.params.pane_ms
        self.totals = handle.getValueState("totals", ", ".join(f"{c} {t}" for c, t in TOTALS.items()))
        self.trades = Panes(
            handle, "trade", "ts array<bigint>, seq array<bigint>, id array<string>, px array<double>, amount array<double>",
            "n bigint, first double, last double, pairs bigint, mean double, m2 double, flow double", width,
        )
        self.quotes = Panes(
            handle, "quote", "ts array<bigint>, seq array<bigint>, bid array<double>, bid_size array<double>, ask array<double>, ask_size array<double>",
            "n bigint, first array<double>, last array<double>, imbalance double, top double, top_ts bigint, top_at bigint, last_bps double, last_ts bigint, "
            "bps array<double>, counts array<bigint>", width,
        )
        self.candles = handle.getMapState("candles", "interval string, open_ts bigint", "recv bigint, seq bigint, close double, volume double, trades double, completion string")
        self.still_open = handle.getValueState("still_open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches = list(rows)
        events = {c: np.concatenate([b[c].to_numpy() for b in batches]) for c in EVENT_COLUMNS[1:]}
        order = np.argsort(events["ingest_seq"], kind="stable")
        events = {c: v[order] for c, v in events.items()}
        t = dict(zip(TOTALS, self.totals.get(), strict=True)) if self.totals.exists() else {c: 0 if c in COUNTS else None for c in TOTALS}
        of = {kind: {c: v[events["kind"] == kind] for c, v in events.items()} for kind in NUMBERS}
        mids: list[tuple[int, float]] = []
        for kind, apply in (("trade", self.add_trades), ("quote", self.add_quotes), ("mid", self.add_mids), ("context", self.add_contexts), ("book", self.add_books), ("candle", self.add_candles)):
            if len(of[kind]["ingest_seq"]):
                apply(of[kind], t, mids)
        if mids:  # quotes and mids compete in arrival order
            t["mid_px"] = max(mids)[1]
        self.totals.update(tuple(t[c] for c in TOTALS))
        yield pd.DataFrame([self.published(key[0], t)])

    def close(self) -> None:
        pass

    # --- streams ---

    def add_trades(self, e: dict[str, np.ndarray], t: dict, mids: list) -> None:
        p, at = self.params.features, e["exchange_ts_ms"]
        newest = newest_on_arrival(at, t["newest_trade"])
        t["newest_trade"] = int(newest[-1])
        amount = np.where(e["flag"] == "buy", e["b"], -e["b"])
        kept: list[int] = []
        in_time = np.flatnonzero(at >= newest - p.retention_ms)
        for pane in np.unique(at[in_time] // self.params.pane_ms).tolist():
            rows = in_time[at[in_time] // self.params.pane_ms == pane]
            ids = pd.Series(e["name"][rows])
            old = self.trades.load(pane)
            fresh = ~ids.duplicated().to_numpy()
            if old:
                fresh &= ~ids.isin(old[2]).to_numpy()
            t["duplicate_trade_count"] += int((~fresh).sum())
            rows = rows[fresh]
            if len(rows):
                kept += rows.tolist()
                columns = [at[rows].tolist(), e["ingest_seq"][rows].tolist(), e["name"][rows].tolist(), e["a"][rows].tolist(), amount[rows].tolist()]
                self.trades.add(pane, columns, lambda c: tuple(vars(TradeSum.of(np.array(c[3]), np.array(c[4]))).values()))
        if kept:
            rows = np.sort(np.array(kept))
            k = latest(at[rows], t["last_trade_ts_ms"])
            if k is not None:
                t["last_trade_ts_ms"], t["last_trade_price"] = int(at[rows[k]]), float(e["a"][rows[k]])
        self.trades.expire(t["newest_trade"] - p.retention_ms)

    def add_quotes(self, e: dict[str, np.ndarray], t: dict, mids: list) -> None:
        p, at = self.params.features, e["exchange_ts_ms"]
        newest = newest_on_arrival(at, t["quote_ts_ms"])
        sides = np.column_stack([e[c] for c in SLOTS[:4]])
        whole = np.flatnonzero((at == newest) & ~np.isnan(e["a"]) & ~np.isnan(e["c"]))
        if len(whole):
            k = whole[-1]
            mids.append((int(e["ingest_seq"][k]), float((e["a"][k] + e["c"][k]) / 2)))
        k = latest(at, t["quote_ts_ms"])
        if k is not None:
            t["quote_ts_ms"] = int(at[k])
            t["bid_px"], t["bid_sz"], t["ask_px"], t["ask_sz"] = map(number, sides[k])
        cutoff = self.now(t) - max(p.flow_ms, p.shock_ms)
        recent = np.flatnonzero(at >= cutoff)
        for pane in np.unique(at[recent] // self.params.pane_ms).tolist():
            rows = recent[at[recent] // self.params.pane_ms == pane]
            columns = [at[rows].tolist(), e["ingest_seq"][rows].tolist(), *(sides[rows, j].tolist() for j in range(4))]
            self.quotes.add(pane, columns, lambda c: tuple(vars(QuoteSum.of(np.array(c[0]), np.array(c[2:]).T)).values()))
        self.quotes.expire(cutoff)

    def add_mids(self, e: dict[str, np.ndarray], t: dict, mids: list) -> None:
        at = e["recv_ts_ns"]
        current = np.flatnonzero(at == newest_on_arrival(at, t["mids_recv_ts_ns"]))
        if len(current):
            mids.append((int(e["ingest_seq"][current[-1]]), float(e["a"][current[-1]])))
        k = latest(at, t["mids_recv_ts_ns"])
        if k is not None:
            t["mids_recv_ts_ns"], t["all_mids_px"] = int(at[k]), number(e["a"][k])

    def add_contexts(self, e: dict[str, np.ndarray], t: dict, mids: list) -> None:
        at = e["recv_ts_ns"]
        current = np.flatnonzero((at == newest_on_arrival(at, t["context_recv_ts_ns"])) & ~np.isnan(e["d"]))
        if t["fallback_mid"] is None and len(current):
            t["fallback_mid"] = float(e["d"][current[0]])
        k = latest(at, t["context_recv_ts_ns"])
        if k is not None:  # the newest replaces the older one as a whole
            t["context_recv_ts_ns"] = int(at[k])
            for slot, name in zip(SLOTS, ("day_ntl_vlm", "prev_day_px", "mark_px", "context_mid_px", "circulating_supply"), strict=True):
                t[name] = number(e[slot][k])

    def add_books(self, e: dict[str, np.ndarray], t: dict, mids: list) -> None:
        at = e["recv_ts_ns"]
        current = at == newest_on_arrival(at, t["book_recv_ts_ns"])
        if current.any():
            t["book_clock_ms"] = max(int(e["exchange_ts_ms"][current].max()), t["book_clock_ms"] or 0)
        k = latest(at, t["book_recv_ts_ns"])
        if k is not None:
            t["book_recv_ts_ns"], t["book_ts_ms"], t["book_levels"] = int(at[k]), int(e["exchange_ts_ms"][k]), e["levels"][k]

    def add_candles(self, e: dict[str, np.ndarray], t: dict, mids: list) -> None:
        """Newest receive time wins; a candle with a later open closes the earlier ones of its interval that arrived before it."""
        t["candle_clock_ms"] = max(int(e["close_ts_ms"].max()), t["candle_clock_ms"] or 0)
        frame = pd.DataFrame({c: e[c] for c in ("name", "open_ts_ms", "recv_ts_ns", "ingest_seq", "a", "b", "c", "flag")})
        best = frame.sort_values(["recv_ts_ns", "ingest_seq"], kind="stable").drop_duplicates(["name", "open_ts_ms"], keep="last")
        changed: dict[tuple[str, int], list] = {}
        opened = {(n, o): s for n, o, s in zip(*self.still_open.get(), strict=True)} if self.still_open.exists() else {}
        for name, open_ts, recv, seq, *payload in best.itertuples(index=False):
            key = (name, int(open_ts))
            old = self.candles.getValue(key) if self.candles.containsKey(key) else None
            if old is not None and old[0] > recv:
                continue
            t["candles"] += old is None
            t["closed_candles"] += (payload[-1] == "closed") - (old is not None and old[-1] == "closed")
            changed[key] = [int(recv), int(seq), *map(number, payload[:3]), payload[-1]]
            opened.pop(key, None)
            if payload[-1] != "closed":
                opened[key] = int(seq)
        arrived = {name: part.sort_values("open_ts_ms", kind="stable") for name, part in frame.groupby("name")}
        for key, seq in list(opened.items()):
            if (part := arrived.get(key[0])) is not None:
                later = part["ingest_seq"].to_numpy()[np.searchsorted(part["open_ts_ms"].to_numpy(), key[1], "right") :]
                if len(later) and later.max() > seq:
                    row = changed.get(key) or list(self.candles.getValue(key))
                    changed[key] = [*row[:-1], "closed"]
                    t["closed_candles"] += 1
                    del opened[key]
        for key, row in changed.items():
            self.candles.updateValue(key, tuple(row))
        every = sorted((key[1], row[1], key[0], row) for key, row in ((tuple(k), tuple(v)) for k, v in self.candles.iterator()))
        if self.params.candles is not None and len(every) > self.params.candles:
            for open_ts, _, name, row in every[: -self.params.candles]:
                self.candles.removeKey((name, open_ts))
                opened.pop((name, open_ts), None)
                t["closed_candles"] -= row[-1] == "closed"
            every = every[-self.params.candles :]
            t["candles"] = len(every)
        self.still_open.update(tuple(map(list, zip(*((n, o, s) for (n, o), s in opened.items())))) if opened else ([], [], []))
        open_ts, _, name, row = every[-1]
        t["newest_open_ts_ms"], t["newest_close"] = open_ts, row[2]
        base = [r for o, _, n, r in every if n == name and o < open_ts]
        for place, target in ((3, "volume_z_1h"), (4, "trade_count_z_1h")):
            values = np.array([r[place] for r in base if r[place] is not None])
            spread = values.std() if len(values) > 1 else 0.0
            t[target] = float((row[place] - values.mean()) / spread) if spread > 0 and row[place] is not None else 0.0

    # --- what is published ---

    @staticmethod
    def now(t: dict) -> int | None:
        known = [x for x in (t["newest_trade"], t["quote_ts_ms"]) if x is not None]
        return max(known) if known else None

    def trade_window(self, since: int) -> TradeSum:
        edge, later = self.trades.window(since)
        rows = self.trades.load(edge)
        out = TradeSum()
        if rows:
            inside = np.array(rows[0]) >= since
            out = TradeSum.of(np.array(rows[3])[inside], np.array(rows[4])[inside])
        return reduce(TradeSum.then, (TradeSum(*value) for _, value in later), out)

    def quote_window(self, since: int) -> tuple[list[QuoteSum], list[tuple[int, int]]]:
        """Parts of the window and where their rows lie: (pane, rows left out)."""
        edge, later = self.quotes.window(since)
        rows, parts, places = self.quotes.load(edge), [], []
        if rows:
            skip = int(np.searchsorted(np.array(rows[0]), since))
            parts.append(QuoteSum.of(np.array(rows[0])[skip:], np.array(rows[2:]).T[skip:]))
            places.append((edge, skip))
        return parts + [QuoteSum(*value) for _, value in later], places + [(pane, 0) for pane, _ in later]

    def published(self, symbol: str, t: dict) -> dict:
        p, now = self.params.features, self.now(t)
        clocks = [t["newest_trade"], t["quote_ts_ms"], t["book_clock_ms"], t["candle_clock_ms"], *(t[c] // 1_000_000 for c in ("context_recv_ts_ns", "mids_recv_ts_ns") if t[c] is not None)]
        clocks = [x for x in clocks if x is not None and x > 0]
        out = {"symbol": symbol, "now_ms": now, "last_update_ms": max(clocks) if clocks else None, "retained": 0, **{c: t[c] for c in PUBLISHED}}
        out["mid_px"] = t["mid_px"] if t["mid_px"] is not None else t["fallback_mid"]
        windows = {"flow": None, **{label: None for label, _ in p.returns_ms}}
        if t["newest_trade"] is not None:
            out["retained"] = self.trade_window(t["newest_trade"] - p.retention_ms).n
            windows = {label: self.trade_window(now - ms) for label, ms in (("flow", p.flow_ms), *p.returns_ms)}
        for label, _ in p.returns_ms:
            out[f"ret_{label}"] = windows[label].total_return if windows[label] else None
            out[f"rv_{label}"] = windows[label].volatility if windows[label] else 0.0
        flow = windows["flow"]
        out["signed_notional_flow_30s"] = flow.flow if flow and flow.n else None
        out.update(bbo_ofi_proxy_30s=None, spread_shock_bps=None, spread_recovery_ms=None, resilience_state="unknown")
        if t["quote_ts_ms"] is not None:
            out["bbo_ofi_proxy_30s"] = imbalance(self.quote_window(now - p.flow_ms)[0])
            parts, places = self.quote_window(now - p.shock_ms)

            def rows_before(k: int) -> np.ndarray:
                pane, skip = places[k]
                rows = self.quotes.load(pane)
                bps = spreads_of(np.array(rows[2]), np.array(rows[4]))[skip : skip + parts[k].top_at]
                return bps[~np.isnan(bps)]

            out["spread_shock_bps"], out["spread_recovery_ms"], out["resilience_state"] = resilience(parts, rows_before, p.brittle_after_ms)
        return out


def market_state(events: DataFrame, params: StreamParams = StreamParams()) -> DataFrame:
    """One row per symbol and micro-batch of a stream of ``market_events``: its whole state and window features."""
    return (
        events.select(*EVENT_COLUMNS)
        .groupBy("symbol")
        .transformWithStateInPandas(statefulProcessor=MarketState(params), outputStructType=output_schema(params), outputMode="Update", timeMode="None")
    )
