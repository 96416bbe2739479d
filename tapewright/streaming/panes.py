"""Summaries of time panes that join in order: trades (returns, flow) and quotes (imbalance, spreads).

A pane is a fixed stretch of exchange time. Its rows are summed up once when they change; a window is the rows of the pane
that its start falls into, summed up again, and the stored sums of the panes after it, joined from left to right. Adjacent pairs
across a border come from the last row of one part and the first of the next.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from tapewright.operators.features import RECOVERED_EXTRA_BPS, RECOVERED_MULTIPLE, SHOCK_MIN_BPS, SHOCK_MULTIPLE


@dataclass
class TradeSum:
    """Trades in time order: number, first and last price, moments of adjacent returns, signed notional."""

    n: int = 0
    first: float = math.nan
    last: float = math.nan
    pairs: int = 0
    mean: float = 0.0
    m2: float = 0.0
    flow: float = 0.0

    @staticmethod
    def of(price: np.ndarray, amount: np.ndarray) -> TradeSum:
        if not len(price):
            return TradeSum()
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = np.diff(price) / price[:-1]
        steps = steps[np.isfinite(steps)]
        mean = float(steps.mean()) if len(steps) else 0.0
        return TradeSum(len(price), float(price[0]), float(price[-1]), len(steps), mean, float(((steps - mean) ** 2).sum()), float(amount.sum()))

    def then(self, later: TradeSum) -> TradeSum:
        if not self.n or not later.n:
            return later if not self.n else self
        pairs, mean, m2 = self.pairs, self.mean, self.m2
        border = [(1, later.first / self.last - 1, 0.0)] if self.last else []
        for n, other, spread in [*border, (later.pairs, later.mean, later.m2)]:
            if n:
                apart, total = other - mean, pairs + n
                m2 += spread + apart * apart * pairs * n / total
                mean += apart * n / total
                pairs = total
        return TradeSum(self.n + later.n, self.first, later.last, pairs, mean, m2, self.flow + later.flow)

    @property
    def total_return(self) -> float | None:
        return (self.last - self.first) / self.first if self.n > 1 and self.first else None

    @property
    def volatility(self) -> float:
        return math.sqrt(max(self.m2, 0.0) / self.pairs) if self.n > 2 and self.pairs else 0.0


def spreads_of(bid: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Spread in basis points of the mid; NaN for missing, non-positive and crossed quotes."""
    with np.errstate(divide="ignore", invalid="ignore"):
        good = (bid > 0) & (ask > 0) & (bid <= ask)
        return np.where(good, (ask - bid) / ((bid + ask) / 2) * 10_000, np.nan)


def queue_changes(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Notional added at the bid less that added at the ask, for rows (bid, bid size, ask, ask size); a missing side counts 0."""
    total = np.zeros(len(now))
    for k, sign in ((0, 1.0), (2, -1.0)):
        p0, s0, p1, s1 = before[:, k], before[:, k + 1], now[:, k], now[:, k + 1]
        better = (p1 > p0) if sign > 0 else (p1 < p0)
        change = np.where(better, p1 * s1, np.where(p1 == p0, p1 * (s1 - s0), -(p0 * s0)))
        known = ~np.isnan(p0 + s0 + p1 + s1)
        total += np.where(known, sign * change, 0.0)
    return total


@dataclass
class QuoteSum:
    """Quotes in time order: number, edges, imbalance, and the spreads: how often each occurs, the first widest, the last."""

    n: int = 0
    first: list[float] = field(default_factory=list)
    last: list[float] = field(default_factory=list)
    imbalance: float = 0.0
    top: float = math.nan
    top_ts: int = 0
    top_at: int = -1  # place of the first widest spread among the rows
    last_bps: float = math.nan
    last_ts: int = 0
    bps: list[float] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)

    @staticmethod
    def of(ts: np.ndarray, sides: np.ndarray) -> QuoteSum:
        """``sides``: rows (bid, bid size, ask, ask size)."""
        if not len(ts):
            return QuoteSum()
        bps = spreads_of(sides[:, 0], sides[:, 2])
        valid = np.flatnonzero(~np.isnan(bps))
        out = QuoteSum(len(ts), sides[0].tolist(), sides[-1].tolist(), float(queue_changes(sides[:-1], sides[1:]).sum()))
        if len(valid):
            top = int(valid[np.argmax(bps[valid])])
            out.top, out.top_ts, out.top_at = float(bps[top]), int(ts[top]), top
            out.last_bps, out.last_ts = float(bps[valid[-1]]), int(ts[valid[-1]])
            values, counts = np.unique(bps[valid], return_counts=True)
            out.bps, out.counts = values.tolist(), counts.tolist()
        return out


def imbalance(parts: list[QuoteSum]) -> float | None:
    """Order-flow imbalance over consecutive parts; None below two quotes."""
    parts = [p for p in parts if p.n]
    if sum(p.n for p in parts) < 2:
        return None
    borders = [queue_changes(np.array([a.last]), np.array([b.first]))[0] for a, b in zip(parts, parts[1:])]
    return float(sum(p.imbalance for p in parts) + sum(borders))


def weighted_median(values: np.ndarray, counts: np.ndarray) -> float:
    """Median of values that occur ``counts`` times (at least one)."""
    order = np.argsort(values, kind="stable")
    values, up = values[order], np.cumsum(counts[order])
    low, high = np.searchsorted(up, [(up[-1] + 1) // 2, up[-1] // 2 + 1])
    return float((values[low] + values[high]) / 2)


def resilience(parts: list[QuoteSum], rows_before, brittle_after_ms: int) -> tuple[float | None, int | None, str]:
    """spread_shock_bps, spread_recovery_ms, resilience_state over consecutive parts.

    ``rows_before(k)`` gives the valid spreads of part k before its first widest one: the only rows that are looked at again.
    """
    parts_with = [k for k, p in enumerate(parts) if p.bps]
    if sum(sum(parts[k].counts) for k in parts_with) < 2:
        return None, None, "unknown"
    at = max(parts_with, key=lambda k: (parts[k].top, -k))
    early = rows_before(at)
    values = np.concatenate([*(np.array(parts[k].bps) for k in parts_with if k < at), early])
    counts = np.concatenate([*(np.array(parts[k].counts) for k in parts_with if k < at), np.ones(len(early))])
    widest, last = parts[at], parts[parts_with[-1]]
    if not len(values):
        return 0.0, None, "normal"
    base = weighted_median(values, counts)
    lift = max(widest.top - base, 0.0)
    if lift < SHOCK_MIN_BPS or widest.top < base * SHOCK_MULTIPLE:
        return 0.0, None, "normal"
    elapsed = max(last.last_ts - widest.top_ts, 0)
    if last.last_bps <= max(base * RECOVERED_MULTIPLE, base + RECOVERED_EXTRA_BPS):
        return lift, elapsed, "normal"
    if elapsed > brittle_after_ms:
        return lift, None, "brittle"
    return lift, None, "recovering" if last.last_bps < widest.top else "shock"
