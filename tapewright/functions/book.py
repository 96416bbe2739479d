"""Top-of-book column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.functions.common import col, finite_or_null, safe_div

BPS = 10_000.0


def spread_bps(bid: Column | str, ask: Column | str) -> Column:
    """Spread over the mid in basis points; missing for non-positive or crossed quotes."""
    bid, ask = col(bid), col(ask)
    return F.when((bid > 0) & (ask > 0) & (bid <= ask), (ask - bid) / ((bid + ask) / 2) * BPS)


def tob_depth_usd(bid: str, bid_size: str, ask: str, ask_size: str) -> Column:
    return col(bid) * col(bid_size) + col(ask) * col(ask_size)


def tob_imbalance(bid: str, bid_size: str, ask: str, ask_size: str) -> Column:
    bids, asks = col(bid) * col(bid_size), col(ask) * col(ask_size)
    return F.when(bids + asks > 0, (bids - asks) / (bids + asks))


def microprice(bid: str, bid_size: str, ask: str, ask_size: str) -> Column:
    """Mid weighted by the size of the opposite side."""
    b, bs, a, as_ = (finite_or_null(c) for c in (bid, bid_size, ask, ask_size))
    return F.when((bs > 0) & (as_ > 0), (a * bs + b * as_) / (bs + as_))


def edge_bps(micro: Column | str, mid: Column | str) -> Column:
    return safe_div(col(micro) - col(mid), mid) * BPS


def quote_shares(bid_notional: Column, ask_notional: Column) -> tuple[Column, Column]:
    """Share of each side; a non-positive side counts as zero, both missing when nothing is quoted."""
    def side(c: Column) -> Column:
        return F.coalesce(F.when(finite_or_null(c) > 0, c), F.lit(0.0))

    bids, asks = side(bid_notional), side(ask_notional)
    total = F.when(bids + asks > 0, bids + asks)
    return bids / total, asks / total


def queue_label(skew: Column) -> Column:
    return F.when(skew > 0.08, "bid-heavy").when(skew < -0.08, "ask-heavy").otherwise("balanced")


def basis_bps(mark: Column | str, mid: Column | str) -> Column:
    return (safe_div(mark, mid) - 1) * BPS


def simple_return(start: Column | str, end: Column | str) -> Column:
    start, end = col(start), col(end)
    return F.when((start > 0) & (end > 0), (end - start) / start)
