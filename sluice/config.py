"""Parameters of the market queries."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Fixed default values of the flow states; every query takes its own."""

    active_volume: float = 1.40
    active_trades: float = 1.15
    active_balance: float = 0.68
    active_switches: float = 0.30
    suspicious_volume: float = 2.20
    suspicious_trades: float = 1.60
    suspicious_balance: float = 0.82
    suspicious_switches: float = 0.45
    largest_return: float = 0.0040


@dataclass(frozen=True)
class MarketSettings:
    windows: tuple[int, ...] = (300, 600)
    baseline_rows: int = 120
    baseline_seconds: float = 60.0
    depth_band: float = 0.002
    sweep_quote: float = 10_000.0
    refill_quote: float = 1_000.0
    thresholds: Thresholds = Thresholds()
