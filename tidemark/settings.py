"""The constants that give the queries their meaning."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    replay_days: int = 14
    batch_minutes: int = 5
    noise_cents: int = 1
    significant_change: float = 0.15
    min_changed_products: int = 200
    session_gap_seconds: int = 1800
    post_hours: int = 2
    baseline_days: int = 7
    min_post_hours: float = 1.0
    floors: tuple[int, ...] = (1, 5, 10, 30)
    abandonment_minutes: int = 30
    salt_buckets: int = 16
    #: Interval tables up to this size are broadcast, larger ones are joined by time bins.
    broadcast_bytes: int = 64 << 20
    min_match_percent: float = 99.0


RULES = Rules()
MONEY, REVENUE = "decimal(12,2)", "decimal(18,2)"
EVENT_TYPES = ("view", "cart", "remove_from_cart", "purchase")
#: Days of history that each layer keeps at least.
RETENTION_DAYS = {"bronze": 30, "silver": 30, "gold": 365, "audit": 365, "ops": 365}
