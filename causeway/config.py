"""Settings of an analysis. Nothing in the library has a second copy of these."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """balance has no shipped truth, so callers state it where it matters; the rest are the programme's fixed numbers."""

    balance: float = 10_000.0
    breach_share: float = 0.04
    target_share: float = 0.08
    hurdle: float = 7.0
    primary_from: int = 53
    primary_to: int = 65
    excluded_campaigns: tuple[int, ...] = (41, 66)
    session_hours: float = 1.99
    history_k: float = 5.0
    history_half_life: float = 2.0
    ewm_alpha: float = 0.3
    seed: int = 7
    draws: int = 2_000
    fold_count: int = 4
    least_train_campaigns: int = 4


DEFAULT = Settings()
