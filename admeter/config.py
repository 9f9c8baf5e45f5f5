"""All tunable values in one place; every job takes a ``Settings``."""

from __future__ import annotations

from dataclasses import dataclass, field

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Settings:
    # "now" for every batch job; jobs never read the wall clock.
    as_of_ms: int = 1_706_659_200_000  # 2024-01-31T00:00:00Z

    dedup_ttl_ms: int = 60 * MINUTE_MS
    attribution_window_ms: int = 24 * HOUR_MS
    allowed_lateness_ms: int = 5 * MINUTE_MS
    # How long streams wait for rows behind the newest event; later rows go to a table of their own.
    stream_lateness_ms: int = 15 * MINUTE_MS
    # Longest span between kept copies of one id that streams behind the de-duplication wait for.
    span_ms: int = 3 * HOUR_MS
    counter_ttl_ms: int = 48 * HOUR_MS

    hot_window_ms: int = 48 * HOUR_MS
    warm_window_ms: int = 30 * DAY_MS
    default_window_ms: int = 2 * HOUR_MS
    # Limits are the caller's choice; None: all.
    max_buckets: int | None = None

    quota_default: int = 500
    quota_window_s: int = 1
    quota_enforced: bool = True

    discrepancy_threshold_pct: float = 1.0
    max_campaigns_per_run: int | None = None
    auto_correct: bool = True
    reports_kept: int = 48

    replay_default: int | None = None
    replay_cap: int | None = None

    # Retention per dataset.
    retention_ms: dict = field(
        default_factory=lambda: {
            "raw": 24 * HOUR_MS,
            "dlq": 7 * DAY_MS,
            "enriched": 1 * HOUR_MS,
            "warm": 30 * DAY_MS,
        }
    )

    # A key with more rows than this is split over several tasks (operators/hot_keys.py).
    hot_key_rows: int = 200_000
    # Spans that the rows of such a key, and of few large keys in general, are cut into.
    hot_span_ms: int = HOUR_MS
    # Share of rows looked at to find such keys; it steers the plan only, never the result.
    hot_key_sample: float = 0.02
    # Largest number of rows that is ever broadcast with a hint.
    broadcast_rows: int = 100_000
