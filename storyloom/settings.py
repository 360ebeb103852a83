"""Defaults of every tunable rule.  Operators take them as arguments; a batch of None is everything."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Tunables:
    # ingest
    max_entries_per_feed: int = 15
    min_words: int = 350
    hard_error_words: int = 50
    failure_retry_days: int = 7
    fetch_interval_minutes: int = 30
    # lifecycle
    ttl_hours: int = 48
    revive_window_days: int = 30
    revive_recent_days: int = 7
    purge_archived_after_days: int = 180
    purge_archived_batch: int | None = None
    purge_empty_floor_seconds: int = 30
    purge_empty_batch: int | None = None
    # score
    score_log_base: float = 2.0
    score_half_life_hours: float = 8.0
    score_importance_floor: float = 0.5
    score_magnitude_cap: float = 6.0
    # chat
    chat_articles: int = 20
    chat_chars: int = 3000
    chat_sources: int = 5
    # grouping
    require_distinct_sources: bool = True
    dedup_confidence: float = 0.7
    recluster_days: int = 14
    recluster_limit: int | None = None
    alike_percent: int = 50
    cooling_after_days: int = 3
    regroup_batch: int | None = None


DEFAULTS = Tunables()
