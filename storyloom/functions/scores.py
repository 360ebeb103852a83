"""Ranking and display-size rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.settings import DEFAULTS

_LARGE, _SMALL, _SURE = 0.7, 0.3, 0.5


def age_hours(then: Column, now: Column) -> Column:
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    return F.greatest(F.lit(0.0), micros / F.lit(3.6e9))


def story_score(
    article_count: Column,
    last_article_at: Column,
    importance_avg: Column,
    now: Column,
    log_base: float = DEFAULTS.score_log_base,
    half_life_hours: float = DEFAULTS.score_half_life_hours,
    importance_floor: float = DEFAULTS.score_importance_floor,
    magnitude_cap: float | None = DEFAULTS.score_magnitude_cap,
) -> Column:
    """Capped log-size × exponential freshness × floored importance.

    A cap that is absent or not positive means no cap.
    """
    magnitude = F.ln(F.lit(1.0) + F.greatest(article_count, F.lit(0))) / F.ln(F.lit(float(log_base)))
    if magnitude_cap is not None and magnitude_cap > 0:
        magnitude = F.least(magnitude, F.lit(float(magnitude_cap)))
    freshness = F.lit(0.5)
    if half_life_hours > 0:
        decay = F.pow(F.lit(0.5), age_hours(last_article_at, now) / F.lit(float(half_life_hours)))
        freshness = F.when(last_article_at.isNull(), F.lit(0.5)).otherwise(decay)
    importance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(importance_avg, F.lit(0.0))))
    return magnitude * freshness * (F.lit(float(importance_floor)) + F.lit(1.0 - importance_floor) * importance)


def importance_bucket(importance: Column) -> Column:
    value = F.coalesce(importance, F.lit(0.0))
    return F.when(value >= _LARGE, "lg").when(value < _SMALL, "sm").otherwise("md")


def is_uncertain(confidence: Column) -> Column:
    return F.coalesce(confidence, F.lit(0.0)) < _SURE
