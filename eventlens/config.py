"""Run settings. Everything that a deployment may change is a field with a default."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import SparkSession

from eventlens import fixed_values as fv


@dataclass(frozen=True)
class Settings:
    games: tuple[str, ...] = ("alpha", "beta")
    k: int = 10
    calendar_start: date = date(2024, 1, 1)
    calendar_end: date = date(2030, 12, 31)
    raw_retention_days: int = 90
    replay_window_s: int = 300
    key_per_minute: int = 600
    key_burst_per_minute: int = 1200
    ip_per_minute: int = 120
    ip_burst_per_minute: int = 240
    freshness_target_s: int = 900
    session_idle_s: int = fv.SESSION_IDLE_SECONDS


def use_utc(spark: SparkSession) -> SparkSession:
    """Dates are UTC dates everywhere, so the session time zone has to be UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
