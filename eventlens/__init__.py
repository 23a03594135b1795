"""Privacy-safe telemetry analytics on PySpark DataFrames."""

from eventlens.config import Settings

__all__ = ["Settings"]
