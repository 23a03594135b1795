from eventlens.streaming.jobs import (
    idle_sessions,
    ingest_stream,
    replay_stream,
    request_stream,
    session_days,
    session_days_stream,
)
from eventlens.streaming.stateful import (
    alert_stream,
    live_alerts,
    numbered_sessions,
    orphan_stream,
    replay_windows,
)

__all__ = [
    "alert_stream",
    "idle_sessions",
    "ingest_stream",
    "live_alerts",
    "numbered_sessions",
    "orphan_stream",
    "replay_stream",
    "replay_windows",
    "request_stream",
    "session_days",
    "session_days_stream",
]
