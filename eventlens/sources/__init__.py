from eventlens.sources.batches import read_bodies, read_offline_events, read_requests
from eventlens.sources.dimensions import calendar, games, spine
from eventlens.sources.tables import (
    append_events,
    event_group,
    latest,
    publish,
    read_events,
    reset,
    stage,
)

__all__ = [
    "append_events",
    "calendar",
    "event_group",
    "games",
    "latest",
    "publish",
    "read_bodies",
    "read_events",
    "read_offline_events",
    "read_requests",
    "reset",
    "spine",
    "stage",
]
