"""Enumerations and limits of the event model."""

from __future__ import annotations

#: Fixed values.
CLEAR, DEBUG, INFO, WARNING, ERROR, CRITICAL = range(6)
NEW, ACKNOWLEDGED, SUPPRESSED, CLOSED, CLEARED, DROPPED, AGED = range(7)
OPEN_STATUSES = (NEW, ACKNOWLEDGED, SUPPRESSED)
CLOSED_STATUSES = (CLOSED, CLEARED, AGED)
SEVERITY_NAMES = ("CLEAR", "DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
STATUS_NAMES = ("NEW", "ACKNOWLEDGED", "SUPPRESSED", "CLOSED", "CLEARED", "DROPPED", "AGED")
LIMITS = {"fingerprint": 255, "event_class": 128, "agent": 64, "summary": 255, "message": 4096, "user_name": 32, "element_title": 255}
DEFAULT_DETAILS = {
    "priority": "INTEGER", "production_state": "INTEGER", "ip_address": "IP_ADDRESS", "location": "PATH", "groups": "PATH",
    "systems": "PATH", "device_class": "PATH"
}
MIGRATE_DETAIL = "tidemark.migrate_update_time"


def severities_below(severity: int) -> list[int]:
    """The severities under one, in order."""
    return list(range(CLEAR, severity))


def name_of(names: tuple[str, ...], value: str) -> int:
    """The number of a severity or status by its name, in any case, with or without its family's prefix."""
    plain = value.upper().removeprefix("SEVERITY_").removeprefix("STATUS_")
    if plain not in names:
        raise ValueError(f"no such name: {value}")
    return names.index(plain)
