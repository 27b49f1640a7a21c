"""Instants for tests."""

from __future__ import annotations

import datetime as dt

UTC = dt.timezone.utc


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)
