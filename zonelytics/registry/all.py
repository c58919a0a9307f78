"""Importing this module registers every query."""

from zonelytics.registry import events, models, ops, reports, star, streams  # noqa: F401
