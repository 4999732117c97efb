"""All registered queries, and SQL for those that it can express."""

from __future__ import annotations

from . import behaviour, recall, service

QUERIES = {**recall.QUERIES, **behaviour.QUERIES, **service.QUERIES}
ORACLES = {**recall.ORACLES, **behaviour.ORACLES, **service.ORACLES}
