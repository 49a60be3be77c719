"""Every operator as a query over the driver's tables, with its SQL twin."""

from __future__ import annotations

from . import analytics, graphs, retrieval, stores
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analytics", "graphs", "retrieval", "stores"]
