"""Registered queries with their SQL equivalents."""

from __future__ import annotations

from webgauge.queries import capture, net, pages, rules, site, streams, text
from webgauge.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "capture", "net", "pages", "rules", "site", "streams", "text"]
