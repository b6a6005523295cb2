"""Queries of the library without its corpus operators, and their SQL."""

from __future__ import annotations

from . import queries_checks, queries_pages, queries_people, queries_records, queries_reports, queries_streams, queries_updates, queries_upkeep

QUERIES = {**queries_people.QUERIES, **queries_records.QUERIES, **queries_reports.QUERIES, **queries_upkeep.QUERIES, **queries_checks.QUERIES, **queries_pages.QUERIES, **queries_updates.QUERIES, **queries_streams.QUERIES}
ORACLES = {**queries_people.ORACLES, **queries_records.ORACLES, **queries_reports.ORACLES, **queries_upkeep.ORACLES, **queries_checks.ORACLES, **queries_pages.ORACLES, **queries_updates.ORACLES, **queries_streams.ORACLES}
