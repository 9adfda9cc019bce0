"""Registered queries on the given tables, and the SQL that says the same."""

from __future__ import annotations

from brolga.plans import diarization, enrolment, evaluation, frames, further, more, sources, streams, windows

QUERIES: dict = {}
ORACLES: dict = {}
for module in (frames, windows, evaluation, diarization, more, further, enrolment, streams, sources):
    for name, (query, sql) in module.ALL.items():
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
