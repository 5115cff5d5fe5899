"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from tidewright.plans import extras, ingest, knowledge, live, mapping, network, olap, rows, spatial, vessels

MODULES = (olap, spatial, vessels, knowledge, live, extras, mapping, ingest, network, rows)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
