"""The registered queries and their SQL."""

from . import catalog, functions, ingest, messages, more, search, usage

PARTS = [usage, messages, search, catalog, functions, more, ingest]
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
