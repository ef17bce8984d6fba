"""The registered queries and the SQL that each is held against."""

from . import analytics, candidates, lab, live, patterns, registry, search, signals, stores, streams

GROUPS = (streams, signals, patterns, analytics, live, search, lab, registry, candidates, stores)
QUERIES = {name: f for g in GROUPS for name, f in g.QUERIES.items()}
ORACLES = {name: sql for g in GROUPS for name, sql in g.ORACLES.items()}
