"""The registered queries of the domain, each with the SQL that checks it."""

from tidemark.catalog import analytics, planning, reports, state, streams, text, upkeep

MODULES = (state, analytics, text, reports, planning, streams, upkeep)
QUERIES = {name: q for m in MODULES for name, q in m.BOOK.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.BOOK.oracles.items()}
