"""All registered queries of the engine and their SQL twins."""

from __future__ import annotations

from . import details, feedback, files, keyed, listing, search, store, structure, text

PLANS = (search, feedback, store, text, listing, structure, details, files, keyed)
QUERIES = {name: q for p in PLANS for name, q in p.QUERIES.items()}
ORACLE = {name: sql for p in PLANS for name, sql in p.ORACLE.items()}
