"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, fill_middle, late_overwrite, licences, packing, passages, pii, quality, repeats, simhash, token_files, url_filter

MODULES = (pii, url_filter, licences, packing, repeats, exact_dedup, decontaminate, quality, token_files, simhash, passages, fill_middle, late_overwrite)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
