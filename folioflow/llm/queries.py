"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, conversations, decontaminate, fixity, langid, lengths, licenses, maintext, packing, pii, quality, simhash, suffixes

MODULES = (fixity, lengths, maintext, licenses, quality, langid, decontaminate, pii, simhash, packing, suffixes, alignment, conversations)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
