"""The queries of this folder and their SQL."""

from __future__ import annotations

from . import alignment, chat, collocations, decontamination, html_text, lexicon, licenses, neardup, packing, pii, quality, token_files, toxicity

MODULES = (packing, pii, token_files, neardup, licenses, quality, chat, decontamination, html_text, toxicity, alignment, lexicon, collocations)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
