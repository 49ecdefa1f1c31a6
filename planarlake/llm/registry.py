"""All queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import decontaminate, langid, lexical, licenses, linededup, lm, mixing, packing, quality, simhash, spelling, suffixes, tokens

MODULES = (decontaminate, langid, lexical, licenses, linededup, lm, mixing, packing, quality, simhash, spelling, suffixes, tokens)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
