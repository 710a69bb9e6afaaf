"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from .operators import annotate, contract, corpus, dataset, emission, enrich, grammar, ledger, media, notes, qc, skeleton, store, tree
from .streaming import queues

MODULES = (corpus, dataset, emission, contract, store, ledger, media, grammar, skeleton, notes, annotate, enrich, tree, qc, queues)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
