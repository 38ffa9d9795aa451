"""Every query of the library over the standard tables, by name, and its SQL."""

from __future__ import annotations

from corpusloom.plans import corpus, evals, runs

QUERIES: dict = {**corpus.QUERIES, **evals.QUERIES, **runs.QUERIES}
ORACLES: dict[str, str] = {**corpus.ORACLES, **evals.ORACLES, **runs.ORACLES}
