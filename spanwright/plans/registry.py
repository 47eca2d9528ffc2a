"""Named queries over the given tables, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from spanwright.plans import corpus_queries, diagnosis_queries, general_queries, grammar_queries, induction_queries, model_queries

QUERIES: dict = {**corpus_queries.QUERIES, **grammar_queries.QUERIES, **model_queries.QUERIES, **induction_queries.QUERIES, **general_queries.QUERIES, **diagnosis_queries.QUERIES}
ORACLES: dict = {**corpus_queries.ORACLES, **grammar_queries.ORACLES, **model_queries.ORACLES, **induction_queries.ORACLES, **general_queries.ORACLES, **diagnosis_queries.ORACLES}
