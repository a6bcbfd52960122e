"""All queries of the engine, each with its DuckDB twin where SQL can say the same."""

from __future__ import annotations

from quern.plans import q_filters, q_rates, q_ranking, q_stats, q_sweep, q_text

MODULES = (q_filters, q_text, q_rates, q_ranking, q_sweep, q_stats)
QUERIES = {name: fn for m in MODULES for name, fn in m.Q.items()}
SQL = {name: sql for m in MODULES for name, sql in m.S.items()}
FLAGSHIP = "two_judge_filter_reasons"
