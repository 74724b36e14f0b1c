"""All queries of the reference's operators, and their SQL."""

from __future__ import annotations

from tallyfold.plans import q_aggregates, q_expressions, q_forecast, q_joins, q_marts, q_serve, q_sources

SECTIONS = [q_sources.section, q_expressions.section, q_joins.section, q_aggregates.section, q_marts.section, q_forecast.section, q_serve.section]
QUERIES = {name: f for s in SECTIONS for name, f in s.queries.items()}
SQL = {name: text for s in SECTIONS for name, text in s.sql.items()}
