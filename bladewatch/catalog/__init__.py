"""Registered queries and the SQL that states their expected results."""

from __future__ import annotations


def _modules():
    from bladewatch.catalog import chart_queries, data_queries, decision_queries, flow_queries, model_queries

    return data_queries, decision_queries, chart_queries, flow_queries, model_queries


def all_queries() -> dict:
    return {name: fn for module in _modules() for name, fn in module.QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
