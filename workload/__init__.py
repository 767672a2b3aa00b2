"""Registered queries over the driver tables and the SQL that checks them."""


def load_queries():
    """(queries, oracles) by name."""
    from workload import catalog_queries, document_queries, drift_queries, plan_queries, preflight_queries, row_queries  # noqa: F401
    from workload.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
