"""Registered queries over the given tables, with the SQL they must agree with."""
import importlib

GROUPS = ("log_queries", "graph_queries", "corpus_queries", "attribution_queries", "similarity_queries", "stream_queries")


def load():
    """(plans, reference SQL) of every registered query."""
    from vidimus.plans import registry

    for group in GROUPS:
        importlib.import_module(f"vidimus.plans.{group}")
    return registry.PLANS, registry.SQL
