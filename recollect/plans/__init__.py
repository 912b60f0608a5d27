"""Registered queries by family, and their oracle SQL."""

from importlib import import_module

FAMILIES = ["timeline", "dedup", "text", "retrieval", "store", "streams"]


def _load():
    from recollect.plans import registry
    for family in FAMILIES:
        import_module(f"recollect.plans.{family}")
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
