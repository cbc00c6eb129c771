"""Registered queries, one module per family."""

import importlib

FAMILIES = ["vocab", "text", "features", "sampling", "sources", "wiki", "streams", "models"]


def load():
    """All queries and their SQL twins, by id."""
    from gramloom.plans import base

    for family in FAMILIES:
        importlib.import_module(f"gramloom.plans.{family}")
    return dict(base.QUERIES), dict(base.SQL)
