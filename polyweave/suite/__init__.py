"""Registered queries over the given tables, each with its SQL counterpart where SQL can say it."""

from . import geometry, graphs, shapes, structures, systems


def registered() -> dict:
    """name -> (callable(spark, folder), SQL text or None)"""
    return {**systems.QUERIES, **geometry.QUERIES, **structures.QUERIES, **shapes.QUERIES, **graphs.QUERIES}
