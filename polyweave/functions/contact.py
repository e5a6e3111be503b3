"""Pairwise geometry of two placed blocks, as column expressions.

A block is described by a struct column ``struct<sites array<point>, refs array<rotation>,
turns array<rotation>, r_min, r_max>``; ``refs[i]`` turns site i into reference position and
``turns[i]`` is applied to a block (in reference orientation) that is attached to site i.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..blocks import FACE_TOLERANCE, OVERLAP_SLACK
from .rotation import let, motions, rotate_points, sub_points


def attachment(x_i: Column, turn_i: Column, x_j: Column, ref_j: Column, dim: int):
    """Offset and rotation of a block whose site j is glued onto site i: ``(dx, dpsi)``."""
    m = motions(dim)
    dpsi = m.mul(turn_i, ref_j)
    return sub_points(x_i, m.rotate(x_j, dpsi), m.axes), dpsi


def site_position(x: Column, psi: Column, site: Column, dim: int) -> Column:
    """World position of a site of a block placed at ``x`` with rotation ``psi``."""
    m = motions(dim)
    turned = m.rotate(site, psi)
    return F.struct(*[(x[k] + turned[k]).alias(k) for k in m.axes])


def squared_norm(p: Column, dim: int) -> Column:
    axes = motions(dim).axes
    return sum((p[k] * p[k] for k in axes[1:]), p[axes[0]] * p[axes[0]])


def overlaps(dx: Column, r_min: Column, dim: int, slack: float = OVERLAP_SLACK) -> Column:
    """Centre distance test against the inner radius of the first block only."""
    return F.sqrt(squared_norm(dx, dim)) < 2 * r_min - slack


def in_reach(dx: Column, r_max_i: Column, r_max_j: Column, dim: int) -> Column:
    return F.sqrt(squared_norm(dx, dim)) <= r_max_i + r_max_j


def face_pairs(dx: Column, psi_i: Column, psi_j: Column, sites_i: Column, sites_j: Column,
               dim: int, tolerance: float = FACE_TOLERANCE) -> Column:
    """``array<struct<i,j>>`` of sites of two blocks whose centres coincide."""
    m = motions(dim)
    both = F.struct(rotate_points(sites_i, psi_i, dim).alias("i"), rotate_points(sites_j, psi_j, dim).alias("j"),
                    dx.alias("d"))

    def matches(v):
        def close(p, q):
            return F.greatest(*[F.abs(p[k] - q[k] - v["d"][k]) for k in m.axes]) < tolerance
        return F.flatten(F.transform(v["i"], lambda p, i: F.filter(
            F.transform(v["j"], lambda q, j: F.when(close(p, q), F.struct((i + 1).alias("i"), (j + 1).alias("j")))),
            lambda t: t.isNotNull())))

    return let(both, matches)


def contact_status(dx: Column, psi_i: Column, psi_j: Column, block_i: Column, block_j: Column,
                   dim: int) -> Column:
    """``struct<ok, pairs>``: not ok on overlap, pairs of coinciding faces when in reach."""
    none = F.array().cast("array<struct<i:int,j:int>>")

    def status(v):
        reach = in_reach(v["dx"], v["a"]["r_max"], v["b"]["r_max"], dim)
        clash = reach & overlaps(v["dx"], v["a"]["r_min"], dim)
        pairs = face_pairs(v["dx"], v["pi"], v["pj"], v["a"]["sites"], v["b"]["sites"], dim)
        return F.struct((~clash).alias("ok"), F.when(reach & ~clash, pairs).otherwise(none).alias("pairs"))

    return let(F.struct(dx.alias("dx"), psi_i.alias("pi"), psi_j.alias("pj"), block_i.alias("a"), block_j.alias("b")), status)
