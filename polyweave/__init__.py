"""Enumeration and analysis of polyforms on Spark DataFrames."""

import sys as _sys

from pyspark.cloudpickle import register_pickle_by_value as _by_value

from .blocks import (CUBE, HEXAGON, PENTAGON, SQUARE, TRIANGLE, BlockLibrary, Shape, box, cube, polygon, polygon_of, polyhedron)
from .operators.composition import composition, compositions, isomorphic
from .plans.enumerate import polyenum, polygen
from .sources.shapes import shapes_from_table
from .sources.systems import AssemblySystem, SystemCatalog

# the Arrow helpers travel inside the UDFs, so executors need no copy of this package
_by_value(_sys.modules[__name__])

__all__ = ["AssemblySystem", "BlockLibrary", "CUBE", "HEXAGON", "PENTAGON", "SQUARE", "Shape", "SystemCatalog",
           "TRIANGLE", "box", "composition", "compositions", "cube", "isomorphic", "polyenum", "polygen", "polygon", "polygon_of", "polyhedron",
           "shapes_from_table"]
