"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local session, whose driver
    and executors are one process, may do without it and then gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="polyweave-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names made of ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"__{name}" in taken:
            name += "_"
        out.append(f"__{name}")
    return out


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text column; null counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def by_slices(convert, kind: pa.DataType, *columns: pa.Array, size: int = 500) -> pa.Array:
    """``convert`` of every row of the columns as an array.  Only ``size`` rows at a time are
    Python objects, so long texts in a large batch do not pile up."""
    parts = []
    for at in range(0, len(columns[0]), size):
        rows = zip(*(c.slice(at, size).to_pylist() for c in columns))
        parts.append(pa.array([convert(*row) for row in rows], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
