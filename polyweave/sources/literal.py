"""Definition-sized literal tables (rules typed by hand, shapes, block types)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Rows as an in-plan relation; Spark needs no job to read or broadcast it."""
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows)) or [[] for _ in arrow]
    data = [pa.array(list(values), type=field.type) for values, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.table(data, schema=arrow), fields)
