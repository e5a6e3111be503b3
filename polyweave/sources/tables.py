"""Bond lists and pose pairs derived from the star-schema, event and text tables.

Every function reads a whole table, keeps only the columns it needs, and maps each row to one
bond of the system its key names.  The catalogs built from them have one system per order,
customer or conversation, so their number grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..blocks import CUBE, HEXAGON, SQUARE, TRIANGLE, BlockLibrary
from .systems import SystemCatalog


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def widen(df: DataFrame) -> DataFrame:
    """Use all cores for per-row work that costs far more than reading, if the table has few splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


ORDER_BOND = {
    "sys": "l_orderkey",
    "species_i": "CAST(l_partkey % 3 + 1 AS INT)",
    "site_i": "CAST(l_suppkey % 3 + 1 AS INT)",
    "species_j": "CAST(l_linenumber % 3 + 1 AS INT)",
    "site_j": "CAST(CAST(l_quantity AS INT) % 3 + 1 AS INT)",
}
CUSTOMER_BOND = {
    "sys": "o_custkey",
    "species_i": "CAST(o_orderkey % 2 + 1 AS INT)",
    "site_i": "CAST(CAST(floor(o_totalprice) AS BIGINT) % 6 + 1 AS INT)",
    "species_j": "CAST(month(o_orderdate) % 2 + 1 AS INT)",
    "site_j": "CAST(CAST(floor(o_totalprice) AS BIGINT) % 6 + 1 AS INT)",
}
TALK_BOND = {
    "sys": "conv_id",
    "species_i": "CAST(turn % 2 + 1 AS INT)",
    "site_i": "CAST(length(text) % 4 + 1 AS INT)",
    "species_j": "CAST(length(role) % 2 + 1 AS INT)",
    "site_j": "CAST(CAST(floor(length(text) / 4) AS BIGINT) % 4 + 1 AS INT)",
}
DAY_BOND = {
    "sys": "CAST(user_id * 100 + day(ts) AS BIGINT)",
    "species_i": "CAST(event_id % 2 + 1 AS INT)",
    "site_i": "CAST(hour(ts) % 6 + 1 AS INT)",
    "species_j": "CAST(length(event_type) % 2 + 1 AS INT)",
    "site_j": "CAST(minute(ts) % 6 + 1 AS INT)",
}


def bonds(spark: SparkSession, folder: str, table: str, columns: dict) -> DataFrame:
    return read(spark, folder, table).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def order_bonds(spark, folder) -> DataFrame:
    """One triangle system per order, one bond per line item."""
    return bonds(spark, folder, "lineitem", ORDER_BOND)


def order_systems(spark, folder) -> SystemCatalog:
    return SystemCatalog.from_bonds(BlockLibrary.uniform(TRIANGLE, 3), order_bonds(spark, folder))


def customer_systems(spark, folder) -> SystemCatalog:
    """One cube system per customer, one same-site bond per order."""
    return SystemCatalog.from_bonds(BlockLibrary.uniform(CUBE, 2),
                                    bonds(spark, folder, "orders", CUSTOMER_BOND))


def talk_systems(spark, folder) -> SystemCatalog:
    """One square system per conversation, one bond per turn."""
    return SystemCatalog.from_bonds(BlockLibrary.uniform(SQUARE, 2),
                                    bonds(spark, folder, "conversations", TALK_BOND))


def day_systems(spark, folder) -> SystemCatalog:
    """One hexagon system per user and day of month, one bond per event."""
    return SystemCatalog.from_bonds(BlockLibrary.uniform(HEXAGON, 2),
                                    bonds(spark, folder, "events", DAY_BOND))
