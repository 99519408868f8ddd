"""Dealing rows out before each becomes many."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame) -> DataFrame:
    """The rows by the hash of all their values, over some tasks a core: a file may hold them all in one piece, and a number that is given is not coalesced by bytes, which say little of the work."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *rows.columns)
