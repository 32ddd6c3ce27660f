"""Places of rows in an order, without one task: ranges of the order are counted apart, then rows within."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.plans.scratch import materialize


def numbered(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 among the rows of their key (never null), and ``n``, how many these are.

    ``rows`` should be a written table, as ranges are drawn from a sample. A key of any size is spread over
    ranges, and equal rows, which may take each other's places, over their input partitions.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = materialize(spread.repartitionByRange(*key, *order, "_tie").withColumn("_slot", F.spark_partition_id()), "places")
    slots = placed.groupBy(*key, "_slot").agg(F.count("*").alias("_rows"))  # a row per range and key in it
    whole = Window.partitionBy(*key)
    slots = slots.select(*key, "_slot", F.sum("_rows").over(whole).alias("n"), (
        F.sum("_rows").over(whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_before"))
    inside = placed.withColumn("_at", F.row_number().over(Window.partitionBy(*key, "_slot").orderBy(*order, "_tie")))
    return inside.join(slots, [*key, "_slot"]).select(*rows.columns, (F.col("_before") + F.col("_at") - 1).alias("pos"), "n")
