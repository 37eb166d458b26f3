"""Short forms of long results: so many rows per group, with the number of those left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group with ``place`` in it and ``left_out``, how many more the group has.

    order must be total, else ties fall as they come. Spark keeps the first rows of a group in each task before it moves
    any; the sizes come from a count of their own.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    first = rows.withColumn("place", place).where(F.col("place") <= most)
    named = {k: f"_{k}" for k in keys}
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")).withColumnsRenamed(named)
    same = F.expr(" and ".join(f"{k} <=> _{k}" for k in keys))
    return first.join(sizes, same).withColumn("left_out", F.greatest(F.col("_all") - most, F.lit(0))).drop("_all", *named.values())


def across(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """Groups in order of their key until ``most`` rows are shown: key, shown and left_out of every group.

    Rows themselves stay where they are: what is numbered are the sizes of the groups.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # the first ``most`` groups hold at least as many rows, so no later group shows any
    first = sizes.orderBy(*order).limit(most)
    before = F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = first.withColumn("shown", F.greatest(F.least(F.col("n"), F.lit(most) - before), F.lit(0))).select(F.col(key).alias("_k"), "shown")
    return sizes.join(shown, F.expr(f"{key} <=> _k"), "left").select(key, F.coalesce("shown", F.lit(0)).cast("bigint").alias("shown"), (F.col("n") - F.coalesce("shown", F.lit(0))).alias("left_out"))


def filled(rows: DataFrame, keys: list[str], wanted: Column, order: list[Column], most: int) -> DataFrame:
    """Of each group first the rows that are wanted, then others, until there are ``most``: with their place."""
    first = F.coalesce(wanted, F.lit(False))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(first), *order)).cast("bigint")
    return rows.withColumn("place", place).where(F.col("place") <= most)
