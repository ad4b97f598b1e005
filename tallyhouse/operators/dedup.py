"""Keep one row per key."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under ``order``, which must be total within a key.

    The filter sits directly on ROW_NUMBER, so Spark limits each key to one row per map task
    before the shuffle; a key holding a large share of all rows sends one row per task.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", position).filter("__rn = 1").drop("__rn")


def total_order(df: DataFrame, leading: Sequence[str], keys: Sequence[str] = ()) -> list[Column]:
    """``leading`` columns first, then every other non-key column, NULLs lowest."""
    rest = [c for c in df.columns if c not in leading and c not in keys]
    return [F.col(c).asc_nulls_first() for c in [*leading, *rest]]
