"""Row numbers and neighbours in a total order, without sorting a whole table or a hot key in one task.

Rows are dealt by ranges of the order and written, so each range's rows are fixed; numbers run inside a
range, and one small row a range (and key) says where it starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import write_table


def _dealt(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``rows`` with ``_range``, rising with (keys, order)."""
    return write_table(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: list[str | Column], name: str, keys: list[str] = ()) -> DataFrame:
    """``rows`` with ``name``: the place in order from 1, of each key if there are any.

    Ties are broken as Spark sorts them; make the order total for a defined result.
    """
    keys = list(keys)
    order = [F.col(c).asc() if isinstance(c, str) else c for c in order]
    rows = _dealt(rows, keys, order)
    sizes = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbers = rows.withColumn("_inside", inside).join(starts, on)
    return numbers.withColumn(name, F.col("_inside") + F.col("_ahead")).drop("_inside", "_ahead", "_range", "_r", *[f"_k{i}" for i in range(len(keys))])


def before(rows: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the greatest ``at`` under the row's own among rows of its key (null for the first).

    (key, at) must not repeat.
    """
    rows = _dealt(rows, [key], [F.col(at).asc()])
    last = rows.groupBy(key, "_range").agg(F.max(at).alias("_last"))
    ahead = Window.partitionBy(key).orderBy("_range")  # a row a range
    carried = last.select(F.col(key).alias("_k"), F.col("_range").alias("_r"), F.lag("_last").over(ahead).alias("_carry"))
    inside = F.lag(at).over(Window.partitionBy(key, "_range").orderBy(at))
    out = rows.withColumn("_inside", inside).join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    return out.withColumn(name, F.coalesce("_inside", "_carry")).drop("_inside", "_carry", "_k", "_r", "_range")
