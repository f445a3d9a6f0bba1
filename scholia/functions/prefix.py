"""Numbers and sums that run over all rows, in two levels: within ranges of rows, and over the ranges' totals. No task gets more than a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def _ranged(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """rows, written in ranges of the keys and sorted in them, with the partition and the place in it in one number."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return written(dealt.withColumn(at, F.monotonically_increasing_id()), "ranges")


def _part(at: str) -> Column:
    return F.shiftright(at, 33)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """rows with their number from 1 within the group ``by``, in order; a group of any share of the rows is spread over ranges. Rows alike in all keys are in no particular order, but in one range."""
    ranged = _ranged(rows, [*by, *order], "_at").withColumn("_part", _part("_at"))
    runs = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of a group, a row a range
    runs = runs.select(F.col("_part").alias("_p"), *[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], "_first", before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_b{i}"))
    return ranged.join(runs, same).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))


def running_total(rows: DataFrame, value: str, order: list[str], name: str = "before") -> DataFrame:
    """rows with the sum of ``value`` over all rows before them in order; null counts as 0."""
    ranged = _ranged(rows, order, "_at").withColumn("_part", _part("_at"))
    inside = F.sum(F.coalesce(value, F.lit(0))).over(Window.partitionBy("_part").orderBy("_at")) - F.coalesce(value, F.lit(0))
    totals = ranged.groupBy("_part").agg(F.sum(F.coalesce(value, F.lit(0))).alias("_t"))
    totals = totals.select("_part", (F.sum("_t").over(Window.orderBy("_part")) - F.col("_t")).alias("_before"))  # a row a range
    return ranged.withColumn("_inside", inside).join(F.broadcast(totals), "_part").select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))
