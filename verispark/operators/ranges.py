"""Running values over rows in order, spread over tasks whatever the keys' sizes.

Rows are range-sorted by key and order, so a key with half of all rows lies in many parts. Each part
computes its own running values; what a part's first key had in earlier parts, one row a part at
most, is added to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpointed

PART = "__part"


def _parts(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_parts(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, Window]:
    """rows with their part, and the window over a part's rows of one key up to the current one; equal orders share a part."""
    ranged = rows.repartitionByRange(_parts(rows), key, *order).withColumn(PART, F.spark_partition_id())
    return ranged, Window.partitionBy(PART, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _joined(rows: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Only the first key of a part has earlier parts, so before has at most a row for each part and is broadcast."""
    b = before.withColumnsRenamed({PART: "__p", key: "__k"})
    return rows.join(F.broadcast(b), (F.col(PART) == F.col("__p")) & F.col(key).eqNullSafe(F.col("__k")), "left").drop("__p", "__k", PART)


def running_sums(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with the running sum of each column of whole numbers, over the rows of their key in order."""
    ranged, window = in_parts(rows, key, order)
    # written once: the parts must be the same for both readers
    local = checkpointed(ranged.withColumns({k: F.sum(c).over(window) for k, c in sums.items()}))
    own = local.groupBy(PART, key).agg(*(F.sum(c).alias(f"__before_{k}") for k, c in sums.items()))
    w = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = own.select(PART, key, F.lag(PART).over(Window.partitionBy(key).orderBy(PART)).alias("__earlier"), *(F.sum(f"__before_{k}").over(w).alias(f"__before_{k}") for k in sums)).where("__earlier IS NOT NULL").drop("__earlier")
    out = _joined(local, before, key)
    return out.withColumns({k: F.col(k) + F.coalesce(F.col(f"__before_{k}"), F.lit(0)) for k in sums}).drop(*(f"__before_{k}" for k in sums))


def carried_forward(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """rows with value filled by the last one that isn't null, over the rows of their key in order."""
    ranged, window = in_parts(rows, key, order)
    local = checkpointed(ranged.withColumn(value, F.last(value, ignorenulls=True).over(window)))
    last = local.groupBy(PART, key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))
    w = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(PART, key, F.last(value, ignorenulls=True).over(w).alias("__before")).where("__before IS NOT NULL")
    return _joined(local, before, key).withColumn(value, F.coalesce(value, "__before")).drop("__before")
