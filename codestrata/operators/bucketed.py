"""Ordered look-back and look-ahead that survive hot keys.

A plain window puts a whole key into one task. These helpers split each key into
buckets of the order column (days, for times), answer inside the bucket, and carry one
aggregated row per bucket across buckets, so a task holds one bucket of a key at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import checkpointed


def join_keys_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be null; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def previous_row(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: list[str], out: str) -> DataFrame:
    """Add `out`, a struct of the previous row's `values` in `order` within `keys`; null for a key's first row.

    `bucket` must not decrease along `order`. Ties in `order` are resolved by its later columns,
    which should therefore end in a unique one.
    """
    value = F.struct(*values)
    rows = df.withColumn("__bucket", bucket)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    rows = rows.withColumn("__inside", F.lag(value).over(inside))
    tails = rows.groupBy(*keys, "__bucket").agg(F.max_by(value, F.struct(*order)).alias("__tail"))
    across = Window.partitionBy(*keys).orderBy("__bucket")
    carried = tails.select(*keys, "__bucket", F.lag("__tail").over(across).alias("__carried"))
    joined = join_keys_null_safe(rows, carried, [*keys, "__bucket"], "left")
    return joined.withColumn(out, F.coalesce("__inside", "__carried")).drop("__inside", "__carried", "__bucket")


def first_after(
    points: DataFrame, marks: DataFrame, keys: list[str], point_at: str, mark_at: str, values: list[str], out: str, bucket: str | Callable[[Column], Column] = "day"
) -> DataFrame:
    """As-of join forward: for each point the first mark of the same keys strictly after it.

    Adds `out`, a struct of the mark's `values`, null where no later mark exists. Of marks at the
    same instant the one with the smallest `values` is taken. Rows with a null key or time get null. `bucket` is
    the unit of time, or a function that does not decrease, by which hot keys are split.
    """
    at = F.date_trunc(bucket, F.col("__at")) if isinstance(bucket, str) else bucket(F.col("__at"))
    mark_value = F.struct(*values)
    p = points.withColumns({"__at": F.col(point_at), "__mark": F.lit(None).cast(marks.select(mark_value).schema[0].dataType), "__tag": F.lit(0)})
    m = (
        marks.where(F.col(mark_at).isNotNull())
        .groupBy(*keys, F.col(mark_at).alias("__at"))
        .agg(F.min(mark_value).alias("__mark"))
        .withColumn("__tag", F.lit(1))
    )
    both = p.unionByName(m, allowMissingColumns=True).withColumn("__bucket", at)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(F.desc("__at"), "__tag").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__inside", F.last("__mark", ignorenulls=True).over(inside)).where("__tag = 0")
    heads = m.withColumn("__bucket", at).groupBy(*keys, "__bucket").agg(F.min_by("__mark", "__at").alias("__head"))
    days = both.select(*keys, "__bucket").distinct().withColumn("__head", F.lit(None).cast(heads.schema["__head"].dataType))
    across = Window.partitionBy(*keys).orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        heads.unionByName(days)
        .groupBy(*keys, "__bucket")
        .agg(F.first("__head", ignorenulls=True).alias("__head"))
        .select(*keys, "__bucket", F.last("__head", ignorenulls=True).over(across).alias("__carried"))
    )
    joined = both.join(carried, [*keys, "__bucket"], "left")
    return joined.select(*points.columns, F.coalesce("__inside", "__carried").alias(out))


def running(df: DataFrame, keys: list[str], order: list, out: str, value: Column | None = None) -> DataFrame:
    """Add `out`, the running sum of `value` (by default the row's number from 1) in `order` within `keys`.

    Rows are range-partitioned and sorted once, so no task holds a key: a task sums its own rows, and gets what the
    partitions before it hold of the key, one aggregated row for each. `order` should end in a unique column.
    """
    value = F.lit(1).cast("long") if value is None else value
    sorted_rows = df.withColumn("__value", value).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = checkpointed(sorted_rows.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    sums = rows.groupBy(*keys, "__part").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__carried"))
    inside = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    joined = join_keys_null_safe(rows.withColumn("__inside", F.sum("__value").over(inside)), carried, [*keys, "__part"], "left")
    return joined.withColumn(out, F.col("__inside") + F.col("__carried")).drop("__inside", "__carried", "__value", "__at", "__part")
