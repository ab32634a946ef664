"""Running positions over groups of any size, without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.joins import measured
from pulseframe.session import materialize

BUCKET_ROWS = 1 << 20


def with_record_idx(df: DataFrame, by: str = "source_file", order: str = "line_no",
                    out: str = "record_idx", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """0-based gapless position of each row in its ``by`` group, following the integer column ``order``.

    A group is cut into buckets of ``order`` values, so even a file with a third of all rows is
    numbered by many tasks. Bucket sizes come from a partial aggregation and are summed up per group.
    """
    bucket = F.floor(F.col(order) / F.lit(bucket_rows))
    keyed = df.withColumn("__bucket", bucket)
    earlier = (
        Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = (
        keyed.groupBy(by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
        .select(by, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )
    inside = F.row_number().over(Window.partitionBy(by, "__bucket").orderBy(order)) - F.lit(1)
    return (
        keyed.withColumn("__inside", inside)
        .join(sizes, [by, "__bucket"])
        .withColumn(out, (F.col("__before") + F.col("__inside")).cast("bigint"))
        .drop("__bucket", "__inside", "__before")
    )


def sorted_positions(df: DataFrame, order: list[Column], groups: list[str] | None = None,
                     out: str = "position") -> DataFrame:
    """0-based position of each row in the sort order, per group or over the whole table.

    Rows are range-partitioned on (groups, order), so one hot group spreads over many tasks. The sorted
    rows are written once: their physical order must not change between counting and numbering.
    """
    groups = groups or []
    keys = [F.col(g).asc_nulls_last() for g in groups] + list(order)
    ranged = (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id())
    )
    table = materialize(ranged, "sorted")
    slot = groups + ["__part"]
    earlier = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        table.groupBy(*slot)
        .agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .select(*[F.col(c).alias(f"__k_{c}") for c in slot], "__first", "__before")
    )
    sizes = measured(sizes, "sizes")  # one row a group and partition: the rows are not shuffled again
    same = [table[c].eqNullSafe(sizes[f"__k_{c}"]) for c in slot]
    numbered = table.join(sizes, same)
    return numbered.withColumn(
        out, (F.col("__before") + F.col("__row") - F.col("__first")).cast("bigint")
    ).select(*df.columns, out)
