"""Row numbers within groups that may be too large for one task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paywake.functions.joins import join_on
from paywake.plans.materialize import materialize

# Up to this many rows per group Spark prunes a row_number filter before its shuffle.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def split_positions(df: DataFrame, group: list[str], order: list[Column],
                    number: str = "row_no", size: str | None = None) -> DataFrame:
    """Number the rows of every group 1, 2, … in ``order`` without bringing a group into one task.

    The rows are range-partitioned by (group, order), so a large group spans many partitions. Each
    row's place in its partition plus the sizes of the group's earlier partitions is its number.
    The partitioned rows are written first: their places must not change between the two passes.
    ``order`` must be total, or rows that tie may swap numbers.
    """
    keys = [F.col(g).asc_nulls_first() for g in group]
    placed = materialize(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", 33)),
        "positions",
    )
    parts = placed.groupBy(*group, "_part").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # one row per (group, partition) it spans
    in_group = W.partitionBy(*group)
    before = in_group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        *group, "_part", "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(in_group).alias("_size"),
    )
    columns = [F.col(c) for c in df.columns]
    columns.append((F.col("_before") + F.col("_place") - F.col("_first") + 1).alias(number))
    if size:
        columns.append(F.col("_size").alias(size))
    return join_on(placed, parts, [*group, "_part"]).select(*columns)


def positions(df: DataFrame, group: list[str], order: list[Column], number: str = "row_no",
              size: str | None = None, split: bool = True) -> DataFrame:
    """Row numbers (and group sizes) by split_positions, or by a window if a task can sort any group."""
    if split:
        return split_positions(df, group, order, number, size)
    in_group = W.partitionBy(*group)
    df = df.withColumn(number, F.row_number().over(in_group.orderBy(*order)).cast("long"))
    return df.withColumn(size, F.count(F.lit(1)).over(in_group)) if size else df


def select_intervals(df: DataFrame, group: list[str], interval: Column, limit: int, offset: int,
                     before: str) -> DataFrame:
    """The rows in those intervals of each group that hold its rows offset+1 … offset+limit.

    ``before`` is the number of rows of the group that come before the selected ones. One hash aggregate counts the
    rows by interval; nothing is sorted but the counts.
    """
    cut = df.withColumn("_interval", interval)
    counts = cut.groupBy(*group, "_interval").agg(F.count(F.lit(1)).alias("_rows"))
    whole = W.partitionBy(*group)
    upto = F.sum("_rows").over(whole.orderBy("_interval"))
    chosen = (
        counts.withColumn("_upto", upto)
        .where((F.col("_upto") > offset) & (F.col("_upto") - F.col("_rows") < offset + limit))
        .select(*group, "_interval", F.min(F.col("_upto") - F.col("_rows")).over(whole).alias(before))
    )
    return join_on(cut, chosen, [*group, "_interval"]).drop("_interval")


def page_of_group(df: DataFrame, group: list[str], order: list[Column], limit: int, offset: int = 0,
                  number: str = "row_no", interval: Column | None = None) -> DataFrame:
    """Rows offset+1 … offset+limit of every group.

    A page that ends within GROUP_LIMIT is cut by each map task before the shuffle. One that ends beyond is selected
    first: ``interval``, a number that never falls along ``order`` and takes a bounded number of values, leaves only
    the rows of the intervals that the page touches, and those are numbered by split_positions.
    """
    last = offset + limit
    page = (F.col(number) <= last) & (F.col(number) > offset)
    if last <= int(df.sparkSession.conf.get(GROUP_LIMIT)):
        return positions(df, group, order, number, split=False).where(page)
    near = select_intervals(df, group, F.lit(0) if interval is None else interval, limit, offset, "_skipped")
    placed = split_positions(near, group, order, number)
    return placed.withColumn(number, F.col(number) + F.col("_skipped")).drop("_skipped").where(page)
