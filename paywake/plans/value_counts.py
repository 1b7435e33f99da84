"""Ranks and cumulative counts from histograms of distinct values, for groups of any size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paywake.functions.joins import join_on

# Bins per doubling of a value, and a number beyond the least and greatest bin of a double (2^-1074 to 2^1024).
BINS_PER_OCTAVE = 64
FARTHEST = 70_000


def value_bin(value: Column) -> Column:
    """Number of an interval of values: it never falls as the value rises. NaN and then NULL come last.

    Bins are logarithmic, so rates and volumes alike spread over many, and there are 280,000 at most.
    """
    def distance(magnitude: Column) -> Column:
        octaves = F.log2(F.least(magnitude, F.lit(1.7e308)))
        return F.floor(octaves * BINS_PER_OCTAVE) + FARTHEST

    return (
        F.when(value.isNull(), 2 * FARTHEST + 1).when(F.isnan(value), 2 * FARTHEST)
        .when(value > 0, distance(value)).when(value < 0, -distance(-value)).otherwise(0).cast("long")
    )


def value_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """One row per group and distinct value: ``rows`` with it, ``lower`` rows before it, ``size`` of the group.

    NULL is a value, the last one. Rows are counted in the map tasks first, so a value that most rows share is no
    bottleneck. Running sums run inside bins of values and over the bins: no group is sorted in one task.
    """
    counts = df.withColumn("_bin", value_bin(F.col(value).cast("double"))).groupBy(*group, "_bin", value).agg(
        F.count(F.lit(1)).alias("rows"))
    in_bin = W.partitionBy(*group, "_bin")
    ascending = F.col(value).asc_nulls_last()
    counts = counts.withColumns({
        "_lower": F.sum("rows").over(in_bin.orderBy(ascending)) - F.col("rows"),
    })
    bins = counts.groupBy(*group, "_bin").agg(F.sum("rows").alias("_rows"))
    whole = W.partitionBy(*group)
    bins = bins.select(
        *group, "_bin", (F.sum("_rows").over(whole.orderBy("_bin")) - F.col("_rows")).alias("_below"),
        F.sum("_rows").over(whole).alias("size"))
    return join_on(counts, bins, [*group, "_bin"]).select(
        *group, value, "rows", (F.col("_lower") + F.col("_below")).alias("lower"), "size")
