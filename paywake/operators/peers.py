"""Merchants compared with the other merchants of their category."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paywake.functions.columns import rate
from paywake.functions.joins import join_on
from paywake.plans.positions import page_of_group, positions
from paywake.plans.value_counts import value_counts

# Ranked metric and the percentile column it gives.
PERCENTILES = {
    "final_success_rate": "success_rate_percentile",
    "recovery_rate": "recovery_rate_percentile",
    "aov": "aov_percentile",
    "successful_volume": "volume_percentile",
}

# Fixed band edges: a merchant's band is the number of edges its successful volume reaches.
VOLUME_BANDS = (1e8, 1e9, 1e10, 1e11)


def volume_band(edges=VOLUME_BANDS) -> Column:
    reached = (F.when(F.col("successful_volume") >= edge, 1).otherwise(0) for edge in edges)
    return reduce(lambda a, b: a + b, reached)


def _window_percentiles(merchants: DataFrame, group: list[str]) -> DataFrame:
    """Four windows over one partitioning: one exchange. NULL metrics rank last."""
    in_group = W.partitionBy(*group)
    return merchants.withColumns({
        name: F.percent_rank().over(in_group.orderBy(F.col(metric).asc_nulls_last()))
        for metric, name in PERCENTILES.items()
    })


def _counted_percentiles(merchants: DataFrame, group: list[str]) -> DataFrame:
    """The same percentiles without sorting a group: a value's rank is the number of lower values.

    The four metrics of a merchant are rows of one histogram, and its percentiles meet it again by value.
    """
    tall = merchants.unpivot(["merchant_key", *group], list(PERCENTILES), "metric", "value")
    keys = [*group, "metric"]
    counts = value_counts(tall, keys, "value")
    percent = F.coalesce(rate(F.col("lower"), F.col("size") - 1), F.lit(0.0))
    wide = (
        join_on(tall, counts.select(*keys, "value", percent.alias("percent")), [*keys, "value"])
        .groupBy("merchant_key")
        .agg(*(F.max(F.when(F.col("metric") == metric, F.col("percent"))).alias(name)
               for metric, name in PERCENTILES.items()))
    )
    return join_on(merchants, wide, ["merchant_key"])


def peer_metrics(merchants: DataFrame, band: bool = False, min_peers: int = 0,
                 split: bool = True) -> DataFrame:
    """Merchant rows with four percentiles inside the category.

    ``band`` narrows the peer group to the merchant's volume band and adds it as a column;
    ``min_peers`` blanks the percentiles of smaller groups. A group may span many tasks;
    ``split=False`` sorts each in one task, for groups known to be small.
    """
    group = ["category_id"]
    if band:
        merchants = merchants.withColumn("volume_band", volume_band())
        group.append("volume_band")
    ranked = (_counted_percentiles if split else _window_percentiles)(merchants, group)
    if min_peers:
        sizes = merchants.groupBy(*group).agg(F.count(F.lit(1)).alias("peers"))
        kept = {name: F.when(F.col("peers") >= min_peers, F.col(name)) for name in PERCENTILES.values()}
        columns = [kept.get(c, F.col(c)).alias(c) for c in ranked.columns]
        ranked = join_on(ranked, sizes, group).select(*columns)
    return ranked


def peer_table(peers: DataFrame, k: int = 50, members: DataFrame | None = None) -> DataFrame:
    """The first k merchants of every category by success rate.

    Every merchant of a category sees the same list, so it is made once per category. ``members``
    (merchants with merchant_key and category_id) looks the list up for each of them.
    """
    order = [F.col("final_success_rate").desc_nulls_last(), F.col("merchant_key").asc_nulls_first()]
    listed = (
        page_of_group(peers, ["category_id"], order, k, number="peer_no")
        .select("category_id", "peer_no", "merchant_key", "sessions", "successful_volume", "aov",
                "final_success_rate", "success_rate_percentile", "volume_percentile", "aov_percentile")
    )
    if members is None:
        return listed
    asked = members.select(F.col("merchant_key").alias("member_key"), "category_id")
    return asked.join(listed, "category_id")


def peer_rank(merchants: DataFrame, split: bool = True) -> DataFrame:
    """Place of every merchant in its category by success rate, NULL counting as 0."""
    score = F.coalesce("final_success_rate", F.lit(0.0))
    order = [score.desc(), F.col("merchant_key").asc_nulls_first()]
    slim = merchants.select("category_id", "merchant_key", "final_success_rate")
    return positions(slim, ["category_id"], order, "peer_rank", "peer_count", split)


def peer_median(merchants: DataFrame, metric: str = "final_success_rate") -> DataFrame:
    """Each merchant's metric next to the median of its category; merchants without it do not count.

    The median is the value, or the mean of the two values, at which the cumulative count reaches the middle.
    """
    known = merchants.where(F.col(metric).isNotNull()).select("category_id", metric)
    counts = value_counts(known, ["category_id"], metric)
    low, high = F.floor((F.col("size") + 1) / 2), F.floor((F.col("size") + 2) / 2)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("lower") < place) & (place <= F.col("lower") + F.col("rows")), F.col(metric)))

    medians = counts.groupBy("category_id").agg(
        ((at(low) + at(high)) / 2).alias("peer_median"), F.max("size").alias("peers"))
    return join_on(merchants, medians, ["category_id"], "left").select(
        "category_id", "merchant_key", metric, "peer_median", "peers",
        (F.col(metric) - F.col("peer_median")).alias("gap_to_median"))


def merchant_overview(merchants: DataFrame, peers: DataFrame) -> DataFrame:
    """A merchant's metrics with its own percentiles."""
    return join_on(merchants, peers.select("merchant_key", *PERCENTILES.values()), ["merchant_key"], "left")
