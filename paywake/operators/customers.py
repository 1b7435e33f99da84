"""Customers of a merchant, known by their pseudonymous card key."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paywake.functions.columns import has_text, rate, succeeded
from paywake.functions.joins import join_on
from paywake.plans.materialize import materialize

# Smallest number of orders of the two upper segments.
VIP_ORDERS, LOYAL_ORDERS = 5, 2


def _paid() -> Column:
    return F.coalesce(succeeded("try_status"), F.lit(False))


def customer_orders(attempts: DataFrame) -> DataFrame:
    """One row per merchant, card key, session and amount paid, from which all customer figures follow.

    Every buffer has a fixed width, so this is a hash aggregation, and a card with a large part of the rows is spread
    over its sessions.
    """
    paid, created = _paid(), F.col("created_at")
    return (
        attempts.where(has_text("payer_card_key"))
        .groupBy("merchant_key", F.col("payer_card_key").alias("customer"), "session_key",
                 F.when(paid, F.col("amount")).alias("paid_amount"))
        .agg(
            F.max(paid).alias("paid"),
            F.sum(F.when(paid, F.col("amount"))).alias("spend"),
            F.min(created).alias("first_seen"),
            F.max(created).alias("last_seen"),
            F.min(F.when(paid, created)).alias("first_order"),
            F.max(F.when(paid, created)).alias("last_order"),
        )
    )


def customer_profile(attempts: DataFrame, per_session: bool = False) -> DataFrame:
    """One row per merchant and card key.

    ``orders`` counts sessions with a successful try, ``all_orders`` every session. ``spend`` adds up
    successful tries, so a session that succeeded twice counts twice; ``per_session`` counts it once.
    first_seen/last_seen cover all tries, first_order/last_order the successful ones.
    """
    return profile_of(customer_orders(attempts), per_session)


def profile_of(orders: DataFrame, per_session: bool = False) -> DataFrame:
    """customer_profile from customer_orders. Counting sessions replaces two distinct counts."""
    by_session = orders.groupBy("merchant_key", "customer", "session_key").agg(
        F.max("paid").alias("paid"),
        (F.max("paid_amount") if per_session else F.sum("spend")).alias("spend"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"),
    )
    return by_session.groupBy("merchant_key", "customer").agg(
        # a distinct count, so a NULL session key is not an order
        F.count_if(F.col("paid") & F.col("session_key").isNotNull()).alias("orders"),
        F.count("session_key").alias("all_orders"),
        F.sum("spend").alias("spend"),
        F.max("paid").alias("paid"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"),
    )


def _segments(orders: str) -> list[Column]:
    count = F.col(orders)
    return [
        F.count_if(count >= VIP_ORDERS).alias("vip"),
        F.count_if((count >= LOYAL_ORDERS) & (count < VIP_ORDERS)).alias("loyal"),
        F.count_if(count == 1).alias("new_customers"),
    ]


def _summary() -> list[Column]:
    buys = F.col("orders") > 0
    return [
        F.count_if(buys).alias("customers"),
        F.count_if(F.col("orders") > 1).alias("repeat_customers"),
        F.coalesce(F.avg(F.when(buys, F.col("orders"))), F.lit(0.0)).alias("avg_orders"),
        # average spend of a customer, not of an order
        F.coalesce(F.avg(F.when(buys, F.coalesce("spend", F.lit(0.0)))), F.lit(0.0)).alias("avg_purchase"),
        F.coalesce(F.sum("spend"), F.lit(0.0)).alias("customer_spend"),
        *_segments("orders"),
    ]


SUMMARY_COLUMNS = ("customers", "repeat_customers", "repeat_rate", "avg_orders", "avg_purchase",
                   "customer_spend", "vip", "loyal", "new_customers")


def _repeat_rate() -> Column:
    share = rate(F.col("repeat_customers"), F.col("customers")) * 100
    return F.coalesce(share, F.lit(0.0)).alias("repeat_rate")


def customer_summary(profile: DataFrame) -> DataFrame:
    """Customer counts, averages and segments of each merchant, over cards with a successful session."""
    return (
        profile.groupBy("merchant_key").agg(*_summary()).withColumn("repeat_rate", _repeat_rate())
        .select("merchant_key", *SUMMARY_COLUMNS)
    )


def customer_summary_all(profile: DataFrame) -> DataFrame:
    """The same for the context document, where every session of a card counts as an order."""
    return profile.groupBy("merchant_key").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("all_orders") > 1).alias("repeat_customers"),
        F.avg("all_orders").alias("avg_orders"),
        F.sum(F.coalesce("spend", F.lit(0.0))).alias("customer_spend"),
        *_segments("all_orders"),
    )


def customer_segments(summary: DataFrame) -> DataFrame:
    """Segments of each merchant as rows, with their share of the customers (at most 1)."""
    tall = summary.unpivot(["merchant_key", "customers"], ["vip", "loyal", "new_customers"],
                           "segment", "members")
    share = F.least(F.lit(1.0), F.coalesce(rate(F.col("members"), F.col("customers")), F.lit(0.0)))
    return tall.select("merchant_key", "segment", "members", share.alias("share"))


@dataclass(frozen=True)
class Leader:
    """Who leads: the rows that may, the number that the leader has most of, and how ties end.

    The largest number comes from a hash aggregation of fixed width. Only the rows that have it, found by joining
    that back, are put in order, and of these each map task keeps one per merchant: no merchant's customers are
    sorted, or aggregated with text in the buffer.
    """

    eligible: Column
    measure: Column
    ties: tuple[Column, ...]
    shown: dict[str, str]


def _tenure() -> Column:
    return F.datediff("last_order", "first_order").cast("long")


LEADERS = {
    # highest spend, then the smallest key
    "top_customer_by_revenue": lambda: Leader(
        F.col("paid"), F.col("spend"), (F.col("customer").asc(),), {"customer": "customer", "amount": "spend"}),
    # most orders, then the smallest key
    "top_customer_by_orders": lambda: Leader(
        F.col("paid"), F.col("orders"), (F.col("customer").asc(),), {"customer": "customer", "orders": "orders"}),
    # latest first order, then the largest key
    "newest_customer": lambda: Leader(
        F.col("paid"), F.col("first_order"), (F.col("customer").desc(),), {"customer": "customer", "date": "first_order"}),
    # most days between first and last order, then most orders, then the largest key
    "longest_tenure_customer": lambda: Leader(
        F.col("orders") > 1, _tenure(), (F.col("orders").desc(), F.col("customer").desc()),
        {"customer": "customer", "orders": "orders", "first_seen": "first_order", "last_seen": "last_order",
         "tenure_days": "tenure_days"}),
    # largest amount, then newest, then the largest keys; over customer_orders
    "top_order_by_amount": lambda: Leader(
        F.col("paid"), F.col("paid_amount"),
        (F.col("last_order").desc_nulls_last(), F.col("session_key").desc_nulls_last(), F.col("customer").desc()),
        {"customer": "customer", "session_key": "session_key", "amount": "paid_amount", "date": "last_order"}),
}


def _best(name: str) -> Column:
    leader = LEADERS[name]()
    return F.max(F.when(leader.eligible, leader.measure)).alias(f"best_{name}")


def _first(rows: DataFrame, best: DataFrame, name: str) -> DataFrame:
    """merchant_key and the leader's fields; ``best`` has each merchant's largest number."""
    leader = LEADERS[name]()
    largest = best.select("merchant_key", F.col(f"best_{name}").alias("_best"))
    tied = join_on(rows.where(leader.eligible).withColumn("tenure_days", _tenure()), largest, ["merchant_key"])
    tied = tied.where(leader.measure.eqNullSafe(F.col("_best")))
    place = F.row_number().over(W.partitionBy("merchant_key").orderBy(*leader.ties))
    return tied.withColumn("_place", place).where(F.col("_place") == 1).select(
        "merchant_key", *(F.col(field).alias(shown) for shown, field in leader.shown.items()))


def _leader(rows: DataFrame, name: str) -> DataFrame:
    return _first(rows, rows.groupBy("merchant_key").agg(_best(name)), name)


def top_customer_by_revenue(profile: DataFrame) -> DataFrame:
    return _leader(profile, "top_customer_by_revenue")


def top_customer_by_orders(profile: DataFrame) -> DataFrame:
    return _leader(profile, "top_customer_by_orders")


def newest_customer(profile: DataFrame) -> DataFrame:
    return _leader(profile, "newest_customer")


def longest_tenure_customer(profile: DataFrame) -> DataFrame:
    return _leader(profile, "longest_tenure_customer")


def top_order_by_amount(attempts: DataFrame) -> DataFrame:
    return _leader(customer_orders(attempts), "top_order_by_amount")


def customer_analytics(attempts: DataFrame, merchants: DataFrame | None = None) -> DataFrame:
    """Summary and leading customers of each merchant in one row.

    The attempts are read once: their sums by order are written, and the profile and all leaders come from those.
    ``merchants`` adds merchants without any known card, with zero counts and no leaders.
    """
    orders = materialize(customer_orders(attempts), "customer_orders")
    profile = materialize(profile_of(orders), "customer_profile")
    of_profile = [name for name in LEADERS if name != "top_order_by_amount"]
    summary = profile.groupBy("merchant_key").agg(*_summary(), *map(_best, of_profile)).withColumn("repeat_rate", _repeat_rate())
    best = join_on(summary, orders.groupBy("merchant_key").agg(_best("top_order_by_amount")), ["merchant_key"])
    best = materialize(best, "customer_best")
    joined = best.select("merchant_key", *SUMMARY_COLUMNS)
    for name in LEADERS:
        found = _first(profile if name in of_profile else orders, best, name)
        fields = F.struct(*(c for c in found.columns if c != "merchant_key")).alias(name)
        joined = join_on(joined, found.select("merchant_key", fields), ["merchant_key"], "left")
    if merchants is None:
        return joined
    zero = {name: F.coalesce(name, F.lit(0)).alias(name) for name in SUMMARY_COLUMNS}
    return (
        join_on(merchants.select("merchant_key"), joined, ["merchant_key"], "left")
        .select(*(zero.get(c, F.col(c)) for c in joined.columns))
    )
