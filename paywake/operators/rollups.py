"""Sessions rolled up per merchant by total, day, hour, weekday, month, amount and provider.

All counts and sums have fixed-width buffers and text appears only as grouping key, so Spark uses
hash aggregation and combines before the shuffle; a merchant with a large part of the sessions
costs each reduce task no more than one row per map task.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paywake.functions.columns import (AMOUNT_BUCKETS, amount_bucket, amount_bucket_no,
                                       contains_ignoring_case, has_text, rate, weekday)
from paywake.plans.materialize import materialize


def _volume(flag: str, column: str = "amount") -> Column:
    return F.sum(F.when(F.col(flag), F.col(column)).otherwise(F.lit(0.0)))


def _measures(*names: str) -> list[Column]:
    """Aggregates over sessions by output name."""
    known = {
        "sessions": F.count(F.lit(1)),
        "attempted_sessions": F.count_if(F.col("attempt_count") > 0),
        "no_attempt_sessions": F.count_if("no_attempt"),
        "successful_sessions": F.count_if("final_success"),
        "first_success_sessions": F.count_if("first_attempt_success"),
        "recovered_sessions": F.count_if("recovered"),
        "unrecovered_sessions": F.count_if("unrecovered"),
        "retried_sessions": F.count_if("retried"),
        "successful_volume": _volume("final_success"),
        "successful_fee": _volume("final_success", "adjusted_fee"),
        "unrecovered_volume": _volume("unrecovered"),
        "lost_volume": _volume("unrecovered"),
        "recovered_volume": _volume("recovered"),
        "aov": F.avg(F.when(F.col("final_success"), F.col("amount"))),
    }
    return [known[name].alias(name) for name in names]


COUNTS = ("sessions", "attempted_sessions", "no_attempt_sessions", "successful_sessions",
          "first_success_sessions", "recovered_sessions", "unrecovered_sessions", "retried_sessions")
VOLUMES = ("successful_volume", "successful_fee", "unrecovered_volume", "recovered_volume")


@dataclass(frozen=True)
class Rollup:
    """What a roll-up groups by besides the merchant, and what it reports."""

    keys: tuple[str, ...]
    measures: tuple[str, ...]
    whole: str = "attempted_sessions"  # denominator of success_rate
    hidden: tuple[str, ...] = ()  # measures needed for the rate only


DAILY = Rollup(("metric_date",), ("sessions", "attempted_sessions", "successful_sessions",
                                  "recovered_sessions", "unrecovered_sessions", "successful_volume",
                                  "lost_volume", "aov"))
HOURLY = Rollup(("hour_of_day",), ("sessions", "attempted_sessions", "successful_sessions",
                                   "unrecovered_sessions", "successful_volume", "lost_volume"))
AMOUNT = Rollup(("amount_bucket", "bucket_no"), ("sessions", "attempted_sessions", "successful_sessions",
                                                 "recovered_sessions", "unrecovered_sessions",
                                                 "successful_volume", "lost_volume"))
PSP = Rollup(("psp_code",), ("sessions", "successful_sessions", "unrecovered_sessions",
                             "successful_volume", "lost_volume"), whole="sessions")
CALENDAR = Rollup(("weekday", "month"), ("sessions", "attempted_sessions", "successful_sessions",
                                         "successful_volume", "lost_volume", "aov"),
                  hidden=("attempted_sessions",))
MONTHLY = Rollup(("month",), ("sessions", "attempted_sessions", "successful_sessions",
                              "successful_volume", "lost_volume"), hidden=("attempted_sessions",))
WEEKDAY = Rollup(("weekday",), ("sessions", "attempted_sessions", "successful_sessions",
                                "successful_volume"), hidden=("attempted_sessions",))


def _dimensions(edges=AMOUNT_BUCKETS) -> dict[str, Column]:
    """Grouping keys over sessions; NULL where a session takes no part in the roll-up."""
    created, amount = F.col("created_at"), F.col("amount")
    return {
        "metric_date": F.to_date(created),
        "hour_of_day": F.hour(created),
        "weekday": weekday(created),
        "month": F.month(created),
        "amount_bucket": amount_bucket(amount, edges),
        "bucket_no": amount_bucket_no(amount, edges),
        "psp_code": F.when((F.col("attempt_count") > 0) & has_text("last_psp_code"), F.col("last_psp_code")),
    }


def _report(groups: DataFrame, rollup: Rollup) -> DataFrame:
    """The roll-up's columns from its aggregated groups."""
    success = rate(F.col("successful_sessions"), F.col(rollup.whole)).alias("success_rate")
    shown = [m for m in rollup.measures if m not in rollup.hidden]
    return groups.select("merchant_key", *rollup.keys, *shown, success)


def _roll_up(sessions: DataFrame, rollup: Rollup, edges=AMOUNT_BUCKETS) -> DataFrame:
    dimensions = _dimensions(edges)
    keyed = sessions.withColumns({key: dimensions[key] for key in rollup.keys})
    groups = keyed.dropna(subset=rollup.keys).groupBy("merchant_key", *rollup.keys)
    return _report(groups.agg(*_measures(*rollup.measures)), rollup)


CATEGORY = ("category_id", "category_title")


def _merchant_measures() -> list[Column]:
    paid = F.when(F.col("final_success"), F.col("amount"))
    return [
        *_measures(*COUNTS, *VOLUMES),
        F.sum(paid).alias("paid_amount"),
        F.count(paid).alias("paid_sessions"),
        F.min("created_at").alias("first_seen_at"),
        F.max("created_at").alias("last_seen_at"),
    ]


def _fold_categories(by_category: DataFrame) -> DataFrame:
    """merchant_metrics from rows per merchant and category."""
    totals = by_category.groupBy("merchant_key").agg(
        *(F.max(name).alias(name) for name in CATEGORY),
        *(F.sum(name).alias(name) for name in (*COUNTS, *VOLUMES, "paid_amount", "paid_sessions")),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )
    attempted = F.col("attempted_sessions")
    # a successful first try implies an attempt, so the difference counts the failed first tries
    failed_first = attempted - F.col("first_success_sessions")
    return totals.select(
        "merchant_key", *CATEGORY, *COUNTS, *VOLUMES,
        rate(F.col("paid_amount"), F.col("paid_sessions")).alias("aov"),
        rate(F.col("successful_sessions"), attempted).alias("final_success_rate"),
        rate(F.col("first_success_sessions"), attempted).alias("first_attempt_success_rate"),
        rate(F.col("recovered_sessions"), failed_first).alias("recovery_rate"),
        rate(F.col("retried_sessions"), attempted).alias("retry_rate"),
        rate(F.col("no_attempt_sessions"), F.col("sessions")).alias("no_attempt_rate"),
        "first_seen_at", "last_seen_at",
    )


def merchant_metrics(sessions: DataFrame) -> DataFrame:
    """Totals, volumes, rates and period of each merchant.

    MAX over the category texts would force a sort of all sessions, so the category is a grouping
    key first and the few (merchant, category) rows are folded to one per merchant afterwards.
    """
    return _fold_categories(sessions.groupBy("merchant_key", *CATEGORY).agg(*_merchant_measures()))


def daily_metrics(sessions: DataFrame) -> DataFrame:
    return _roll_up(sessions, DAILY)


def hourly_metrics(sessions: DataFrame) -> DataFrame:
    return _roll_up(sessions, HOURLY)


def amount_metrics(sessions: DataFrame, edges=AMOUNT_BUCKETS) -> DataFrame:
    """Per amount bucket. A session without amount is in the last bucket; bucket_no orders by size."""
    return _roll_up(sessions, AMOUNT, edges)


def psp_metrics(sessions: DataFrame, min_sessions: int = 0) -> DataFrame:
    """Per payment provider, over attempted sessions; providers with fewer sessions can be left out."""
    metrics = _roll_up(sessions, PSP)
    return metrics.where(F.col("sessions") >= min_sessions) if min_sessions else metrics


# the stored roll-ups
STORED = {
    "merchant_daily_metrics": DAILY,
    "merchant_hourly_metrics": HOURLY,
    "merchant_amount_metrics": AMOUNT,
    "merchant_psp_metrics": PSP,
}


def roll_up_all(sessions: DataFrame) -> dict[str, DataFrame]:
    """The five stored roll-ups from one scan of the sessions.

    All groupings are aggregated together as grouping sets. The groups are written, being far fewer
    than the sessions, and each table is then a filter over them.
    """
    dimensions = _dimensions()
    sets = {"merchant_metrics": CATEGORY, **{name: rollup.keys for name, rollup in STORED.items()}}
    keys = [key for group in sets.values() for key in group]
    new_keys = {key: dimensions[key] for key in keys if key not in CATEGORY}
    groups = materialize(
        sessions.withColumns(new_keys)
        .groupingSets([["merchant_key", *group] for group in sets.values()], "merchant_key", *keys)
        .agg(F.grouping_id().alias("grouping"), *_merchant_measures(), *_measures("lost_volume", "aov")),
        "rollup_groups",
    )

    def part(name: str) -> DataFrame:
        # bit i from the right stands for the i-th key from the end, set where the key is left out
        left_out = sum(1 << i for i, key in enumerate(reversed(keys)) if key not in sets[name])
        return groups.where(F.col("grouping") == left_out)

    tables = {"merchant_metrics": _fold_categories(part("merchant_metrics").drop("lost_volume", "aov"))}
    for name, rollup in STORED.items():
        tables[name] = _report(part(name).dropna(subset=rollup.keys), rollup)
    return tables


def calendar_metrics(sessions: DataFrame) -> DataFrame:
    """Weekday (Sunday 0) by month."""
    return _roll_up(sessions, CALENDAR)


def monthly_metrics(sessions: DataFrame, lost: bool = False) -> DataFrame:
    """Month of year; ``lost`` adds the lost volume."""
    metrics = _roll_up(sessions, MONTHLY)
    return metrics if lost else metrics.drop("lost_volume")


def weekday_metrics(sessions: DataFrame) -> DataFrame:
    return _roll_up(sessions, WEEKDAY)


DAY_MEASURES = ("sessions", "attempted_sessions", "successful_sessions", "recovered_sessions", "unrecovered_sessions",
                "successful_volume", "lost_volume", "paid_amount", "paid_sessions")


def day_lattice(sessions: DataFrame) -> DataFrame:
    """Counts and sums by merchant and day, from which every coarser calendar follows by adding up."""
    paid = F.when(F.col("final_success"), F.col("amount"))
    return (
        sessions.where(F.col("created_at").isNotNull())
        .groupBy("merchant_key", F.to_date("created_at").alias("metric_date"))
        .agg(*_measures(*DAY_MEASURES[:-2]), F.sum(paid).alias("paid_amount"), F.count(paid).alias("paid_sessions"))
    )


def _fold_days(days: DataFrame, rollup: Rollup) -> DataFrame:
    """A calendar roll-up from the day lattice."""
    date = F.col("metric_date")
    parts = {"metric_date": date, "weekday": weekday(date), "month": F.month(date)}
    groups = days.groupBy("merchant_key", *(parts[key].alias(key) for key in rollup.keys)).agg(
        *(F.sum(name).alias(name) for name in DAY_MEASURES))
    return _report(groups.withColumn("aov", rate(F.col("paid_amount"), F.col("paid_sessions"))), rollup)


def seasonality(sessions: DataFrame) -> dict[str, DataFrame]:
    """Days, months, weekdays and the weekday by month calendar from one scan of the sessions.

    The sessions are added up by day once; the days, at most some thousand per merchant, are written and folded.
    """
    days = materialize(day_lattice(sessions), "days")
    rollups = {"daily": DAILY, "monthly": MONTHLY, "weekday": WEEKDAY, "calendar": CALENDAR}
    folded = {name: _fold_days(days, rollup) for name, rollup in rollups.items()}
    return folded | {"monthly_lost": folded["monthly"], "monthly": folded["monthly"].drop("lost_volume")}


def amount_share(amounts: DataFrame) -> DataFrame:
    """Share of a merchant's sessions in each bucket; a merchant has one row per bucket."""
    whole = F.sum("sessions").over(W.partitionBy("merchant_key"))
    return amounts.select("merchant_key", "amount_bucket", "sessions",
                          rate(F.col("sessions"), whole).alias("share"))


def psp_ranking(psps: DataFrame, k: int | None = None, by: str = "success_rate") -> DataFrame:
    """Providers of a merchant by success rate or another figure, best first; ``k`` keeps the first k."""
    order = W.partitionBy("merchant_key").orderBy(F.col(by).desc_nulls_last(), "psp_code")
    ranked = psps.withColumn("psp_rank", F.row_number().over(order).cast("long"))
    return ranked if k is None else ranked.where(F.col("psp_rank") <= k)


def daily_series(daily: DataFrame, limit_days: int = 180, latest: bool = False) -> DataFrame:
    """The oldest days of each merchant, or the newest with ``latest``."""
    day = F.col("metric_date")
    order = W.partitionBy("merchant_key").orderBy(day.desc() if latest else day.asc())
    numbered = daily.withColumn("day_no", F.row_number().over(order).cast("long"))
    return numbered.where(F.col("day_no") <= limit_days)


def global_stats(merchants: DataFrame) -> DataFrame:
    names = ("sessions", "attempted_sessions", "no_attempt_sessions", "successful_sessions",
             "recovered_sessions", "unrecovered_sessions", "retried_sessions",
             "successful_volume", "unrecovered_volume")
    return merchants.agg(F.count(F.lit(1)).alias("merchants"), *(F.sum(n).alias(n) for n in names))


def session_totals(sessions: DataFrame) -> DataFrame:
    """Counts of all sessions and the rates derived from them, in percent, 0 for an empty population."""
    totals = sessions.agg(*_measures(*COUNTS))

    def percent(part, whole):
        return F.coalesce(rate(F.col(part), whole) * 100, F.lit(0.0))

    everything, attempted = F.col("sessions"), F.col("attempted_sessions")
    return totals.select(
        *COUNTS,
        percent("attempted_sessions", everything).alias("attempt_coverage"),
        percent("no_attempt_sessions", everything).alias("no_attempt_pct"),
        percent("first_success_sessions", attempted).alias("first_success_pct"),
        percent("successful_sessions", attempted).alias("final_success_pct"),
        percent("retried_sessions", attempted).alias("retry_pct"),
        percent("recovered_sessions", attempted - F.col("first_success_sessions")).alias("recovery_pct"),
    )


def top_merchants(merchants: DataFrame, search: str | None = None, n: int = 100) -> DataFrame:
    """Merchants by successful volume, optionally those whose key contains a text."""
    if search:
        merchants = merchants.where(contains_ignoring_case("merchant_key", search))
    return (
        merchants.select("merchant_key", "sessions", "successful_sessions", "final_success_rate",
                         "successful_volume", "aov")
        .orderBy(F.col("successful_volume").desc_nulls_last(), "merchant_key").limit(n)
    )
