"""One grounded document per merchant, made of its roll-ups, customers and insights."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StructField

from paywake.functions.text import with_iso_times
from paywake.operators.insights import rank_insights
from paywake.operators.rollups import daily_series
from paywake.functions.joins import join_on

# Days and insights shown in a document.
CONTEXT_DAYS, CONTEXT_INSIGHTS = 30, 10

DAILY_FIELDS = ("metric_date", "sessions", "successful_sessions", "successful_volume",
                "recovered_sessions", "unrecovered_sessions", "lost_volume")
HOURLY_FIELDS = ("hour_of_day", "sessions", "successful_sessions", "successful_volume", "success_rate")
PSP_FIELDS = ("psp_code", "sessions", "successful_sessions", "success_rate", "successful_volume")
INSIGHT_FIELDS = ("insight_type", "severity", "title", "summary", "recommendation",
                  "metric_name", "metric_value")
MONTHLY_FIELDS = ("month", "sessions", "successful_sessions", "successful_volume", "lost_volume",
                  "success_rate")
CUSTOMER_FIELDS = ("customers", "repeat_customers", "avg_orders", "customer_spend", "vip", "loyal",
                   "new_customers")
HEALTH_FIELDS = {
    "success_rate": "final_success_rate",
    "first_attempt_success_rate": "first_attempt_success_rate",
    "recovery_rate": "recovery_rate",
    "retry_rate": "retry_rate",
    "no_attempt_rate": "no_attempt_rate",
}


def _items(df: DataFrame, place: str, fields: tuple[str, ...], name: str) -> DataFrame:
    """The rows of a merchant as an array in order of ``place``."""
    row = F.struct(F.col(place).alias("place"), F.struct(*fields).alias("item"))
    in_order = F.sort_array(F.collect_list(row))
    return df.groupBy("merchant_key").agg(F.transform(in_order, lambda r: r["item"]).alias(name))


def _numbered(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy("merchant_key").orderBy(*order)))


def merchant_context(merchants: DataFrame, peers: DataFrame, daily: DataFrame, hourly: DataFrame,
                     psps: DataFrame, customers: DataFrame, evidence: DataFrame,
                     monthly: DataFrame) -> DataFrame:
    """merchant_key and a nested ``context``; a merchant without rows in a part gets an empty array.

    ``customers`` is customer_summary_all, ``monthly`` has the lost volume. Arrays are made of
    roll-up rows only: 30 days, 24 hours, 12 months, ten insights, one row per payment provider.
    """
    newest = daily_series(daily, CONTEXT_DAYS, latest=True)
    lists = {
        "daily_last_30_days": _items(newest, "day_no", DAILY_FIELDS, "daily_last_30_days"),
        "hourly": _items(hourly, "hour_of_day", HOURLY_FIELDS, "hourly"),
        "psps": _items(_numbered(psps, F.col("sessions").desc(), F.col("psp_code")), "place",
                       PSP_FIELDS, "psps"),
        "insights": _items(rank_insights(evidence, CONTEXT_INSIGHTS), "insight_no", INSIGHT_FIELDS,
                           "insights"),
        "seasonality_monthly": _items(monthly, "month", MONTHLY_FIELDS, "seasonality_monthly"),
    }

    peer = with_iso_times(peers)
    parts = [
        peer.select("merchant_key", F.struct(*peer.columns).alias("peer")),
        customers.select("merchant_key", F.struct(*CUSTOMER_FIELDS).alias("customers")),
        *lists.values(),
    ]
    health = F.struct(*(F.col(source).alias(name) for name, source in HEALTH_FIELDS.items()))
    shown = with_iso_times(merchants)
    base = shown.select("merchant_key", F.struct(*shown.columns).alias("merchant"), health.alias("health"))
    joined = reduce(lambda left, part: join_on(left, part, ["merchant_key"], "left"), parts, base)
    no_customers = F.struct(
        F.lit(0).cast("long").alias("customers"), F.lit(0).cast("long").alias("repeat_customers"),
        F.lit(None).cast("double").alias("avg_orders"), F.lit(None).cast("double").alias("customer_spend"),
        *(F.lit(0).cast("long").alias(n) for n in ("vip", "loyal", "new_customers")))
    empty = {name: F.coalesce(name, F.array()).alias(name) for name in lists}
    return joined.select("merchant_key", F.struct(
        "merchant", "health", "peer", empty["daily_last_30_days"], empty["hourly"], empty["psps"],
        F.coalesce("customers", no_customers).alias("customers"),
        empty["insights"], empty["seasonality_monthly"],
    ).alias("context"))


def context_json(contexts: DataFrame) -> DataFrame:
    """The documents as JSON text, one row per merchant."""
    document = F.to_json("context", {"ignoreNullFields": "false"})
    return contexts.select("merchant_key", document.alias("context_json"))


def context_items(contexts: DataFrame) -> DataFrame:
    """The lists of the documents as rows: part, place in it, label and two of its figures."""
    def rows(part, label, count, value):
        return F.transform(F.col(f"context.{part}"), lambda item, i: F.struct(
            F.lit(part).alias("part"), (i + 1).cast("long").alias("place"),
            item[label].cast("string").alias("label"),
            (item[count] if count else F.lit(None)).cast("long").alias("sessions"),
            item[value].cast("double").alias("value")))

    tall = F.concat(
        rows("daily_last_30_days", "metric_date", "sessions", "successful_volume"),
        rows("hourly", "hour_of_day", "sessions", "successful_volume"),
        rows("psps", "psp_code", "sessions", "successful_volume"),
        rows("insights", "insight_type", None, "metric_value"),
        rows("seasonality_monthly", "month", "sessions", "lost_volume"),
    )
    return contexts.select("merchant_key", F.inline(tall))


def context_values(contexts: DataFrame) -> DataFrame:
    """Every single value of the documents as a row: its path, and the value as number or as text.

    Paths are those of the JSON text, as merchant.sessions or hourly[3].success_rate, so that documents can be
    compared without regard to how an engine writes numbers.
    """
    def leaf(path: Column, value: Column, kind: DataType) -> Column:
        number = isinstance(kind, NumericType)
        return F.struct(
            path.alias("path"), (value if number else F.lit(None)).cast("double").alias("number"),
            (F.lit(None) if number else value).cast("string").alias("text"))

    def leaves(part: StructField) -> Column:
        whole = F.col(f"context.{part.name}")
        if not isinstance(part.dataType, ArrayType):
            return F.array(*(leaf(F.lit(f"{part.name}.{f.name}"), whole[f.name], f.dataType) for f in part.dataType.fields))
        return F.flatten(F.transform(whole, lambda item, i: F.array(*(
            leaf(F.concat(F.lit(f"{part.name}["), i.cast("string"), F.lit(f"].{f.name}")), item[f.name], f.dataType)
            for f in part.dataType.elementType.fields))))

    return contexts.select("merchant_key", F.inline(F.concat(*map(leaves, contexts.schema["context"].dataType.fields))))
