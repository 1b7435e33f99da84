"""Sessions behind an insight, the session explorer and the attempts of a session."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywake.functions.columns import contains_ignoring_case
from paywake.functions.joins import join_on, semi_join_on
from paywake.plans.positions import page_of_group
from paywake.plans.value_counts import value_bin

# Status word of the explorer and the session flag it selects.
STATUS_FLAGS = {
    "success": "final_success",
    "failed": "unrecovered",
    "recovered": "recovered",
    "retry": "retried",
    "no_attempt": "no_attempt",
}

# Insight types with a session flag of their own; all others list the newest sessions.
INSIGHT_FLAGS = {
    "RECOVERY_OPPORTUNITY": "unrecovered",
    "NO_ATTEMPT": "no_attempt",
    "HIGH_RETRY": "retried",
}

SESSION_COLUMNS = ("session_key", "amount", "attempt_count", "session_status", "first_try_status",
                   "last_attempt_status", "first_attempt_at", "last_attempt_at", "created_at",
                   "final_success", "recovered", "unrecovered", "retried", "no_attempt")


def session_state() -> Column:
    return (F.when(F.col("final_success"), "success").when(F.col("unrecovered"), "lost")
            .otherwise("in progress"))


def session_filter(sessions: DataFrame, merchant_key: str | None = None, search: str | None = None,
                   status: str | None = None, psp: str | None = None, date_from: str | None = None,
                   date_to: str | None = None, min_amount: float | None = None,
                   max_amount: float | None = None, min_attempts: int | None = None) -> DataFrame:
    """Sessions that meet all given conditions; an unknown status word is ignored.

    date_to is a point in time: a bare date leaves that day out.
    """
    def moment(text):
        return F.lit(text).cast("timestamp_ntz")

    conditions = []
    if merchant_key is not None:
        conditions.append(F.col("merchant_key") == merchant_key)
    if search:
        conditions.append(contains_ignoring_case("session_key", search))
    if status in STATUS_FLAGS:
        conditions.append(F.col(STATUS_FLAGS[status]))
    if psp:
        conditions.append(F.col("last_psp_code") == psp)
    if date_from:
        conditions.append(F.col("created_at") >= moment(date_from))
    if date_to:
        conditions.append(F.col("created_at") <= moment(date_to))
    if min_amount is not None:
        conditions.append(F.col("amount") >= min_amount)
    if max_amount is not None:
        conditions.append(F.col("amount") <= max_amount)
    if min_attempts is not None:
        conditions.append(F.col("attempt_count") >= min_attempts)
    return sessions.where(reduce(lambda a, b: a & b, conditions)) if conditions else sessions


def _days_ago(name: str) -> Column:
    """Days along a descending order of times; rows without a time come last."""
    return F.coalesce(-F.unix_date(F.col(name).cast("date")), F.lit(2**31 - 1)).cast("long")


def _falling(name: str) -> Column:
    """Intervals along a descending order of numbers, NULL last."""
    value = F.col(name).cast("double")
    return F.when(value.isNull(), value_bin(value)).otherwise(-value_bin(value))


def session_page(sessions: DataFrame, limit: int = 25, offset: int = 0, by: str = "merchant_key", **filters) -> DataFrame:
    """A page of each merchant's sessions (or each category's, …: ``by``), newest first, with the number that match.

    The total is a separate aggregate: as a window it would bring whole merchants into one task.
    """
    matching = session_filter(sessions, **filters)
    order = [F.col("created_at").desc_nulls_last(), F.col("session_key").asc_nulls_first()]
    page = page_of_group(matching.select(by, *SESSION_COLUMNS, "last_psp_code"), [by], order, limit, offset,
                         interval=_days_ago("created_at"))
    totals = matching.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    return join_on(page.withColumn("state", session_state()), totals, [by])


def insight_sessions(insights: DataFrame, sessions: DataFrame, limit: int = 100,
                     offset: int = 0) -> DataFrame:
    """The sessions behind every insight, a page per merchant and insight type, with the ``total`` behind it.

    Sessions belong to listings (lost, without try, retried, newest). A semi join keeps those of an asked merchant
    and listing before anything is sorted; the pages are cut inside the map tasks and only then joined to the insights.
    """
    wanted = F.lit("newest")
    for kind, flag in INSIGHT_FLAGS.items():
        wanted = F.when(F.col("insight_type") == kind, flag).otherwise(wanted)
    asked = insights.select("merchant_key", "insight_type", wanted.alias("listing"))
    flags = sorted(set(INSIGHT_FLAGS.values()))
    listings = F.array_compact(F.array(F.lit("newest"), *(F.when(F.col(f), F.lit(f)) for f in flags)))
    every = sessions.select("merchant_key", *SESSION_COLUMNS, F.explode(listings).alias("listing"))
    listed = semi_join_on(every, asked.select("merchant_key", "listing").distinct(), ["merchant_key", "listing"])
    listing = F.col("listing")
    order = [
        F.when(listing == "retried", F.col("attempt_count")).desc_nulls_last(),
        F.when(listing != "newest", F.col("amount")).desc_nulls_last(),
        F.when(listing == "newest", F.col("created_at")).desc_nulls_last(),
        F.col("session_key").asc_nulls_first(),
    ]
    interval = (
        F.when(listing == "retried", _falling("attempt_count")).when(listing != "newest", _falling("amount"))
        .otherwise(_days_ago("created_at"))
    )
    page = page_of_group(listed, ["merchant_key", "listing"], order, limit, offset, interval=interval)
    totals = listed.groupBy("merchant_key", "listing").agg(F.count(F.lit(1)).alias("total"))
    return (
        join_on(join_on(asked, page, ["merchant_key", "listing"]), totals, ["merchant_key", "listing"])
        .select("merchant_key", "insight_type", "row_no", *SESSION_COLUMNS, "total")
    )


def session_detail(sessions: DataFrame, attempts: DataFrame, session_key: str) -> dict[str, DataFrame]:
    """One session and its attempts in order; the key is pushed into both scans."""
    chosen = F.col("session_key") == session_key
    return {
        "session": sessions.where(chosen),
        "attempts": attempts.where(chosen).orderBy(
            F.col("try_seq").asc_nulls_last(), F.col("try_created_at").asc_nulls_last()),
    }


def session_timeline(sessions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every attempt of every session as a row, beside the session's outcome; order by try_seq.

    One row per attempt rather than an array per session, so that a session with very many
    attempts is never collected in one place. Sessions are made of attempts, so none is lost by the
    inner join, which Spark can split for a large session where an outer join could not be. A
    missing status, code or time gets its stand-in.
    """
    outcome = sessions.select("session_key", "session_status", "amount", "attempt_count",
                              session_state().alias("state"))
    tries = attempts.select(
        "session_key", "try_seq", F.coalesce(F.nullif("psp_code", F.lit("")), F.lit("No PSP")).alias("psp"),
        F.coalesce(F.nullif("try_status", F.lit("")), F.lit("NoAttempt")).alias("status"),
        F.coalesce(F.nullif("switch_response_code", F.lit("")), F.lit("no response code")).alias("response"),
        F.coalesce("try_created_at", "created_at").alias("happened_at"),
    )
    return join_on(outcome, tries, ["session_key"])
