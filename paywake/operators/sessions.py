"""Attempts to sessions: one row per payment intent."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywake.functions.bitmaps import bitmap_size, bitmaps
from paywake.functions.columns import has_text, succeeded
from paywake.plans.positions import positions


def _real() -> Column:
    """try_seq 0 only records that the session was opened."""
    return F.col("try_seq") > 0


def rank_attempts(attempts: DataFrame, split: bool = True) -> DataFrame:
    """Number every attempt of a session, tries without a time last.

    A session may span many tasks. ``split=False`` sorts each in one task, for sessions known to be small.
    """
    order = [
        F.col("try_seq").asc_nulls_last(),
        F.col("try_created_at").asc_nulls_last(),
        F.col("created_at").asc_nulls_last(),
        F.col("psp_code").asc_nulls_first(),
        F.col("try_status").asc_nulls_first(),
    ]
    return positions(attempts, ["session_key"], order, "attempt_rank", split=split)


def _first_try() -> Column:
    """The smallest real try as a struct.

    Struct comparison puts NULL first, hence the is-null fields before the times. PSP and status
    close the order so that equal tries give the same result however rows are spread.
    """
    return F.min(F.when(_real(), F.struct(
        "try_seq",
        F.col("try_created_at").isNull().alias("no_try_time"),
        "try_created_at",
        F.col("created_at").isNull().alias("no_time"),
        "created_at",
        "psp_code",
        "try_status",
    )))


def _first_columns(first: str = "first") -> list[Column]:
    return [
        F.col(f"{first}.try_status").alias("first_try_status"),
        F.col(f"{first}.psp_code").alias("first_psp_code"),
        F.col(f"{first}.try_seq").alias("first_try_seq"),
        F.col(f"{first}.try_created_at").alias("first_try_created_at"),
    ]


def first_attempts(attempts: DataFrame) -> DataFrame:
    """First real attempt of each session that has one. An aggregate, so no session is sorted in one task."""
    return (
        attempts.where(_real())
        .groupBy("session_key").agg(_first_try().alias("first"))
        .select("session_key", *_first_columns())
    )


def _newest_try() -> Column:
    return F.max(F.when(_real(), F.struct(
        "try_seq", "try_created_at", "created_at", "psp_code", "try_status", "session_status")))


def provider_codes(attempts: DataFrame) -> list[str]:
    """All provider codes, in order: as many as there are contracts with providers, whatever the number of attempts."""
    codes = attempts.where(has_text("psp_code")).select("psp_code").distinct()
    return sorted(row["psp_code"] for row in codes.collect())


def build_sessions(attempts: DataFrame, terminal: str = "max_text",
                   small: bool = False, codes: list[str] | None = None) -> DataFrame:
    """Collapse attempts to sessions with first-try, retry and recovery flags.

    ``terminal`` picks the terminal columns (session_status, last_attempt_status, last_psp_code):
    "max_text" takes the alphabetically largest value, "latest" the values of the newest real try.

    One aggregation with one exchange does all, and rows are combined before it: a session that holds a large part of
    the table never reaches one task row by row. Distinct providers are merged as sets, or, where ``codes`` lists all
    provider codes (see provider_codes), as bitmaps over their numbers: 8 bytes a session for every 64 codes. Finding
    the codes takes a scan of that column, which is cheap in a stored table and not in a derived one.
    ``small=True``, for sessions known to fit in a task, leaves out the combining and gives the same rows.
    """
    codes = codes if codes is None else sorted(set(codes))
    return _collapse(attempts.repartition("session_key") if small else attempts, terminal, codes)


def _providers(codes: list[str] | None) -> tuple[list[Column], Column]:
    """Aggregates over the providers of a session's real tries, and their number from those."""
    code = F.when(_real() & has_text("psp_code"), F.col("psp_code"))
    if codes is None:
        return [F.collect_set(code).alias("_providers")], F.size("_providers").cast("long")
    columns = bitmaps(code, codes, "_providers")
    return [F.bit_or(bits).alias(name) for name, bits in columns.items()], bitmap_size(columns)


def _collapse(attempts: DataFrame, terminal: str, codes: list[str] | None) -> DataFrame:
    """One aggregation; the first try is a ``min`` over a struct in place of a window and a join."""
    if terminal not in ("max_text", "latest"):
        raise ValueError(f"unknown terminal rule: {terminal}")
    ok = succeeded("try_status")
    providers, psp_count = _providers(codes)
    measures = [
        F.max("merchant_key").alias("merchant_key"),
        F.max("category_id").alias("category_id"),
        F.max("category_title").alias("category_title"),
        F.max("amount").alias("amount"),
        F.max("adjusted_fee").alias("adjusted_fee"),
        F.max("session_status").alias("session_status"),
        F.min("created_at").alias("created_at"),
        F.min(F.when(_real(), F.col("try_created_at"))).alias("first_attempt_at"),
        F.max(F.when(_real(), F.col("try_created_at"))).alias("last_attempt_at"),
        F.count_if(_real()).alias("attempt_count"),
        *providers,
        F.bool_or(F.when(_real(), ok)).alias("any_success"),
        F.bool_or(F.when(F.col("try_seq") > 1, ok)).alias("later_success"),
        _first_try().alias("first"),
    ]
    if terminal == "latest":
        measures.append(_newest_try().alias("newest"))
        last = {
            "session_status": F.coalesce("newest.session_status", "session_status"),
            "last_attempt_status": F.col("newest.try_status"),
            "last_psp_code": F.col("newest.psp_code"),
        }
    else:
        measures.append(F.max(F.when(_real(), F.col("try_status"))).alias("last_attempt_status"))
        measures.append(F.max(F.when(_real(), F.col("psp_code"))).alias("last_psp_code"))
        last = {}

    def plain(name):
        return last.get(name, F.col(name)).alias(name)

    first_ok = F.coalesce(succeeded("first.try_status"), F.lit(False))
    first_failed = F.coalesce(~succeeded("first.try_status"), F.lit(False))
    final = F.coalesce("any_success", F.lit(False))
    recovered = first_failed & F.coalesce("later_success", F.lit(False))
    return (
        attempts.groupBy("session_key").agg(*measures)
        .select(
            "session_key", "merchant_key", "category_id", "category_title", "amount", "adjusted_fee",
            plain("session_status"), "created_at", "first_attempt_at", "last_attempt_at",
            "attempt_count", psp_count.alias("psp_count"), "any_success", "later_success",
            plain("last_attempt_status"), plain("last_psp_code"),
            *_first_columns(),
            first_ok.alias("first_attempt_success"),
            recovered.alias("recovered"),
            (first_failed & ~final).alias("unrecovered"),
            (F.col("attempt_count") > 1).alias("retried"),
            (F.col("attempt_count") == 0).alias("no_attempt"),
            final.alias("final_success"),
        )
    )
