"""Health score and headline figures of a merchant."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights of the score's parts, in points.
SUCCESS_POINTS, RECOVERY_POINTS, RETRY_POINTS, NO_ATTEMPT_POINTS = 70, 10, 10, 10

# Lowest score of the first two states.
GOOD_FROM, FAIR_FROM = 85, 70


def health_scores(peers: DataFrame, states=("excellent", "good", "needs attention")) -> DataFrame:
    """Score from 0 to 100 for every row of peer_metrics; a missing rate or percentile counts as 0."""
    zero = F.lit(0.0)

    def known(name):
        return F.coalesce(name, zero)

    def unused(name):
        return F.greatest(zero, 1 - F.col(name))

    points = (
        F.col("success_rate") * SUCCESS_POINTS + F.col("recovery_rate") * RECOVERY_POINTS
        + unused("retry_rate") * RETRY_POINTS + unused("no_attempt_rate") * NO_ATTEMPT_POINTS
    )
    rates = peers.select(
        "merchant_key",
        known("final_success_rate").alias("success_rate"),
        known("recovery_rate").alias("recovery_rate"),
        known("retry_rate").alias("retry_rate"),
        known("no_attempt_rate").alias("no_attempt_rate"),
        (known("success_rate_percentile") * 100).alias("percentile"),
    )
    score = F.least(F.lit(100.0), F.greatest(zero, points))
    good, fair, poor = states
    state = F.when(score >= GOOD_FROM, good).when(score >= FAIR_FROM, fair).otherwise(poor)
    return rates.select("merchant_key", F.round(score, 1).alias("score"), state.alias("status"),
                        "success_rate", "recovery_rate", "retry_rate", "no_attempt_rate", "percentile")


def kpi_row(merchants: DataFrame) -> DataFrame:
    """Headline figures, with the points that retries add to the success rate."""
    gap = F.col("final_success_rate") - F.col("first_attempt_success_rate")
    return merchants.select(
        "merchant_key", "category_title", "successful_volume", "successful_sessions",
        "final_success_rate", "first_attempt_success_rate", (gap * 100).alias("success_gap_points"),
        "aov", "sessions", "unrecovered_volume", "unrecovered_sessions", "first_seen_at", "last_seen_at",
    )
