"""Column expressions shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses that count as a successful payment.
SUCCESS_STATUSES = ("Verified", "Paid")

# Insight severities, most severe first.
SEVERITIES = ("critical", "warning", "info")

# Upper edge (exclusive) and label of each amount bucket; the rest, and NULL, is "50M+".
AMOUNT_BUCKETS = ((1e6, "0-1M"), (5e6, "1M-5M"), (1e7, "5M-10M"), (5e7, "10M-50M"))
LAST_AMOUNT_BUCKET = "50M+"


def succeeded(status: str | Column) -> Column:
    """NULL status stays NULL, as in SQL's IN."""
    status = F.col(status) if isinstance(status, str) else status
    return status.isin(*SUCCESS_STATUSES)


def has_text(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def rate(part: Column, whole: Column) -> Column:
    """Double ratio; NULL when the denominator is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def severity_order(name: str = "severity") -> Column:
    """1 for critical, 2 for warning, 3 for info, 4 for anything else."""
    order = F.lit(len(SEVERITIES) + 1)
    for place, word in reversed(list(enumerate(SEVERITIES, start=1))):
        order = F.when(F.col(name) == word, place).otherwise(order)
    return order


def amount_bucket(amount: Column, edges=AMOUNT_BUCKETS, last=LAST_AMOUNT_BUCKET) -> Column:
    label = F.lit(last)
    for edge, name in reversed(edges):
        label = F.when(amount < edge, name).otherwise(label)
    return label


def amount_bucket_no(amount: Column, edges=AMOUNT_BUCKETS) -> Column:
    """Position of the bucket by size, starting at 1."""
    number = F.lit(len(edges) + 1)
    for place, (edge, _) in reversed(list(enumerate(edges, start=1))):
        number = F.when(amount < edge, place).otherwise(number)
    return number


def weekday(ts: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(ts) - 1).cast("int")


def contains_ignoring_case(name: str, text: str) -> Column:
    """Substring search in which % and _ work as wildcards and a backslash is an ordinary character."""
    return F.col(name).ilike("%" + text.replace("\\", "\\\\") + "%")
