"""Rows and documents as JSON text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso_time(name: str) -> Column:
    """ISO 8601 text with a T, and fractions of a second only where there are any."""
    return F.replace(F.col(name).cast("string"), F.lit(" "), F.lit("T"))


def with_iso_times(df: DataFrame) -> DataFrame:
    times = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))]
    return df.withColumns({name: iso_time(name) for name in times}) if times else df


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object in column ``json``; NULL fields stay in it as null."""
    shown = with_iso_times(df)
    return shown.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
