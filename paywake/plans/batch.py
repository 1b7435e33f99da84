"""The batch build: attempts to all stored tables."""

from pyspark.sql import DataFrame, SparkSession

from paywake.operators import insights as ins
from paywake.operators import rollups
from paywake.operators.peers import peer_metrics
from paywake.operators.sessions import build_sessions, provider_codes
from paywake.sources.files import locate, read_attempts
from paywake.sources.tables import (AUDIT, BUCKET_KEYS, COUNTS, bucketed_name, count_rows, new_version, publish, read_table,
                                    write_bucketed, write_tables)


def build_all(spark: SparkSession, source: str | DataFrame, out: str, fmt: str | None = None,
              spread_gzip: int | None = None, database: str | None = None,
              buckets: int | None = None) -> dict[str, DataFrame]:
    """Build and store the eleven tables as a new version under ``out`` and return them as stored.

    Each stage reads what the stage before has written, so nothing is computed twice and a lost
    executor costs only the running stage. The version is published at the end: until then, and after a build that
    failed, readers have the tables of the version before; ``database`` also gets a view of each table. With
    ``buckets`` the attempts are a bucketed table of that database, from which sessions and customer orders are made
    without an exchange (see write_bucketed for when not to).
    ``source`` is attempts, or a file or folder that locate finds and read_attempts reads. Rows are counted and the evidence is
    audited as they are written (table_counts, insight_audit).
    """
    stored: dict[str, DataFrame] = {}
    counts: dict[str, int] = {}
    seen: dict = {}
    version = new_version(out)

    def store(**tables: DataFrame) -> None:
        observed = write_tables(tables, version, metrics={"insight_evidence": ins.audit_metrics()})
        counts.update({name: found["rows"] for name, found in observed.items()})
        seen.update(observed.get("insight_evidence", {}))
        stored.update({name: read_table(spark, version, name, df.schema) for name, df in tables.items()})

    def store_bucketed(name: str, df: DataFrame) -> None:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        table = bucketed_name(version, name, database)
        counts[name] = write_bucketed(df, f"{version}/{name}", table, BUCKET_KEYS[name], buckets)
        stored[name] = spark.table(table)

    if buckets and not database:
        raise ValueError("buckets need a database that holds the bucketed table")
    if isinstance(source, str):
        path, fmt = locate(spark, source, fmt)
        source = read_attempts(spark, path, fmt, spread_gzip)
    if buckets:
        store_bucketed("attempts", source)
    else:
        store(attempts=source)
    store(sessions=build_sessions(stored["attempts"], codes=provider_codes(stored["attempts"])))
    store(**rollups.roll_up_all(stored["sessions"]), insight_methodology=ins.methodology(spark))
    store(peer_metrics=peer_metrics(stored["merchant_metrics"]))
    insights = ins.build_insights(stored["peer_metrics"])
    store(insights=insights,
          insight_evidence=ins.insight_evidence(insights, stored["peer_metrics"], stored["insight_methodology"]))
    write_tables({COUNTS: count_rows(spark, counts).coalesce(1), AUDIT: ins.audit_rows(spark, seen).coalesce(1)}, version)
    publish(spark, version, database, [*stored, COUNTS, AUDIT])
    return stored
