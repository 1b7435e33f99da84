"""The stored tables: writing, publishing, finding and counting them.

A folder of stored tables may hold versions. Each build writes under a version of its own and publishes it by
creating one marker file, so that readers see all tables of the old version or all of the new one.
"""

import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Tables that are stored sorted, so that a merchant's rows are read from few files and row groups.
# Ranges over all three columns also split a merchant with very many sessions.
LAYOUT = {"sessions": ["merchant_key", "created_at", "session_key"]}

# Columns with Bloom filters in the row groups, for look-ups that the layout does not serve.
BLOOM_FILTERS = {"attempts": ["session_key"], "sessions": ["session_key"]}

# Tables that a catalog may hold in buckets, and the key that their readers group and join by.
BUCKET_KEYS = {"attempts": "session_key"}

VERSIONS = "versions"
MARKER = "_PUBLISHED"
COUNTS = "table_counts"
AUDIT = "insight_audit"


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """(file system, path) of the store the path is in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def new_version(out: str) -> str:
    """Folder for a build of all tables; later versions sort behind earlier ones."""
    return f"{out}/{VERSIONS}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def bucketed_name(version: str, name: str, database: str) -> str:
    """Catalog name of a bucketed table of a version."""
    return f"`{database}`.`{name}__{version.rsplit('/', 1)[-1].replace('-', '_')}`"


def write_bucketed(df: DataFrame, path: str, table: str, key: str, buckets: int) -> int:
    """Write Parquet files under ``path`` in buckets of the key, as an external catalog table; returns the rows written.

    Each bucket is one file, sorted by the key, so whoever groups or joins by the key through the catalog needs no
    exchange. A bucket is read by one task: not for tables in which one key holds a large part of the rows.
    """
    counted = Observation("rows of a bucketed table")
    placed = df.repartition(buckets, key).observe(counted, F.count(F.lit(1)).alias("rows"))
    placed.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return counted.get["rows"]


def publish(spark: SparkSession, version: str, database: str | None = None, tables: list[str] | None = None) -> None:
    """Make a written version the current one. A marker file does it for readers of the folder, all tables at once;
    with ``database`` the views of that name are replaced too, one after the other. Bucketed tables keep their
    buckets behind the views."""
    store, marker = _path(spark, f"{version}/{MARKER}")
    store.create(marker, True).close()
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        for name in tables or []:
            bucketed = bucketed_name(version, name, database)
            source = bucketed if spark.catalog.tableExists(bucketed) else f"parquet.`{version}/{name}`"
            spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{name}` AS SELECT * FROM {source}")


def published(spark: SparkSession, out: str) -> list[str]:
    """The published versions, oldest first."""
    store, folder = _path(spark, f"{out}/{VERSIONS}")
    if not store.exists(folder):
        return []
    names = sorted(entry.getPath().getName() for entry in store.listStatus(folder))
    paths = [f"{out}/{VERSIONS}/{name}" for name in names]
    return [path for path in paths if store.exists(_path(spark, f"{path}/{MARKER}")[1])]


def current(spark: SparkSession, out: str) -> str:
    """Folder of the newest published version; the folder itself where there are no versions."""
    versions = published(spark, out)
    return versions[-1] if versions else out


def drop_versions(spark: SparkSession, out: str, keep: int = 2, database: str | None = None) -> int:
    """Delete published versions but the newest ``keep``, and return how many. Readers of those must have ended."""
    old = published(spark, out)[:-keep] if keep else []
    for version in old:
        for name in BUCKET_KEYS if database else ():
            spark.sql(f"DROP TABLE IF EXISTS {bucketed_name(version, name, database)}")
        store, path = _path(spark, version)
        store.delete(path, True)
    return len(old)


def write_tables(tables: dict[str, DataFrame], out: str, layout: dict[str, list[str]] = LAYOUT,
                 blooms: dict[str, list[str]] = BLOOM_FILTERS,
                 metrics: dict[str, list[Column]] | None = None) -> dict[str, dict]:
    """Replace each table under ``out`` by new Parquet files and return what was observed of each while writing.

    That is the number of ``rows`` and the further ``metrics`` asked for, aggregated by the writing tasks and not in a
    pass of their own. The tables are written side by side.
    """
    def write(name: str) -> dict:
        df, order = tables[name], layout.get(name)
        if order:
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        # above the range exchange, whose sampling also runs what is below it
        counted = Observation(f"rows of {name}")
        writer = df.observe(counted, F.count(F.lit(1)).alias("rows"), *(metrics or {}).get(name, [])).write.mode("overwrite")
        for column in blooms.get(name, []):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
                "parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{out}/{name}")
        return counted.get

    with ThreadPoolExecutor() as threads:
        return dict(zip(tables, threads.map(write, tables)))


def read_table(spark: SparkSession, out: str, name: str, schema: StructType | None = None) -> DataFrame:
    """A stored table of the current version; a known schema saves looking into its files."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{current(spark, out)}/{name}")


def has_table(spark: SparkSession, out: str, name: str) -> bool:
    try:
        read_table(spark, out, name)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def table_columns(spark: SparkSession, out: str, name: str) -> list[str]:
    """Column names; empty if there is no such table."""
    return read_table(spark, out, name).columns if has_table(spark, out, name) else []


def count_rows(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """(table_name, row_count) of tables that were counted while they were written."""
    return spark.createDataFrame(sorted(counts.items()), "table_name string, row_count long")


def table_counts(spark: SparkSession, out: str) -> DataFrame:
    """Number of rows of each table of the current version, as its build has stored it."""
    return read_table(spark, out, COUNTS)
