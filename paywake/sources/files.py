"""Reading attempt files: what a file is and how it is written is found from a bounded sample, then it is read strictly."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paywake.schema import ATTEMPT_COLUMNS, LENIENT_TYPES

SAMPLE_LINES = 1000     # that the dialect is found from
DELIMITERS = (",", ";", "\t", "|")
QUOTES = ('"', "'")
#: Stands for an absent value while CSV is parsed. With Spark's default, empty text, a quoted empty value is NULL too.
ABSENT = "\uffff"
#: Ways to write a time, tried in this order. The first is what a cast reads.
TIME_FORMATS = (None, "dd/MM/yyyy HH:mm[:ss]", "MM/dd/yyyy HH:mm[:ss]", "dd-MM-yyyy HH:mm[:ss]", "yyyy/MM/dd HH:mm[:ss]",
                "dd.MM.yyyy HH:mm[:ss]")

# File names tried first, in this order.
PREFERRED_NAMES = ("challenge_data.csv.gz", "challenge_data.csv", "challenge_data.parquet")


def resolve_source(spark: SparkSession, folder: str, explicit: str | None = None,
                   preferred=PREFERRED_NAMES) -> str:
    """Path of the input file: the explicit one, else a preferred name, else the first by name.

    The listing is a Spark scan of file names only, so it works on any file system Spark can read.
    """
    if explicit is not None:
        names = spark.read.format("binaryFile").load(explicit).select("path")  # fails if it is missing
        if names.isEmpty():
            raise FileNotFoundError(explicit)
        return explicit
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{csv,CSV,gz,GZ,parquet,PARQUET}")
        .load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    )
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col("name"))
    first = listed.orderBy((place == 0), place, "name").select("path").head()
    if first is None:
        raise FileNotFoundError(f"no .csv, .gz or .parquet file in {folder}")
    return first["path"]


def _store(spark: SparkSession, path: str):
    """(file system, path) of the store that a path is in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The data files that a path, folder or glob stands for, by name; hidden files and folders are left out."""
    store, pattern = _store(spark, path)
    files, entries = [], list(store.globStatus(pattern) or [])
    while entries:
        entry = entries.pop()
        name = entry.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if entry.isDirectory():
            entries += store.listStatus(entry.getPath())
        elif entry.getLen():
            files.append(entry.getPath().toString())
    return sorted(files)


def file_format(spark: SparkSession, path: str) -> str:
    """"parquet" or "csv" by the first four bytes of the first data file, whatever it is called."""
    files = data_files(spark, path)
    if not files:
        raise FileNotFoundError(path)
    store, first = _store(spark, files[0])
    stream = store.open(first)
    try:
        start = bytes(max(0, stream.read()) for _ in range(4))
    finally:
        stream.close()
    return "parquet" if start == b"PAR1" else "csv"


def locate(spark: SparkSession, source: str, fmt: str | None = None) -> tuple[str, str]:
    """(path, format) of a source: a file, a glob, a folder of part files, or a folder to choose a file from.

    A folder stands for itself where its files are the parts of one table (named part-...); else resolve_source chooses.
    """
    store, path = _store(spark, source)
    if store.exists(path) and store.getFileStatus(path).isDirectory():
        names = [file.rsplit("/", 1)[-1] for file in data_files(spark, source)]
        if not all(name.startswith("part-") for name in names):
            source = resolve_source(spark, source)
    return source, fmt or file_format(spark, source)


@dataclass(frozen=True)
class Dialect:
    """How a CSV file is written: delimiter, quote, and the format of each time column (None: as a cast reads it)."""

    delimiter: str = ","
    quote: str = '"'
    times: tuple[tuple[str, str | None], ...] = ()


def find_dialect(spark: SparkSession, path: str) -> Dialect:
    """The dialect of a CSV or gzip CSV file from its first SAMPLE_LINES lines.

    The delimiter and quote are those that find the most of the attempt columns in the header, commas first. A time
    column has the first format that reads all its sampled values; where none does, what a cast cannot read is NULL.
    """
    first = data_files(spark, path)
    if not first:
        raise FileNotFoundError(path)
    lines = [row["value"] for row in spark.read.text(first[0]).limit(SAMPLE_LINES).collect()]
    known = {name for name, _ in ATTEMPT_COLUMNS}
    header = lines[0].lstrip("\ufeff") if lines else ""

    def found(delimiter: str, quote: str) -> int:
        return len(known & {field.strip().strip(quote) for field in header.split(delimiter)})

    delimiter, quote = max(((d, q) for d in DELIMITERS for q in QUOTES), key=lambda pair: found(*pair))
    sample = spark.createDataFrame([(line,) for line in lines], "value string")
    names = [field.strip().strip(quote) for field in header.split(delimiter)]
    times = [name for name, kind in ATTEMPT_COLUMNS if kind in LENIENT_TYPES and name in names]
    if not times or len(lines) < 2:
        return Dialect(delimiter, quote)
    fields = F.from_csv("value", F.lit(", ".join(f"`{name}` string" for name in names)), {"sep": delimiter, "quote": quote, "escape": '"'})
    rows = sample.where(F.col("value") != lines[0]).select(F.inline(F.array(fields)))
    misread = rows.agg(*(
        F.count_if((F.col(f"`{name}`") != "") & _time(F.col(f"`{name}`"), form).isNull()).alias(f"{no} {name}")
        for name in times for no, form in enumerate(TIME_FORMATS))).first()
    return Dialect(delimiter, quote, tuple(
        (name, next((form for no, form in enumerate(TIME_FORMATS) if not misread[f"{no} {name}"]), None)) for name in times))


def _time(column: Column, form: str | None) -> Column:
    if form is None:
        return column.try_cast("timestamp_ntz")
    return F.try_to_timestamp(column, F.lit(form)).cast("timestamp_ntz")


def _typed(name: str, kind: str, times: dict[str, str | None]) -> Column:
    """Strict cast; a whole number may be written with decimals, as exports of columns with gaps do."""
    column = F.col(name)
    if kind in LENIENT_TYPES:
        return _time(column, times[name]) if times.get(name) else column.try_cast(kind)
    if kind in ("int", "bigint"):
        return F.coalesce(column.try_cast(kind), F.bround(column.cast("double")).cast(kind))     # halves to even
    return column.cast(kind)


def type_attempts(raw: DataFrame, dialect: Dialect = Dialect()) -> DataFrame:
    """Select the attempt columns by name and cast them."""
    times = dict(dialect.times)
    return raw.select(*(_typed(name, kind, times).alias(name) for name, kind in ATTEMPT_COLUMNS))


def read_attempts(spark: SparkSession, path: str, fmt: str | None = None, spread_gzip: int | None = None,
                  multiline: bool = False, dialect: Dialect | None = None) -> DataFrame:
    """Typed attempts from a CSV, gzip CSV or Parquet file, folder or glob.

    The format (by content) and the dialect of CSV are found from a sample unless given. CSV columns are read as text
    and bound by header name. Quotes inside quotes are doubled, a backslash is an ordinary character, and all columns
    are parsed in every query, so that a malformed row fails each of them. Keys keep their text as written, leading
    zeros included. Nothing between delimiters is NULL, a quoted empty value is empty text (NULL as a number or time).
    Line breaks inside quotes need ``multiline``, which reads each file in one task. One gzip file is
    one read task, so its rows are spread before anything else runs, over ``spread_gzip`` partitions if it is set and
    over Spark's number of shuffle partitions otherwise; 0 leaves them together.
    """
    fmt = fmt or file_format(spark, path)
    if fmt == "parquet":
        return type_attempts(spark.read.parquet(path))
    dialect = dialect or find_dialect(spark, path)
    raw = (
        spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"')
        .option("sep", dialect.delimiter).option("quote", dialect.quote)
        .option("columnPruning", False).option("multiLine", multiline)
        .option("nullValue", ABSENT).option("emptyValue", "").csv(path)
        .replace("", None, [name for name, kind in ATTEMPT_COLUMNS if kind != "string"])
    )
    if spread_gzip != 0 and any(file.lower().endswith(".gz") for file in data_files(spark, path)):
        # try_seq in the key keeps one huge session from landing in one partition
        keys = ("session_key", "try_seq", "try_created_at")
        raw = raw.repartition(spread_gzip, *keys) if spread_gzip else raw.repartition(*keys)
    return type_attempts(raw, dialect)
