"""WARC archives: written by Spark's text writer, read back by boundary-chain verification."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywake.llm.store import Scratch

BLOCK_BYTES = 4 << 20       # of an archive that one task scans or reads
REVISIT_BYTES = 100         # smaller payloads are always stored
MAGIC = b"WARC/1.0\r\n"
HEADER_BYTES = 64 << 10     # read at a time while the end of a header is sought
FIRST_BYTES = 2 << 10       # of a header that are looked at first
CRLF = "\r\n"


# ---- writing

def digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha2(F.encode(payload, "UTF-8"), 256).alias("payload_digest"))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, refers_to) of pages whose payload a smaller page_id has; large groups meet as counts only."""
    sized = digests(pages).where(f"payload_bytes >= {REVISIT_BYTES} and page_id is not null").select("page_id", "payload_digest")
    first = sized.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    first = first.where("refers_to <> last").drop("last")
    return sized.join(first, "payload_digest").where("page_id <> refers_to").select(
        "page_id", "payload_digest", "refers_to").distinct()


def records(pages: DataFrame, copies: DataFrame, date: str) -> DataFrame:
    """One record per page as text; the empty line pair that ends it is the writer's line separator."""

    def line(name: str, value) -> F.Column:
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(CRLF))).otherwise("")

    rows = digests(pages).join(copies, ["page_id", "payload_digest"], "left")
    response = F.col("refers_to").isNull()
    body = F.when(response, F.col("payload")).otherwise("")
    urn = [F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">")) for c in ("page_id", "refers_to")]
    url = F.regexp_replace("url", "[\\x00-\\x20]", "%20")
    return rows.select(F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(response, F.lit("response")).otherwise("revisit")),
        line("WARC-Record-ID", F.coalesce(urn[0], F.lit("<urn:page:>"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Refers-To", urn[1]),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(CRLF), body).alias("value"))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per page (page_id, url, html) into plain WARC files, one per task, committed by Spark.

    Of equal payloads of at least 100 bytes the smallest page_id is the response and the others refer to it. Null
    html is an empty payload; rows without page_id are responses; rows that repeat the smallest page_id of a payload
    are responses as well, and rows of one page_id with different payloads are judged one by one. The table of
    revisits is written first, so that Spark knows its size when it chooses between broadcast and shuffle for the join
    with the pages. Other columns are ignored.
    """
    copies = Scratch(pages.sparkSession, "warc").keep(revisits(pages), "revisits")
    records(pages, copies, date).write.option("lineSep", CRLF * 2).text(folder)


# ---- reading

def _opened(path: str):
    """Any store that pyarrow knows by its address, read by ranges."""
    store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(inner)


def _header(file, at: int, size: int, ahead: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of the header at `at` and the offset of its payload; None where no record can begin.

    `ahead` holds the bytes from `at` on that have been read; more are read until the header ends.
    """
    if not MAGIC.startswith(ahead[:len(MAGIC)]) and not ahead.startswith(MAGIC):
        return None
    step = HEADER_BYTES
    while (end := ahead.find(b"\r\n\r\n")) < 0:
        lines = ahead[len(MAGIC):].split(b"\r\n")[:-1]
        if at + len(ahead) >= size or not all(b":" in line for line in lines):      # no header, however far it goes on
            return None
        ahead += file.read_at(min(step, size - at - len(ahead)), at + len(ahead))
        step *= 2
    if not ahead.startswith(MAGIC):
        return None
    fields = {}
    for line in ahead[len(MAGIC):end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
        return None
    return fields, at + end + 4


def _successor(payload: int, fields: dict[str, str], size: int) -> int | None:
    """Offset after the record, if it lies in the file."""
    end = payload + int(fields["content-length"]) + 4
    return end if end <= size else None


def blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """((path, size, block, start, stop), tasks): archives dealt out in blocks; only their names and sizes are listed.

    The rows are tiny but each stands for BLOCK_BYTES of reading, so they are dealt to a stated number of tasks, which
    adaptive execution does not coalesce: one per block, up to four per core or the number of shuffle partitions.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
             .select("path", F.col("length").alias("size")).where("size > 0"))
    rows = files.select("path", "size", F.explode(F.sequence(F.lit(0), (F.col("size") - 1).cast("bigint"), F.lit(BLOCK_BYTES))).alias("start"))
    count = files.agg(F.sum(F.ceil(F.col("size") / BLOCK_BYTES))).first()[0] or 0
    tasks = max(1, min(int(count), max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return rows.select("path", "size", (F.col("start") / BLOCK_BYTES).cast("bigint").alias("block"), "start",
                       F.least(F.col("start") + BLOCK_BYTES, "size").alias("stop")).repartition(tasks, "path", "block"), tasks


def candidates(dealt: DataFrame) -> DataFrame:
    """(path, size, offset, successor, exit): wherever in the blocks a record could begin, the offset of the next one.

    `exit` is the first offset beyond the block that the chain from here reaches, null where it breaks off.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found: list[tuple[int, int]] = []
                with _opened(row["path"]) as file:
                    data = file.read_at(min(row["stop"] + len(MAGIC), row["size"]) - row["start"], row["start"])
                    at = data.find(MAGIC)
                    while 0 <= at < row["stop"] - row["start"]:
                        head = _header(file, row["start"] + at, row["size"], data[at:at + FIRST_BYTES])
                        if head and (end := _successor(head[1], head[0], row["size"])) is not None:
                            found.append((row["start"] + at, end))
                        at = data.find(MAGIC, at + 1)
                leaves: dict[int, int | None] = {}
                for at, end in reversed(found):
                    leaves[at] = end if end >= row["stop"] else leaves.get(end)
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([row["path"]] * len(found), pa.string()),
                    "size": pa.array([row["size"]] * len(found), pa.int64()),
                    "offset": pa.array([at for at, _ in found], pa.int64()),
                    "successor": pa.array([end for _, end in found], pa.int64()),
                    "exit": pa.array([leaves[at] for at, _ in found], pa.int64())})

    return dealt.mapInArrow(scan, "path string, size bigint, offset bigint, successor bigint, exit bigint")


def entries(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, offset): the start of each file and every reachable offset at which a chain enters a further block.

    Pointer jumping: in each round the reached offsets jump along the pointers and the pointers double, so a file
    of n blocks takes log2(n) rounds.
    """
    edges = scratch.keep(edges, "edges")
    start = edges.where("offset = 0").select("path", "offset")
    targets = edges.where("exit < size").select("path", F.col("exit").alias("offset")).distinct()
    nodes = start.unionByName(targets).distinct()
    jumps = scratch.keep(edges.join(nodes, ["path", "offset"], "left_semi").where("exit < size").select(
        "path", "offset", "exit").distinct(), "jumps")
    reached = scratch.keep(start, "reached")
    largest = edges.agg(F.max("size")).first()[0] or 0
    for _ in range(math.ceil(math.log2(max(1, math.ceil(largest / BLOCK_BYTES))))):
        landed = reached.join(jumps, ["path", "offset"]).select("path", F.col("exit").alias("offset"))
        reached_next = scratch.keep(reached.unionByName(landed).distinct(), "reached")
        onward = jumps.select("path", F.col("offset").alias("exit"), F.col("exit").alias("beyond"))
        jumps_next = scratch.keep(jumps.join(onward, ["path", "exit"]).select(
            "path", "offset", F.col("beyond").alias("exit")), "jumps")
        scratch.drop(reached, jumps)
        reached, jumps = reached_next, jumps_next
    return reached


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all WARC files in a folder.

    Columns: path, offset, page_id, url, record_type, refers_to, payload_bytes and payload_digest (of the full
    payload, also for revisits; checked against the bytes of responses), payload (null for revisits, and in all rows
    with payloads=False). Text in a payload that looks like a record is not reachable from the file's start, so it
    is never taken for one. An empty folder has no records. A chain that breaks off (a damaged file) ends its file.
    """
    scratch = Scratch(spark, "warc")
    dealt, tasks = blocks(spark, folder)
    sized = scratch.keep(candidates(dealt), "candidates")
    todo = entries(sized, scratch).join(sized.select("path", "size").distinct(), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stop = (row["offset"] // BLOCK_BYTES + 1) * BLOCK_BYTES
                with _opened(row["path"]) as file:
                    yield from _records(file, row["path"], row["offset"], min(stop, row["size"]), row["size"], payloads)

    return todo.repartition(tasks, "path", "offset").mapInArrow(
        read, "path string, offset bigint, page_id bigint, url string, record_type string, refers_to bigint, "
              "payload_bytes bigint, payload_digest string, payload string")


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
    return int(found[1]) if found else None


def _records(file, path: str, at: int, stop: int, size: int, payloads: bool) -> Iterator[pa.RecordBatch]:
    """The records from `at` on that begin before `stop`, in batches of about a block."""
    names = ("path", "offset", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    rows: list[tuple] = []
    buffer, begins = file.read_at(min(stop + HEADER_BYTES, size) - at, at), at
    while at < stop:
        head = _header(file, at, size, buffer[at - begins:at - begins + FIRST_BYTES])
        if head is None or (end := _successor(head[1], head[0], size)) is None:
            break
        fields, start = head
        payload = buffer[start - begins:end - 4 - begins]
        if len(payload) < end - 4 - start:
            payload = file.read_at(end - 4 - start, start)
        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        length = int(fields.get("x-payload-bytes", len(payload)))
        if fields["warc-type"] != "revisit":
            if digest and digest != hashlib.sha256(payload).hexdigest():
                raise ValueError(f"{path}: the payload at {start} does not have its digest")
            digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
        text = payload.decode("utf-8", "replace") if payloads and fields["warc-type"] != "revisit" else None
        rows.append((path, at, _number(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields["warc-type"],
                     _number(fields.get("warc-refers-to")), length, digest, text))
        at = end
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back: the columns of read_archives.

    Rows without page_id come back without one, null html as an empty payload, repeated rows as often as given, no rows
    as none; other columns, whatever their names, are ignored.
    """
    folder = Scratch(pages.sparkSession, "warc").path("archives")
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder, payloads)
