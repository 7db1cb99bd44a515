"""WARC archives with a two-level capture index.

Writing: every page becomes one gzip member in an archive of its task; equal payloads become
revisit records that refer to the first. Each record's place goes to the index: lines sorted
by reversed-host URL key, compressed in blocks of ``BLOCK_LINES``, with a sparse directory of
the blocks' first keys beside each index file. Reading: a key is searched in the list of index
files, then by bisection in one directory, then in one block; records are read by range.

Files are written to the shared folder under the number of their partition, completely before
they take their name, so that a task that runs again replaces them by the same content.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.common import pieces, ready, saved
from groundwell.operators.sizes import broadcast_if_small
from groundwell.settings import shared_folder

#: Payloads of fewer bytes are always written out.
REVISIT_BYTES = 100
#: Index lines of a compressed block.
BLOCK_LINES = 1000
#: Index files, at most; their first keys are all that the driver ever holds.
INDEX_FILES = 2048
#: Index lines of a file, unless there would be more files than ``INDEX_FILES``.
INDEX_LINES = 100_000
_PART = "{:06d}"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host reversed by labels, port, path and query, in lower case.

    ``http://www.Example.com:80/A?b`` becomes ``com,example:80)/a?b``; scheme, user, a leading
    ``www.`` and a fragment are left out. A null URL has the empty key.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"(?s)#.*$", "")
    bare = F.regexp_replace(bare, r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"^[^/?@]*@", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?:]*)", 1), r"^www\d*\.", "")
    port = F.regexp_extract(bare, r"^[^/?:]*(:\d*)?", 1)
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    labels = F.concat_ws(",", F.reverse(F.split(host, r"\.")))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(labels, port, F.lit(")"), rest))


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the path in it."""
    scheme, _, path = uri.partition(":") if ":" in uri.split("/")[0] else ("file", "", uri)
    if scheme == "file":
        uri = "file:///" + path.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _put(store: fs.FileSystem, path: str, data: Iterator[bytes]) -> None:
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    with store.open_output_stream(partial, compression=None) as out:
        for part in data:
            out.write(part)
    store.move(partial, path)


def record_bytes(
    page_id: int | None, url: str | None, kind: str, digest: str, payload: bytes, refers_to: int | None
) -> bytes:
    """One WARC record, compressed as a member of its own."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        payload = b""
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    lines.append(f"Content-Length: {len(payload)}")
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return gzip.compress(head + payload + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a compressed record."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _page_of(urn: str) -> int | None:
    number = urn[len("<urn:page:") : -1]
    return int(number) if number else None


@dataclass(frozen=True)
class Archive:
    """A folder with archives below ``warc`` and index files below ``index``."""

    folder: str


def write_archive(pages: DataFrame, folder: str | None = None) -> Archive:
    """Write ``pages`` (``page_id, url, html``) and index them.

    A null html is an empty payload, a null url an empty one; a null page_id is written
    without a number. Of equal payloads of ``REVISIT_BYTES`` or more the smallest page_id is a
    response and all others refer to it; where rows repeat that id, all rows with it are
    responses, as are all where no id is known. Other columns are not read. An empty table
    gives an archive without files.

    Only hashes are shuffled while the list of payloads that occur twice is small enough to be
    broadcast; beyond that page texts are joined with it once, and adaptive execution splits a
    digest with very many copies.
    """
    spark = pages.sparkSession
    ready(spark)
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    store, root = filesystem(folder)
    for name in ("warc", "index"):
        store.create_dir(f"{root}/{name}", recursive=True)
    payload = F.coalesce("html", F.lit(""))
    own = pages.select(
        "page_id",
        F.col("url").cast("string").alias("url"),
        payload.alias("html"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    first = saved(
        own.where(F.col("bytes") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("same"), "first")
    )
    marked = own.join(
        broadcast_if_small(first), F.col("digest") == F.col("same"), "left"
    ).select(
        "page_id",
        "url",
        "html",
        "digest",
        F.when(F.col("first") != F.coalesce("page_id", F.col("first") + 1), F.col("first")).alias(
            "refers_to"
        ),
        url_key(F.col("url")).alias("key"),
    ).sortWithinPartitions("digest", "page_id", "url")  # so that a second attempt writes the same

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = filesystem(folder)
        name = f"warc/{_PART.format(TaskContext.get().partitionId())}.warc.gz"
        at, entries = 0, []

        def members() -> Iterator[bytes]:
            nonlocal at
            for piece in pieces(batches, "html"):
                for row in piece.to_pylist():
                    kind = "response" if row["refers_to"] is None else "revisit"
                    data = record_bytes(
                        row["page_id"], row["url"], kind, row["digest"],
                        row["html"].encode(), row["refers_to"],
                    )
                    entries.append((row["key"], row["page_id"], name, at, len(data)))
                    at += len(data)
                    yield data

        _put(store, f"{root}/{name}", members())
        for start in range(0, len(entries), 10_000):
            columns = list(zip(*entries[start : start + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()),
                 pa.array(columns[4], pa.int64())],
                ["key", "page_id", "file", "offset", "length"],
            )

    entries = saved(
        marked.mapInArrow(
            write, "key string, page_id bigint, file string, offset bigint, length bigint"
        )
    )
    total = entries.count()
    files = max(1, min(INDEX_FILES, -(-total // INDEX_LINES)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = filesystem(folder)
        name = f"{root}/index/{_PART.format(TaskContext.get().partitionId())}"
        directory: list[tuple[str, int, int]] = []
        at, lines, last = 0, [], ""

        def block() -> bytes:
            nonlocal at, lines
            data = gzip.compress("".join(line for _, line in lines).encode(), 6, mtime=0)
            directory.append((lines[0][0], at, len(data)))
            at, lines = at + len(data), []
            return data

        def blocks() -> Iterator[bytes]:
            nonlocal last
            for batch in batches:
                for row in batch.to_pylist():
                    key = row.pop("key")
                    lines.append((key, json.dumps([key, *row.values()]) + "\n"))
                    last = key
                    if len(lines) == BLOCK_LINES:
                        yield block()
            if lines:
                yield block()

        _put(store, f"{name}.cdx.gz", blocks())
        if directory:
            rows = "".join(json.dumps(row) + "\n" for row in directory)
            _put(store, f"{name}.dir", iter([rows.encode()]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([directory[0][0]]), pa.array([last])],
                ["name", "first", "last"],
            )

    # Captures of one URL or host are split by number where they are many.
    parts = (
        entries.repartitionByRange(files, "key", "page_id")
        .sortWithinPartitions("key", "page_id", "file", "offset")
        .mapInArrow(index, "name string, first string, last string")
    )
    listing = sorted((r["first"], r["last"], r["name"]) for r in parts.collect())
    _put(store, f"{root}/index/files.json", iter([json.dumps(listing).encode()]))
    return Archive(folder)


class IndexReader:
    """Looks keys up in the index; asked in order, it reads every block once."""

    def __init__(self, folder: str) -> None:
        self.store, self.root = filesystem(folder)
        with self.store.open_input_stream(f"{self.root}/index/files.json") as source:
            self.files = [tuple(x) for x in json.loads(source.read())]
        self.lasts = [last for _, last, _ in self.files]
        self.name, self.directory, self.starts = "", [], []
        self.block, self.lines, self.keys = ("", -1), [], []

    def _open(self, name: str) -> None:
        if name != self.name:
            with self.store.open_input_stream(f"{name}.dir") as source:
                self.directory = [json.loads(x) for x in source.read().decode().splitlines()]
            self.name, self.starts = name, [first for first, _, _ in self.directory]

    def _read(self, at: int, length: int) -> None:
        if self.block != (self.name, at):
            with self.store.open_input_file(f"{self.name}.cdx.gz") as source:
                data = gzip.decompress(source.read_at(length, at)).decode()
            self.lines = [json.loads(x) for x in data.splitlines()]
            self.keys = [x[0] for x in self.lines]
            self.block = (self.name, at)

    def find(self, key: str) -> Iterator[list]:
        """``[key, page_id, file, offset, length]`` of every capture of a key."""
        for first, _, name in self.files[bisect_left(self.lasts, key) :]:
            if first > key:
                return
            self._open(name)
            # The block before the first that starts with the key may end with it.
            for _, at, length in self.directory[
                max(0, bisect_left(self.starts, key) - 1) : bisect_right(self.starts, key)
            ]:
                self._read(at, length)
                yield from self.lines[bisect_left(self.keys, key) : bisect_right(self.keys, key)]


def look_up(spark: SparkSession, archive: Archive, keys: DataFrame) -> DataFrame:
    """``key, page_id, file, offset, length`` of the captures of each of ``keys`` (``key``).

    Keys are sorted over tasks, so that a task reads neighbouring blocks, each once. Repeated
    keys are looked up once; null keys and keys without captures give no rows.
    """
    ready(spark)
    folder = archive.folder

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: IndexReader | None = None
        for batch in batches:
            reader = reader or IndexReader(folder)
            rows: list[list] = []
            for key in batch.column("key").to_pylist():
                for line in reader.find(key):
                    rows.append(line)
                    if len(rows) == 10_000:
                        yield _located(rows)
                        rows = []
            if rows:
                yield _located(rows)

    return (
        keys.select("key")
        .where("key is not null")
        .distinct()
        .repartitionByRange(_tasks(spark), "key")
        .sortWithinPartitions("key")
        .mapInArrow(
            find, "key string, page_id bigint, file string, offset bigint, length bigint"
        )
    )


def _tasks(spark: SparkSession) -> int:
    """Tasks that look up or read: rows are small here and what they lead to is not, so that
    their number must not follow from the bytes that are shuffled."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _located(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        ["key", "page_id", "file", "offset", "length"],
    )


def read_records(spark: SparkSession, archive: Archive, located: DataFrame) -> DataFrame:
    """``page_id, url, record_type, refers_to, digest, payload`` of records, read by range.

    ``located`` has ``file, offset, length``. The payload of a revisit is empty.
    """
    ready(spark)
    folder = archive.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        opened, source = None, None
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for row in batch.to_pylist():
                if row["file"] != opened:
                    if source is not None:
                        source.close()
                    opened, source = row["file"], store.open_input_file(f"{root}/{row['file']}")
                headers, payload = parse_record(source.read_at(row["length"], row["offset"]))
                refers = headers.get("WARC-Refers-To")
                rows.append(
                    (
                        _page_of(headers["WARC-Record-ID"]),
                        headers["WARC-Target-URI"],
                        headers["WARC-Type"],
                        None if refers is None else _page_of(refers),
                        headers["WARC-Payload-Digest"].removeprefix("sha256:"),
                        payload,
                        hashlib.sha256(payload).hexdigest(),
                    )
                )
                held += len(payload)
                if held > 8 << 20:
                    yield _records(rows)
                    rows, held = [], 0
            if rows:
                yield _records(rows)
        if source is not None:
            source.close()

    return (
        located.select("file", "offset", "length")
        .repartitionByRange(_tasks(spark), "file", "offset")
        .sortWithinPartitions("file", "offset")
        .mapInArrow(
            read,
            "page_id bigint, url string, record_type string, refers_to bigint, digest string, "
            "payload binary, payload_digest string",
        )
    )


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [
        pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(),
    ]
    names = [
        "page_id", "url", "record_type", "refers_to", "digest", "payload", "payload_digest",
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
    )


def captures(pages: DataFrame) -> DataFrame:
    """Write ``pages``, look all of them up in the index, and read every record back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` per page; of a revisit
    the payload read from the record that it refers to.
    """
    spark = pages.sparkSession
    archive = write_archive(pages)
    located = look_up(spark, archive, pages.select(url_key(F.col("url")).alias("key")))
    read = saved(
        read_records(spark, archive, located).select(
            "page_id",
            "record_type",
            "refers_to",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            "payload_digest",
        )
    )
    store, root = filesystem(archive.folder)
    store.delete_dir(root)
    answers = (
        read.where("record_type = 'response' and page_id is not null")
        .groupBy(F.col("page_id").alias("of"))
        .agg(
            F.max_by(F.struct("payload_bytes", "payload_digest"), "payload_bytes").alias("full")
        )
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = read.where("record_type = 'response'").select(*columns)
    revisits = (
        read.where("record_type = 'revisit'")
        .drop("payload_bytes", "payload_digest")
        .join(answers, F.col("refers_to") == F.col("of"))
        .select("page_id", "full.*", "record_type", "refers_to")
        .select(*columns)
    )
    return responses.unionByName(revisits)
