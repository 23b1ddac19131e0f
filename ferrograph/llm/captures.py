"""A two-level index of web captures: sorted, compressed blocks of reversed-host keys under a sparse directory.

Captures are written as compressed WARC records, each for itself, into files of the shared folder. Their index entries (key,
place of the record) are sorted by key over the cluster and written as compressed blocks of ``BLOCK`` entries; the directory has
one row for each block: its first and last key and where it lies. A lookup sorts the asked keys, and each task reads the slice of
the directory that its keys span, finds the block of each key by binary search, reads that range alone, finds the entries by
binary search within it, and reads the range of each record. Neither level is ever held whole.

A key is the host in lower case with its labels in reverse, a closing parenthesis, port, path and query: http://a.example.com/x?y
has com,example,a)/x?y. Files have names that no other attempt of a task takes, and rows name the files that they were written
to, so a task that is repeated does no harm.

Defined cases: a null url has no key and no capture. A null page is kept as null, an empty one as empty. Several captures of a
key are all found, also over several blocks; a key with more captures than a range has is still found whole, as ranges are cut by
key and id. Rows that repeat are captures of their own. A key without a capture gives no row. Null ids stay null; ids of any type
that a string keeps apart come back as they were. Very long pages are kept whole. An empty table gives an empty index. Only the
three columns named are read, whatever others there are.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ferrograph.llm.frames import shared_path, staged

BLOCK = 256
#: Entries to a range of keys, which one task sorts and writes, and keys that one task looks up, at most (about).
RANGE = 8192
LOOKUPS = 4096
URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]*)(:[0-9]+)?([^?#]*)(\?[^#]*)?"


def url_key(url: Column) -> Column:
    part = lambda k: F.regexp_extract(url, URL, k)
    host = F.array_join(F.reverse(F.split(F.lower(part(1)), r"\.")), ",")
    return F.when(url.isNotNull(), F.concat(host, F.lit(")"), part(2), part(3), part(4)))


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Paths have a scheme always (see ``qualified``), so that executors and Spark mean the same place."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def qualified(spark, path: str) -> str:
    """``path`` with the scheme that Spark gives it: that of fs.defaultFS, where it has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def pack(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def record(url: str, html: str | None) -> bytes:
    body = b"" if html is None else html.encode()
    head = f"WARC/1.0\r\nWARC-Type: {'revisit' if html is None else 'response'}\r\nWARC-Target-URI: {json.dumps(url)}\r\nContent-Length: {len(body)}\r\n\r\n"
    return pack(head.encode() + body + b"\r\n\r\n")


def payload(raw: bytes) -> str | None:
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return None if lines["WARC-Type"] == "revisit" else rest[: int(lines["Content-Length"])].decode()


class Appender:
    """A file of its own, opened when first written to."""

    def __init__(self, folder: str, kind: str):
        self.folder, self.name, self.stream, self.at = folder, f"{kind}-{uuid.uuid4().hex}", None, 0

    def write(self, data: bytes) -> tuple[int, int]:
        if self.stream is None:
            fs, path = filesystem(self.folder)
            fs.create_dir(path, recursive=True)
            self.stream = fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()


class Ranges:
    """Reads ranges of files of a folder, with some of them open."""

    def __init__(self, folder: str, most: int = 64):
        self.fs, self.path = filesystem(folder)
        self.open: dict[str, pa.NativeFile] = {}
        self.most = most

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.path}/{name}")
        return self.open[name].read_at(length, offset)


def write_captures(pages: DataFrame, folder: str) -> DataFrame:
    """(key, id, url, file, offset, length) of the written records. pages: (id, url, html)."""
    schema = T.StructType([T.StructField("key", T.StringType()), pages.schema["id"], *(T.StructField(n, t) for n, t in (("url", T.StringType()), ("file", T.StringType()), ("offset", T.LongType()), ("length", T.LongType())))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Appender(folder, "warc")
        for batch in batches:
            places = [out.write(record(u.as_py(), h.as_py())) for u, h in zip(batch.column("url"), batch.column("html"), strict=True)]
            columns = [batch.column("key"), batch.column("id"), batch.column("url"), pa.array([out.name] * len(places)), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        out.close()

    keyed = pages.filter(F.col("url").isNotNull()).select(url_key(F.col("url")).alias("key"), "id", "url", "html")
    return keyed.mapInArrow(run, schema)


def write_blocks(entries: DataFrame, folder: str, block: int, parts: int) -> DataFrame:
    """The directory: (first, last, file, offset, length, entries) of each block."""
    columns = ["id", "url", "file", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, found = Appender(folder, "cdx"), [], []

        def flush(n: int) -> None:
            while len(held) >= max(n, 1):
                some = held[:block]
                del held[:block]
                data = zlib.compress("\n".join(json.dumps(x, default=str) for x in some).encode(), 6)
                found.append((some[0][0], some[-1][0], out.name, *out.write(data), len(some)))

        for batch in batches:
            held += zip(*(batch.column(n).to_pylist() for n in ("key", *columns)), strict=True)
            flush(block)
        flush(1)
        out.close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["first", "last", "file", "offset", "length", "entries"])

    ordered = entries.repartitionByRange(parts, "key", F.col("id")).sortWithinPartitions("key", "id", "file", "offset")
    return ordered.mapInArrow(run, "first string, last string, file string, offset long, length long, entries long")


class Index:
    """Paths of the three parts: records, blocks and directory."""

    def __init__(self, folder: str, directory: str, id_type: T.DataType, parts: int):
        self.folder, self.directory, self.id_type, self.parts = folder, directory, id_type, parts


def build(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", block: int = BLOCK) -> Index:
    spark = pages.sparkSession
    folder, directory = (qualified(spark, shared_path(spark, n)) for n in ("captures", "directory"))
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    entries = staged(write_captures(rows, folder), "entries")
    parts = max(1, -(-entries.count() // RANGE))
    write_blocks(entries, folder, block, parts).write.parquet(directory)
    return Index(folder, directory, pages.schema[id_col].dataType, parts)


def lookup(index: Index, keys: DataFrame) -> DataFrame:
    """The captures of all ``key`` of keys: ``url_key, page_id, url, html``."""
    schema = T.StructType([T.StructField("url_key", T.StringType()), T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
    arrow = to_arrow_schema(schema)
    folder, place = index.folder, index.directory

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder)
        fs, path = filesystem(place)
        directory = pads.dataset(path, filesystem=fs, format="parquet")
        held: tuple[int, list, list] = (-1, [], [])
        for batch in batches:
            asked = batch.column("key").to_pylist()
            if not asked:
                continue
            span = (pads.field("last") >= asked[0]) & (pads.field("first") <= asked[-1])
            blocks = sorted(zip(*(c.to_pylist() for c in directory.to_table(columns=["first", "last", "file", "offset", "length"], filter=span).columns), strict=True))
            lasts, held, out = [b[1] for b in blocks], (-1, [], []), []
            for key in asked:
                k = bisect.bisect_left(lasts, key)  # the first block that can have it
                while k < len(blocks) and blocks[k][0] <= key:
                    if held[0] != k:
                        rows = [json.loads(x) for x in zlib.decompress(ranges.read(*blocks[k][2:])).split(b"\n")]
                        held = (k, rows, [r[0] for r in rows])
                    for r in held[1][bisect.bisect_left(held[2], key) : bisect.bisect_right(held[2], key)]:
                        out.append((key, r[1], r[2], payload(ranges.read(r[3], r[4], r[5]))))
                        if len(out) >= 500:
                            yield rows_of(out, arrow)
                            out = []
                    k += 1
            if out:
                yield rows_of(out, arrow)

    asked = staged(keys.select("key").filter(F.col("key").isNotNull()).distinct(), "asked")
    parts = max(1, min(index.parts, -(-asked.count() // LOOKUPS)))
    found = asked.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, schema)
    return found.withColumn("page_id", F.col("page_id").cast(index.id_type))


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
