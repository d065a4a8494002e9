"""WARC archives: a writer with revisit records, and a splittable reader.

The reader cuts archives into byte ranges. A task looks for the gzip magic within its
range, takes a place for a member's start only if what follows inflates to a WARC
header, and owns the records that start in its range, wherever they end.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm._shared import arrow_map, attach_groups, remove, shared_folder, written

MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
#: Bytes read and inflated at once.
READ = 1 << 20
#: Payloads under this many bytes are never revisits.
LEAST = 100


#: Names under which Spark knows stores, and those that tasks open files by.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + mark + rest)


def record(kind: str, fields: dict[str, str], payload: bytes) -> bytes:
    """A record as one gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields.items()], f"Content-Length: {len(payload)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + payload + b"\r\n\r\n") + pack.flush()


def _header_value(text: str) -> str:
    """One line: line ends and signs that would end a field are percent-encoded."""
    return "".join(c if c.isprintable() and c.isascii() and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for each row; returns (path, bytes) of the archives, a file for each task that had rows.

    Of rows with equal payloads of LEAST bytes or more, the one with the smallest id is a
    response and the others are revisits of it, without payload; a null id comes last.
    Repeated rows of the smallest id are responses too. Null payloads count as empty.
    An attempt writes under a name of its own and reports it at its end, so a task that
    was lost or run twice leaves only files that nobody lists.
    """
    spark = pages.sparkSession
    if not folder:  # the library's own, which goes when the interpreter ends
        atexit.register(remove, spark, folder := shared_folder(spark))
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.filter(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    ready = attach_groups(rows, written(groups), "digest", "n", pages.count()).select("id", "url", "payload", "digest", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, top = _place(folder)
        path, out, size = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for own, url, body, digest, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    place.create_dir(top, recursive=True)
                    out = place.open_output_stream(f"{top}/{path}", compression=None)
                fields = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "X-Page-ID": "" if own is None else str(own)}
                if url is not None:
                    fields["WARC-Target-URI"] = _header_value(url)
                fields |= {"WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(body)), "Content-Type": "text/html"}
                again = first is not None and own != first
                if again:
                    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(first)}
                size += out.write(record("revisit" if again else "response", fields, b"" if again else body))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([size], pa.int64())], ["path", "bytes"])

    return written(arrow_map(ready, write, "path string, bytes long"))


class _Source:
    """A file's bytes from some place on, read ahead as needed."""

    def __init__(self, file: pa.NativeFile, start: int) -> None:
        self.file, self.start, self.held = file, start, b""
        file.seek(start)

    def fill(self) -> bool:
        more = self.file.read(READ)
        self.held += more
        return bool(more)

    def drop(self, n: int) -> None:
        self.start += n
        self.held = self.held[n:]


def _member(source: _Source) -> tuple[bytes, int] | None:
    """The member at the start of ``source`` and its length, or None if no WARC record starts there."""
    pull, parts, head, at, rest = zlib.decompressobj(31), [], b"", 0, b""
    while not pull.eof:
        if not rest:
            if at >= len(source.held) and not source.fill():
                parts.append(pull.flush())  # what was read, but not given out yet
                if not pull.eof:
                    return None
                break
            rest = source.held[at : at + READ]
            at += len(rest)
        try:
            # little is inflated until the start is judged, so that a false magic can't blow up
            parts.append(pull.decompress(rest, READ if head == _VERSION else 64))
        except zlib.error:
            return None
        rest = pull.unconsumed_tail
        if len(head) < len(_VERSION):
            head = (head + parts[-1])[: len(_VERSION)]
            if not _VERSION.startswith(head):
                return None
    data = b"".join(parts)  # a header may have any length
    return (data, at - len(pull.unused_data)) if head == _VERSION and b"\r\n\r\n" in data else None


def _records(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records that start in [start, end)."""
    source = _Source(file, start)
    while True:
        at = source.held.find(MAGIC)
        while at < 0:
            source.drop(max(0, len(source.held) - 2))
            if source.start >= end or not source.fill():
                return
            at = source.held.find(MAGIC)
        source.drop(at)
        if source.start >= end:
            return
        found = _member(source)
        if found is None:
            source.drop(1)
            continue
        data, length = found
        source.drop(length)
        head, _, body = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields.get("content-length", "0"))
        yield fields, body[:size]


def read_archives(spark: SparkSession, archives: DataFrame, split: int = 4 << 20, keep_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of each record.

    archives has (path, bytes). Ranges of ``split`` bytes are dealt to tasks; a file may be cut
    anywhere. A response's length and digest are those of what was read; a revisit's are in its header.
    """
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    n = max(1, ranges.count())
    dealt = ranges.repartitionByRange(n, "path", "start") if n > 1 else ranges

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                place, name = _place(path)
                with place.open_input_file(name) as file:
                    rows: list[tuple] = []
                    held = 0
                    for fields, body in _records(file, start, start + split):
                        again, own = fields.get("warc-type") == "revisit", fields.get("x-page-id") or None
                        digest = fields["warc-payload-digest"].partition(":")[2] if again else hashlib.sha256(body).hexdigest()
                        size = int(fields["x-payload-length"]) if again else len(body)
                        refers = fields.get("x-refers-to-page")
                        rows.append((own and int(own), size, digest, "revisit" if again else "response", refers and int(refers), body if keep_payload else None))
                        held += len(body)
                        if held > READ:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    out = dealt.mapInArrow(read, kinds)
    return out if keep_payload else out.drop("payload")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def round_trip(pages: DataFrame, **options: object) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads these back."""
    return read_archives(pages.sparkSession, write_archives(pages), **options)
