"""Stored samples as a data source of their own: ``spark.dataSource.register(Samples)``, then format ``callgrain_samples``.

A store is a folder: data files, each with rows of one bucket of ids, and a log with an entry for each write, which names
its files. Readers see what the log names. So a write is there as a whole or not at all, a search for ids reads
their buckets alone, and a stream goes from entry to entry. One write is committed at a time.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from callgrain.sources import stores

SCHEMA = "id string, label string, content binary, duration_s double, net_speech_s double, qc_json string, notes string, created_at timestamp"
#: Buckets of ids.
BUCKETS = 64


def bucket(sample_id: str | None) -> int:
    return zlib.crc32((sample_id or "").encode()) % BUCKETS


def _log(path: str) -> tuple[fs.FileSystem, str, list[str]]:
    """The store's file system, its place there, and the names of its log's entries in their order."""
    store, top = stores.place(path.rstrip("/"))
    found = store.get_file_info(fs.FileSelector(f"{top}/log", allow_not_found=True))
    return store, top, sorted(f.base_name for f in found if f.base_name.endswith(".json"))


def _entry(store: fs.FileSystem, top: str, name: str) -> list[dict]:
    with store.open_input_stream(f"{top}/log/{name}") as f:
        return json.loads(f.read())["files"]


@dataclass
class Part(InputPartition):
    """Files of one bucket."""

    bucket: int
    files: list[str]


def _parts(path: str, first: int, last: int, wanted: set[int] | None = None) -> list[Part]:
    """By bucket, the files of the log's entries first to last - 1."""
    store, top, names = _log(path)
    files = defaultdict(list)
    for name in names[first:last]:
        for f in _entry(store, top, name):
            if wanted is None or f["bucket"] in wanted:
                files[f["bucket"]].append(f["file"])
    return [Part(b, own) for b, own in sorted(files.items())]


def _rows(path: str, part: Part, ids: set[str] | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    store, top = stores.place(path.rstrip("/"))
    for file in part.files:
        with store.open_input_file(f"{top}/data/{file}") as f:
            for batch in pq.ParquetFile(f).iter_batches(64, columns=names):
                if ids is not None:
                    batch = batch.filter(pc.is_in(batch.column("id"), pa.array(sorted(ids), pa.string())))
                if batch.num_rows:
                    yield batch.select(names)


class Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names, self.ids = path, names, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """``id = x`` and ``id in (...)`` are dealt with here, and that such an id is not null; all others are handed back."""
        for f in sorted(filters, key=lambda f: isinstance(f, IsNotNull)):
            if isinstance(f, IsNotNull) and f.attribute == ("id",) and self.ids is not None:
                continue
            own = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if own is not None and f.attribute == ("id",):
                own.discard(None)
                self.ids = own if self.ids is None else self.ids & own
            else:
                yield f

    def partitions(self) -> list[Part]:
        wanted = None if self.ids is None else {bucket(i) for i in self.ids}
        return _parts(self.path, 0, 1 << 62, wanted) or [Part(-1, [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition, self.ids, self.names)


class StreamReader(DataSourceStreamReader):
    """Offsets count entries of the log."""

    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names = path, names

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        return {"entries": len(_log(self.path)[2])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return _parts(self.path, start["entries"], end["entries"])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition, None, self.names)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class Writer(DataSourceArrowWriter):
    """Tasks write files that no one sees; commit() names them in the log, abort() removes them."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = stores.place(self.path)
        store.create_dir(f"{top}/data", recursive=True)
        held: dict[int, tuple[str, pq.ParquetWriter]] = {}
        try:
            for batch in iterator:
                owner = pa.array([bucket(i) for i in batch.column(batch.schema.get_field_index("id")).to_pylist()], pa.int32())
                for b in set(owner.to_pylist()):
                    own = batch.filter(pc.equal(owner, b))
                    if b not in held:
                        name = f"{self.job}-{uuid.uuid4().hex}-{b}.parquet"
                        held[b] = name, pq.ParquetWriter(f"{top}/data/{name}", batch.schema, filesystem=store)
                    held[b][1].write_batch(own)
        finally:
            for _, out in held.values():
                out.close()
        return Written([{"bucket": b, "file": name} for b, (name, _) in held.items()])

    def commit(self, messages: list[Written | None]) -> None:
        store, top, names = _log(self.path)
        files = [f for m in messages if m for f in m.files]
        old = [f for name in names for f in _entry(store, top, name)] if self.overwrite else []
        store.create_dir(f"{top}/log", recursive=True)
        name = f"{(int(names[-1][:-5]) + 1 if names else 0):020d}.json"
        with store.open_output_stream(draft := f"{top}/log/{name}.{self.job}") as f:
            f.write(json.dumps({"files": files}).encode())
        for entry in names if self.overwrite else []:
            store.delete_file(f"{top}/log/{entry}")
        store.move(draft, f"{top}/log/{name}")
        for f in old:
            store.delete_file(f"{top}/data/{f['file']}")

    def abort(self, messages: list[Written | None]) -> None:
        """Also what tasks left that never came to their end: all files of this job."""
        store, top = stores.place(self.path)
        for f in store.get_file_info(fs.FileSelector(f"{top}/data", allow_not_found=True)):
            if f.base_name.startswith(self.job):
                store.delete_file(f.path)


class Samples(DataSource):
    """Option ``path``: the store's folder, under any name by which Spark knows it."""

    @classmethod
    def name(cls) -> str:
        return "callgrain_samples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"], schema.names)
