"""The data source "delimited": messages, each after the varint of its length.

``spark.read.format("delimited").load(path)`` gives path, position and payload; decode the payload with the operators.
Such files can't be split, so a task reads whole files, in pieces of bounded size. As a stream, the offset is a
position in every file: a record that is cut off at the end of a growing file waits for the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schema.wire import DecodeError, varint
from .files import file_system

SCHEMA = "path string, position long, payload binary"
_PIECE = 8 << 20


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder whose names begin with neither a dot nor an underscore, by name."""
    where, base = file_system(path)
    info = where.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [(base, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = where.get_file_info(pafs.FileSelector(base, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def read_records(where, path: str, start: int, end: int, limit: int) -> Iterator[tuple[int, bytes]]:
    """(position, payload) of the records from ``start`` to ``end``; one that is cut off there is an error."""
    with where.open_input_file(path) as f:
        held, base, at = b"", start, 0
        while True:
            head = held[at : at + 10]
            size = shift = used = 0
            done = False
            for b in head:
                size |= (b & 0x7F) << shift
                used += 1
                if b < 0x80:
                    done = True
                    break
                shift += 7
            if used == 10 and head[9] > 1:
                raise DecodeError("VARINT_TOO_LONG", f"{path} at {base + at}")
            if done and size > limit:
                raise DecodeError("MESSAGE_TOO_LARGE", f"{path} at {base + at}: {size}")
            if not done and used == 10:
                raise DecodeError("VARINT_TOO_LONG", f"{path} at {base + at}")
            if done and at + used + size <= len(held):
                yield base + at, held[at + used : at + used + size]
                at += used + size
                continue
            base, held, at = base + at, held[at:], 0
            got = base + len(held)
            want = min(end - got, max(_PIECE, used + size - len(held) if done else 10))
            more = f.read_at(want, got) if want > 0 else b""
            if not more:
                if held:
                    raise DecodeError("UNEXPECTED_EOF", f"{path} at {base}")
                return
            held += more


class _File(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.limit = path, int(options.get("maxMessageSize", (1 << 31) - 1))
        self.target = int(options.get("filesPerPartitionBytes", 128 << 20))

    def partitions(self):
        groups, now, size = [], [], 0
        for f in list_files(self.path):
            if now and size + f[1] > self.target:
                groups.append(_File(now))
                now, size = [], 0
            now.append(f)
            size += f[1]
        if now:
            groups.append(_File(now))
        return groups or [_File([])]

    def read(self, partition):
        where, _ = file_system(self.path)
        for path, size in partition.files:
            yield from _batches(where, path, 0, size, self.limit)


def _batches(where, path: str, start: int, end: int, limit: int):
    places, payloads, held = [], [], 0
    for at, payload in read_records(where, path, start, end, limit):
        places.append(at)
        payloads.append(payload)
        held += len(payload)
        if held > _PIECE or len(places) >= 50_000:
            yield _batch(path, places, payloads)
            places, payloads, held = [], [], 0
    if places:
        yield _batch(path, places, payloads)


def _batch(path, places, payloads):
    return pa.RecordBatch.from_arrays([pa.array([path] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(payloads, pa.binary())], names=["path", "position", "payload"])


class _Done(WriterCommitMessage):
    def __init__(self, path: str, records: int):
        self.path, self.records = path, records


class _Writer(DataSourceWriter):
    """A file per task under a name of its own; commit gives the files of finished tasks their final names."""

    def __init__(self, path: str, overwrite: bool, column: str):
        self.path, self.overwrite, self.column = path, overwrite, column

    def write(self, iterator):
        import uuid

        where, base = file_system(self.path)
        where.create_dir(base, recursive=True)
        name = f"{base}/.part-{uuid.uuid4().hex}.pb"
        n = 0
        with where.open_output_stream(name) as f:
            for row in iterator:
                payload = row[self.column]
                if payload is not None:
                    payload = bytes(payload)
                    f.write(varint(len(payload)) + payload)
                    n += 1
        return _Done(name, n)

    def commit(self, messages):
        where, base = file_system(self.path)
        if self.overwrite:
            for path, _ in list_files(self.path):
                where.delete_file(path)
        for m in messages:
            if m is not None:
                folder, _, name = m.path.rpartition("/")
                where.move(m.path, f"{folder}/{name[1:]}")

    def abort(self, messages):
        where, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(m.path)


def last_boundary(file, at: int, size: int, limit: int) -> int:
    """Where the last whole record before ``size`` ends, from a boundary on. Only lengths are looked at: bytes of long records are not read."""
    block, base = b"", at
    while at < size:
        if at + 10 > base + len(block) and base + len(block) < size or at > base + len(block):
            block, base = file.read_at(min(_PIECE >> 3, size - at), at), at
        n = shift = used = 0
        for c in block[at - base : at - base + 10]:
            n |= (c & 0x7F) << shift
            used += 1
            if c < 0x80:
                break
            shift += 7
        else:
            if used == 10:
                raise DecodeError("VARINT_TOO_LONG", f"record at {at}")
            break
        if n > limit:
            raise DecodeError("MESSAGE_TOO_LARGE", f"record at {at}: {n}")
        if at + used + n > size:
            break
        at += used + n
    return at


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Stream(DataSourceStreamReader):
    """Offsets are the ends of whole records by file. The driver walks lengths; payloads are read by tasks, a file's new records by one."""

    def __init__(self, path: str, options: dict):
        self.path, self.limit, self.known = path, int(options.get("maxMessageSize", (1 << 31) - 1)), {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        where, _ = file_system(self.path)
        for path, size in list_files(self.path):
            at = self.known.get(path, 0)
            if size > at:
                with where.open_input_file(path) as f:
                    self.known[path] = last_boundary(f, at, size, self.limit)
        return dict(self.known)

    def partitions(self, start, end):
        return [_Range(path, start.get(path, 0), end[path]) for path in sorted(end) if end[path] > start.get(path, 0)]

    def read(self, partition):
        where, _ = file_system(self.path)
        yield from _batches(where, partition.path, partition.start, partition.end, self.limit)

    def commit(self, end):
        pass

    def stop(self):
        pass


class DelimitedSource(DataSource):
    """Options: path; maxMessageSize; filesPerPartitionBytes (batch); column, the one to write (payload)."""

    @classmethod
    def name(cls):
        return "delimited"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite, self.options.get("column", "payload"))

    def streamReader(self, schema):
        return _Stream(self.options["path"], dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(DelimitedSource)
