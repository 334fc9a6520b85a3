"""Token ids in files of fixed-width packed bits.

A file holds the ids of documents in ascending key order, each id in as many bits as the vocabulary needs,
most significant bit first, in blocks of 4,096 ids. After the blocks come the byte offset and CRC-32 of every
block and, per document, its key and its first id's place, so a reader can take any run of ids or any
document by reading the blocks that hold it. All numbers are little-endian.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.sources.files import file_system

from ._text import chunks, flat, trimmed
from .bpe import PieceCache, encode_flat

BLOCK_IDS = 4096
MAGIC = b"WLBITS01"
#: magic, bits, documents, documents without a key, ids, blocks, where the block index and the document index begin
_HEAD = struct.Struct("<8sIQQQQQQ")


def bits_for(vocabulary: int) -> int:
    """The least width that holds every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    digits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(digits[:, 32 - bits :]).tobytes()


def unpack(raw: bytes | np.ndarray, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f">u{bits // 8}", count).astype(np.uint32)
    digits = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * bits).reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = digits
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


class Writer:
    """Writes one file, a block at a time; at most a block of ids and the indexes are in memory."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.stream.write(bytes(_HEAD.size))
        self.at, self.ids, self.n_null = _HEAD.size, 0, 0
        self.rest = np.zeros(0, np.uint32)
        self.blocks: list[tuple[int, int]] = []
        self.keys: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []

    def add(self, keys: np.ndarray, n_null: int, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents in key order; the ``n_null`` first of them have no key."""
        self.keys.append(keys.astype("<i8"))
        self.n_null += n_null
        self.starts.append((self.ids + np.cumsum(counts) - counts).astype("<u8"))
        self.ids += len(ids)
        run = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(run) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            self._block(run[i : i + BLOCK_IDS])
        self.rest = run[whole:].copy()

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.blocks.append((self.at, zlib.crc32(raw)))
        self.stream.write(raw)
        self.at += len(raw)

    def close(self) -> bytes:
        """Ends the file; what it returns belongs at its beginning and, as streams can't go back, is also its end."""
        if len(self.rest):
            self._block(self.rest)
        index = self.at
        self.stream.write(b"".join(struct.pack("<QI", *b) for b in self.blocks))
        docs = index + 12 * len(self.blocks)
        n = sum(map(len, self.keys))
        for part in (*self.keys, *self.starts):
            self.stream.write(part.tobytes())
        head = _HEAD.pack(MAGIC, self.bits, n, self.n_null, self.ids, len(self.blocks), index, docs)
        self.stream.write(head)
        self.stream.close()
        return head


class Reader:
    """Random access to one file: ``ids(start, count)``, ``document(i)``, and all documents in turn."""

    def __init__(self, path: str):
        where, name = file_system(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        head = _HEAD.unpack(self.file.read_at(_HEAD.size, size - _HEAD.size))
        magic, self.bits, self.n_docs, self.n_null, self.n_ids, blocks, index, docs = head
        if magic != MAGIC:
            raise ValueError(f"not a file of packed ids: {path}")
        self.blocks = np.frombuffer(self.file.read_at(12 * blocks, index), np.dtype([("at", "<u8"), ("crc", "<u4")]))
        both = self.file.read_at(16 * self.n_docs, docs)
        self.keys = np.frombuffer(both, "<i8", self.n_docs)
        self.starts = np.frombuffer(both, "<u8", self.n_docs, 8 * self.n_docs).astype(np.int64)
        self.ends = np.append(self.starts[1:], self.n_ids) if self.n_docs else self.starts

    def ids(self, start: int, count: int) -> np.ndarray:
        if start < 0 or count < 0 or start + count > self.n_ids:
            raise IndexError("no such ids")
        if not count:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK_IDS, (start + count - 1) // BLOCK_IDS
        parts = []
        for b in range(first, last + 1):
            n = min(BLOCK_IDS, self.n_ids - b * BLOCK_IDS)
            raw = self.file.read_at((n * self.bits + 7) // 8, int(self.blocks["at"][b]))
            if zlib.crc32(raw) != self.blocks["crc"][b]:
                raise ValueError(f"block {b} has another checksum")
            parts.append(unpack(raw, self.bits, n))
        run = np.concatenate(parts)
        return run[start - first * BLOCK_IDS :][:count]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.ends[i] - self.starts[i]))

    def groups(self, about: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, document after the last, their ids), of about so many ids at a time; a longer document stands alone."""
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + about, "right")))
            yield i, j, self.ids(int(self.starts[i]), int(self.ends[j - 1] - self.starts[i]))
            i = j


_caches: dict[str, PieceCache] = {}


def library_cache(path: str) -> PieceCache:
    """Pieces as the tokenizers library encodes them; it sees each new piece once. Texts are cut at added tokens before, so no piece holds one."""
    if path not in _caches:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def merge(pieces: list[bytes]) -> list[np.ndarray]:
            made = tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
            return [np.array(e.ids, np.int64) for e in made]

        _caches[path] = PieceCache(merge)
    return _caches[path]


@functools.lru_cache(maxsize=4)
def added_tokens(path: str) -> tuple[re.Pattern | None, dict[bytes, int]]:
    """A pattern for the literals of the file's added tokens, of those that begin together the longest first, and their ids."""
    with open(path, "rb") as f:
        added = json.load(f).get("added_tokens") or []
    for t in added:
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized"):
            raise ValueError(f"an added token that is more than its literal: {t['content']}")
    ids = {t["content"].encode(): t["id"] for t in added if t["content"]}
    return (re.compile(b"|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None), ids


def encoded_with_added(column: pa.Array, cache: PieceCache, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As ``encoded_chunks``, with every literal of an added token as its id; what is left and right of one is encoded on its own."""
    pattern, added = added_tokens(path)
    data, offsets = flat(column)
    for i, j in chunks(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        found = [] if pattern is None else [(m.start(), m.end(), added[m[0]]) for m in pattern.finditer(part)]
        if found:  # not those that reach from one text into the next
            text = np.searchsorted(own, [a for a, _, _ in found], "right")
            if any(b > own[k] for (_, b, _), k in zip(found, text)):
                found = [(a + m.start(), a + m.end(), added[m[0]]) for a, b in zip(own[:-1], own[1:]) for m in pattern.finditer(part[a:b])]
        if not found:
            ids, at = encode_flat(part, own, cache)
            yield i, j, ids, at
            continue
        spans = np.array(found)
        cuts = np.sort(np.concatenate([own, spans[:, 0], spans[:, 1]]))  # places twice are empty slices
        literal = np.searchsorted(spans[:, 0], cuts[:-1], "right") - 1
        inside = (literal >= 0) & (cuts[:-1] == spans[literal, 0]) & (cuts[1:] > cuts[:-1])
        sizes, made = np.diff(cuts), []
        keep = np.repeat(~inside, sizes)
        bare = np.concatenate([[0], np.cumsum(np.where(inside, 0, sizes))])
        if len(own) == 2:  # slices of a text that may be long, each of which may go in pieces
            made = [encode_flat(part[a:b], np.array([0, b - a]), cache)[0] for a, b in zip(cuts[:-1][~inside], cuts[1:][~inside])]
            counts = np.zeros(len(sizes), np.int64)
            counts[~inside] = [len(x) for x in made]
            rest = np.concatenate(made)
        else:
            rest, at = encode_flat(part[keep], bare, cache)
            counts = np.diff(at)
        counts = np.where(inside, 1, counts)
        at = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(at[-1], np.int64)
        hole = np.zeros(len(ids), bool)
        hole[at[:-1][inside]] = True
        ids[hole], ids[~hole] = spans[literal[inside], 2], rest
        yield i, j, ids, at[np.searchsorted(cuts, own)]


def write_files(df: DataFrame, folder: str, tokenizer_path: str, vocabulary: int, end_id: int, text: str = "text", key: str = "doc_id") -> list[dict]:
    """Encodes all texts, ends each with ``end_id`` and writes files in ascending key order, rows without a key first, rows with one key by text.

    Returns the manifest, which is also written as manifest.json: per file, in order, path, documents, ids and the number of ids in all
    files before it. A file's name holds its task attempt, and only files that a finished attempt returned are in the manifest, so
    attempts that were lost or ran twice do no harm. The driver gets one row per file. A null text is empty: only the end id.
    """
    bits = bits_for(vocabulary)
    ordered = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange(F.asc_nulls_first("key")).sortWithinPartitions(F.asc_nulls_first("key"), F.asc_nulls_first("text"))

    def run(batches):
        task = TaskContext.get()
        where, base = file_system(folder)
        path = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bits"
        cache, writer, n = library_cache(tokenizer_path), None, 0
        for batch in batches:
            if writer is None:
                where.create_dir(base, recursive=True)
                writer = Writer(where.open_output_stream(f"{base}/{path}"), bits)
            keys = batch.column(0)
            for i, j, ids, at in encoded_with_added(batch.column(1), cache, tokenizer_path):
                part = keys.slice(i, j - i)
                counts = np.diff(at) + 1
                ends = np.cumsum(counts) - 1
                run_ = np.empty(len(ids) + (j - i), np.uint32)
                hole = np.ones(len(run_), bool)
                hole[ends] = False
                run_[hole] = ids
                run_[ends] = end_id
                writer.add(part.fill_null(0).to_numpy(zero_copy_only=False), part.null_count, run_, counts)
                n += j - i
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([path]), pa.array([n], pa.int64()), pa.array([writer.ids], pa.int64())], names=["part", "path", "documents", "ids"])

    rows = sorted(ordered.mapInArrow(trimmed(run), "part long, path string, documents long, ids long").collect())
    manifest, start = [], 0
    for row in rows:
        manifest.append({"path": f"{folder}/{row.path}", "documents": row.documents, "ids": row.ids, "start": start})
        start += row.ids
    where, base = file_system(folder)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"bits": bits, "end_id": end_id, "files": manifest}).encode())
    return manifest


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_files(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, as unpacked from them; one task per file."""

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(path)
                null = pa.array(np.arange(reader.n_docs) < reader.n_null)
                keys = pa.array(reader.keys, pa.int64(), mask=null.to_numpy(zero_copy_only=False)) if reader.n_docs else pa.array([], pa.int64())
                for i, j, ids in reader.groups():
                    raw = memoryview(ids.astype("<u4"))
                    first = int(reader.starts[i])
                    cuts = [*(reader.starts[i:j] - first).tolist(), int(reader.ends[j - 1]) - first]
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
                    yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.array(reader.starts[i:j] + base, pa.int64()), pa.array(reader.ends[i:j] - reader.starts[i:j], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")
    return files.repartition(max(1, len(manifest))).mapInArrow(trimmed(run), READ_SCHEMA)
