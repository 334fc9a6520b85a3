"""Binary media columns: 8-bit greyscale PNG written and read chunk by chunk, and perceptual hashes.

Writing picks a filter for every row; reading tests every checksum, inflates, and undoes filters with
whole-array operations. The hash comes from the lowest frequencies of an integer cosine transform of
the picture averaged down to 32 x 32, so equal pixels give equal hashes on any machine.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._text import chunks, flat, trimmed

SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
WIDTH = 64
_IDAT = 1 << 20


class BadPng(ValueError):
    """The bytes are no PNG of the kind that is read here, or a checksum doesn't hold."""


# ---------------------------------------------------------------- writing


def filter_rows(pixels: np.ndarray) -> np.ndarray:
    """Each row with its filter byte before it. The filter is none, sub or up: the one whose bytes, as signed numbers, sum to least in size; of equals the first."""
    h, w = pixels.shape
    made = np.empty((3, h, w), np.uint8)
    made[0] = pixels
    made[1] = pixels
    made[1, :, 1:] -= pixels[:, :-1]
    made[2] = pixels
    made[2, 1:] -= pixels[:-1]
    cost = np.minimum(made, -made).sum(2, dtype=np.int64)
    kind = cost.argmin(0)
    out = np.empty((h, w + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = made[kind, np.arange(h)]
    return out


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit greyscale PNG of a (height, width) array, both at least 1."""
    h, w = pixels.shape
    body = zlib.compress(filter_rows(pixels).tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", body[i : i + _IDAT]) for i in range(0, len(body), _IDAT)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


# ---------------------------------------------------------------- reading


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pixels of filtered rows. None, sub and up are undone by running sums over the whole picture at once;
    from the first row on that has another filter the rest goes row by row."""
    slow = np.flatnonzero(kinds > UP)
    n = int(slow[0]) if len(slow) else len(kinds)
    head, k = rows[:n].copy(), kinds[:n]
    sub = k == SUB
    if sub.any():
        head[sub] = np.cumsum(head[sub], 1, dtype=np.uint8)
    up = k == UP
    if up.any():
        sums = np.cumsum(head, 0, dtype=np.uint8)
        base = np.maximum.accumulate(np.where(up, -1, np.arange(n)))  # the row that a run of ups begins from
        from_top = (base < 0)[:, None]
        base = np.maximum(base, 0)
        head = np.where(up[:, None], np.where(from_top, sums, head[base] + (sums - sums[base])), head)
    out = np.empty_like(rows)
    out[:n] = head
    width = rows.shape[1]
    for y in range(n, len(kinds)):
        above = out[y - 1] if y else np.zeros(width, np.uint8)
        kind, row = int(kinds[y]), rows[y]
        if kind == NONE:
            out[y] = row
        elif kind == SUB:
            out[y] = np.cumsum(row, dtype=np.uint8)
        elif kind == UP:
            out[y] = row + above
        else:
            a = c = 0
            line = []
            for x, (value, b) in enumerate(zip(row.tolist(), above.tolist())):
                if kind == AVERAGE:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    pa_, pb, pc_ = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa_ <= pb and pa_ <= pc_ else b if pb <= pc_ else c
                a, c = (value + guess) & 255, b
                line.append(a)
            out[y] = line
    return out


def read_png(png: bytes) -> np.ndarray:
    """Pixels of an 8-bit greyscale PNG without interlacing. BadPng where the signature, a length, an order, a checksum or a filter is wrong."""
    if png[:8] != SIGNATURE:
        raise BadPng("no PNG signature")
    at, header, data, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(png):
            raise BadPng("a chunk is cut off")
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if at + 12 + n > len(png):
            raise BadPng("a chunk is cut off")
        if struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise BadPng(f"checksum of {kind.decode('latin-1')}")
        at += 12 + n
        if header is None and kind != b"IHDR":
            raise BadPng("no header first")
        if kind == b"IHDR":
            if header is not None or n != 13:
                raise BadPng("header")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 0x20:
            raise BadPng(f"unknown critical chunk {kind.decode('latin-1')}")
    w, h, depth, colour, compression, filters, interlace = header
    if (depth, colour, compression, filters, interlace) != (8, 0, 0, 0, 0) or not w or not h:
        raise BadPng("only 8-bit greyscale without interlacing is read")
    inflate = zlib.decompressobj()
    try:
        raw = b"".join([inflate.decompress(x) for x in data]) + inflate.flush()
    except zlib.error as e:
        raise BadPng(str(e)) from None
    if not inflate.eof or len(raw) != h * (w + 1):
        raise BadPng("pixel data of another length")
    lines = np.frombuffer(raw, np.uint8).reshape(h, w + 1)
    if lines[:, 0].max() > PAETH:
        raise BadPng("unknown filter")
    return unfilter(lines[:, 0], lines[:, 1:])


# ---------------------------------------------------------------- hashes

_SIDE, _LOW = 32, 8
_COS = np.round(np.cos(np.pi * np.arange(_LOW)[:, None] * (2 * np.arange(_SIDE)[None] + 1) / (2 * _SIDE)) * (1 << 14)).astype(np.int64)


def _averaged(pixels: np.ndarray, axis: int) -> np.ndarray:
    """Means along an axis over 32 equal stretches, in 1/256; a short axis repeats its entries."""
    n = pixels.shape[axis]
    if n < _SIDE:
        return np.take(pixels, np.arange(_SIDE) * n // _SIDE, axis).astype(np.int64) << 8
    cuts = np.arange(_SIDE + 1) * n // _SIDE
    sums = np.add.reduceat(pixels, cuts[:-1], axis, dtype=np.int64)
    counts = np.diff(cuts)
    return (sums << 8) // (counts[:, None] if axis == 0 else counts[None, :])


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies exceed the median of those other than the mean."""
    small = _averaged(_averaged(pixels, 0), 1)
    low = _COS @ small @ _COS.T
    flat_ = low.ravel()
    ranked = np.sort(flat_[1:])
    bits = flat_ > ranked[len(ranked) // 2]
    return np.packbits(bits).tobytes().hex()


# ---------------------------------------------------------------- DataFrame operators


def pixels_of(payload: np.ndarray) -> np.ndarray:
    """Bytes, and zeros up to a positive multiple of 64, as rows of 64 pixels."""
    rows = max(1, -(-len(payload) // WIDTH))
    out = np.zeros(rows * WIDTH, np.uint8)
    out[: len(payload)] = payload
    return out.reshape(rows, WIDTH)


def to_media(df: DataFrame, text: str = "text", out: str = "media", level: int = 6) -> DataFrame:
    """Adds a binary column of PNGs that hold the UTF-8 bytes of ``text``, padded with zeros to a positive multiple of 64.

    A null or empty text is 64 zeros. Columns pass unchanged, but one already called ``out`` is replaced. No shuffle.
    """
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField(out, T.BinaryType())])

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(batch.schema.get_field_index(text)))
            others = batch.select(names)
            for i, j in chunks(offsets):
                made = [write_png(pixels_of(data[offsets[k] : offsets[k + 1]]), level) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in others.columns] + [pa.array(made, pa.binary())], names=[*names, out])

    return df.mapInArrow(trimmed(run), schema)


FEATURE_FIELDS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Reads PNGs back. Per row, besides the columns to keep: length, SHA-256 and the CRC-32 of the last 64 of
    the payload bytes, length and SHA-256 of the stored form, and the cosine hash. A null medium gives nulls; a
    broken one ends the query with BadPng."""
    named = {f.name: f for f in df.schema.fields}
    schema = T.StructType([named[k] for k in keep] + T.StructType.fromDDL(FEATURE_FIELDS).fields)

    def features(png):
        if png is None:
            return (None,) * 6
        pixels = read_png(png)
        raw = pixels.tobytes()
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(pixels)

    def run(batches):
        for batch in batches:
            rows = [features(x.as_py()) for x in batch.column(batch.schema.get_field_index(media))]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(k)) for k in keep] + [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=schema.names
            )

    return df.select(*keep, media).mapInArrow(trimmed(run), schema)
