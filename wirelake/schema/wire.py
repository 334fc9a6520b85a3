"""Row-level wire primitives: varints, zigzag, tags, records. The columnar codec is in kernels/columnar.py."""

from __future__ import annotations

import struct

VARINT, FIXED64, BYTES, GROUP, END_GROUP, FIXED32 = range(6)
MASK64 = (1 << 64) - 1
MAX_FIELD = (1 << 29) - 1


class DecodeError(ValueError):
    """A payload breaks the wire format or a limit; ``code`` says how."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


class EncodeError(ValueError):
    """A value has no encoding in its field."""


def read_varint(buf, at: int, end: int) -> tuple[int, int]:
    """The value and the place after it. The tenth byte may only be 0 or 1."""
    value = shift = 0
    while True:
        if at >= end:
            raise DecodeError("UNEXPECTED_EOF", "varint")
        b = buf[at]
        at += 1
        if shift == 63 and b > 1:
            raise DecodeError("VARINT_TOO_LONG")
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def varint(value: int) -> bytes:
    value &= MASK64
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def zigzag(value: int) -> int:
    return ((value << 1) ^ (value >> 63)) & MASK64


def unzigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def signed(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


def read_tag(buf, at: int, end: int) -> tuple[int, int, int]:
    tag, at = read_varint(buf, at, end)
    if tag >> 32:
        raise DecodeError("INVALID_TAG", str(tag))
    number, kind = tag >> 3, tag & 7
    if not number:
        raise DecodeError("INVALID_FIELD_NUMBER")
    if kind > FIXED32:
        raise DecodeError("INVALID_WIRE_TYPE", str(kind))
    return number, kind, at


def read_value(buf, at: int, end: int, number: int, kind: int, depth: int):
    """The raw value of a field: an integer, or the bytes of a delimited field or of a group's body."""
    if kind == VARINT:
        return read_varint(buf, at, end)
    if kind in (FIXED64, FIXED32):
        n = 8 if kind == FIXED64 else 4
        if at + n > end:
            raise DecodeError("UNEXPECTED_EOF", "fixed")
        return int.from_bytes(buf[at : at + n], "little"), at + n
    if kind == BYTES:
        n, at = read_varint(buf, at, end)
        if n > end - at:
            raise DecodeError("UNEXPECTED_EOF", "length-delimited")
        return bytes(buf[at : at + n]), at + n
    if kind == GROUP:
        stop, after = skip_group(buf, at, end, number, depth)
        return bytes(buf[at:stop]), after
    raise DecodeError("UNEXPECTED_END_GROUP", str(number))


def skip_group(buf, at: int, end: int, number: int, depth: int) -> tuple[int, int]:
    """Where the body of a group that began before ``at`` ends, and the place after its end tag."""
    if depth <= 0:
        raise DecodeError("RECURSION_LIMIT")
    while True:
        if at >= end:
            raise DecodeError("UNEXPECTED_EOF", "group")
        start = at
        inner, kind, at = read_tag(buf, at, end)
        if kind == END_GROUP:
            if inner != number:
                raise DecodeError("UNEXPECTED_END_GROUP", str(inner))
            return start, at
        if kind == GROUP:
            _, at = skip_group(buf, at, end, inner, depth - 1)
        else:
            _, at = read_value(buf, at, end, inner, kind, depth)


def records(buf: bytes, depth: int = 100) -> list[tuple[int, int, object]]:
    """All (number, wire type, raw value) of a message."""
    out, at, end = [], 0, len(buf)
    while at < end:
        number, kind, at = read_tag(buf, at, end)
        value, at = read_value(buf, at, end, number, kind, depth)
        out.append((number, kind, value))
    return out


def record_bytes(number: int, kind: int, value) -> bytes:
    tag = varint(number << 3 | kind)
    if kind == VARINT:
        return tag + varint(value)
    if kind == FIXED32:
        return tag + struct.pack("<I", value)
    if kind == FIXED64:
        return tag + struct.pack("<Q", value)
    if kind == GROUP:
        return tag + value + varint(number << 3 | END_GROUP)
    return tag + varint(len(value)) + value
