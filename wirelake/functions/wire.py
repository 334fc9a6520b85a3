"""Wire primitives as Column expressions. Longs stand for unsigned 64-bit numbers by their bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def varint_size(c) -> Column:
    """Bytes of a number's varint, 1 to 10; negative numbers take 10."""
    v = _long(c)
    out = F.when(v < 0, 10)
    for k in range(1, 9):
        out = out.when(v < (1 << (7 * k)), k)
    return out.when(v.isNotNull(), 9)


def varint(c) -> Column:
    """The varint of a number as binary."""
    v = _long(c)
    size = varint_size(v)
    parts = []
    for k in range(10):
        group = F.shiftrightunsigned(v, 7 * k).bitwiseAND(F.lit(0x7F)) if k else v.bitwiseAND(F.lit(0x7F))
        byte = F.when(size > k + 1, group.bitwiseOR(F.lit(0x80))).otherwise(group)
        parts.append(F.when(size > k, F.lpad(F.hex(byte), 2, "0")).otherwise(F.lit("")))
    return F.when(v.isNotNull(), F.unhex(F.concat(*parts)))


def zigzag64(c) -> Column:
    v = _long(c)
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag64(c) -> Column:
    v = _long(c)
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1).cast("long"))))


def zigzag32(c) -> Column:
    """As a long between 0 and 2**32 - 1."""
    return zigzag64(c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def unzigzag32(c) -> Column:
    return unzigzag64(_long(c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).cast("int")


def tag(number: int, wire_type: int) -> Column:
    if not 1 <= number < 1 << 29 or not 0 <= wire_type <= 5:
        raise ValueError(f"no such tag: {number}, {wire_type}")
    return varint(F.lit(number << 3 | wire_type))


def tag_field_number(c) -> Column:
    return F.shiftrightunsigned(_long(c), 3)


def tag_wire_type(c) -> Column:
    """Ends the query where the type is 6 or 7."""
    kind = _long(c).bitwiseAND(F.lit(7).cast("long"))
    return F.when(kind > 5, F.raise_error(F.concat(F.lit("INVALID_WIRE_TYPE: "), kind.cast("string"))).cast("long")).otherwise(kind)


def _little_endian(v: Column, digits: int) -> Column:
    text = F.lpad(F.hex(v), 16, "0")
    return F.when(v.isNotNull(), F.unhex(F.concat(*[F.substring(text, 16 - 2 * k - 1, 2) for k in range(digits)])))


def fixed32(c) -> Column:
    """Four bytes, the lowest first."""
    return _little_endian(_long(c), 4)


def fixed64(c) -> Column:
    return _little_endian(_long(c), 8)


def length_delimited(c) -> Column:
    """Bytes after the varint of their number."""
    b = (F.col(c) if isinstance(c, str) else c).cast("binary")
    # Bound to a variable, so nested messages don't repeat what is within them for every byte of their length.
    return F.element_at(F.transform(F.array(b), lambda x: F.concat(varint(F.octet_length(x)), x)), 1)


def varint_field(number: int, c) -> Column:
    return F.concat(tag(number, 0), varint(c))


def string_field(number: int, c) -> Column:
    """A string or bytes field: tag, length, bytes."""
    return F.concat(tag(number, 2), length_delimited(c))


def fixed_field(number: int, c, bits: int) -> Column:
    return F.concat(tag(number, 5 if bits == 32 else 1), fixed32(c) if bits == 32 else fixed64(c))


def count_varints(c) -> Column:
    """How many varints a packed payload has: its bytes below 0x80."""
    b = F.col(c) if isinstance(c, str) else c
    return F.regexp_count(F.regexp_replace(F.hex(b), "(..)", "$1 "), F.lit("[0-7][0-9A-F] "))


def is_default(c, kind: str) -> Column:
    """Whether a value is its type's default, bit for bit: -0.0 isn't."""
    v = F.col(c) if isinstance(c, str) else c
    if kind in ("float", "double"):
        return v.cast("string") == "0.0"
    if kind == "bool":
        return ~v
    return F.octet_length(v) == 0 if kind in ("string", "bytes") else v == 0
