"""Row-level dynamic messages: decode, merge, encode, presence, unknown fields, extensions, Any.

This codec covers everything, recursion included; JSON, text and YAML are built on it. The columnar codec
does the common work on whole batches and gives the same values.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from ..schema import descriptors as D
from ..schema.pool import Pool
from ..schema.wire import BYTES, END_GROUP, FIXED32, FIXED64, GROUP, VARINT, DecodeError, EncodeError, read_tag, read_value, read_varint, record_bytes, signed, unzigzag, varint, zigzag

WIRE = {
    D.DOUBLE: FIXED64, D.FLOAT: FIXED32, D.INT64: VARINT, D.UINT64: VARINT, D.INT32: VARINT, D.FIXED64: FIXED64, D.FIXED32: FIXED32, D.BOOL: VARINT, D.STRING: BYTES,
    D.BYTES: BYTES, D.UINT32: VARINT, D.ENUM: VARINT, D.SFIXED32: FIXED32, D.SFIXED64: FIXED64, D.SINT32: VARINT, D.SINT64: VARINT, D.MESSAGE: BYTES, D.GROUP: GROUP,
}
DEFAULTS = {D.BOOL: False, D.STRING: "", D.BYTES: b"", D.FLOAT: 0.0, D.DOUBLE: 0.0}
RANGES = {
    D.INT32: (-(1 << 31), (1 << 31) - 1), D.SINT32: (-(1 << 31), (1 << 31) - 1), D.SFIXED32: (-(1 << 31), (1 << 31) - 1), D.ENUM: (-(1 << 31), (1 << 31) - 1), D.UINT32: (0, (1 << 32) - 1), D.FIXED32: (0, (1 << 32) - 1),
    D.INT64: (-(1 << 63), (1 << 63) - 1), D.SINT64: (-(1 << 63), (1 << 63) - 1), D.SFIXED64: (-(1 << 63), (1 << 63) - 1), D.UINT64: (0, (1 << 64) - 1), D.FIXED64: (0, (1 << 64) - 1),
}


@dataclass(frozen=True)
class Options:
    """Limits and choices of one decode. strict_wire_type: a known field of another wire type is an error, not an unknown field."""

    recursion_limit: int = 100
    unknown_field_limit: int = 1_000_000
    element_memory_limit: int = 32 << 20
    max_message_size: int = (1 << 31) - 1
    keep_unknown: bool = True
    strict_wire_type: bool = False
    message_set: bool = False
    utf8_as_bytes: bool = False


DEFAULT = Options()
#: What one element of a repeated field is taken to need beside its payload.
_ELEMENT = 24


class Context:
    """What one top-level decode has used up."""

    def __init__(self, options: Options):
        self.options, self.unknown, self.memory = options, 0, 0

    def count_unknown(self) -> None:
        self.unknown += 1
        if self.unknown > self.options.unknown_field_limit:
            raise DecodeError("UNKNOWN_FIELD_LIMIT")

    def count_element(self, size: int) -> None:
        self.memory += _ELEMENT + size
        if self.memory > self.options.element_memory_limit:
            raise DecodeError("ELEMENT_MEMORY_LIMIT")


class Message:
    """Set fields by number, and unknown fields as (number, wire type, raw value) in wire order."""

    __slots__ = ("pool", "desc", "fields", "unknown")

    def __init__(self, pool: Pool, desc: D.MessageDesc):
        self.pool, self.desc, self.fields, self.unknown = pool, desc, {}, []

    def __eq__(self, other) -> bool:
        return isinstance(other, Message) and self.desc.full_name == other.desc.full_name and _bits(self.fields) == _bits(other.fields) and self.unknown == other.unknown

    __hash__ = None

    def __repr__(self) -> str:
        return f"{self.desc.full_name}({self.to_dict()!r})"

    # -------------------------------------------------------- access

    def _field(self, f) -> D.FieldDesc:
        if isinstance(f, D.FieldDesc):
            return f
        found = self.desc.by_number.get(f) if isinstance(f, int) else self.desc.field_named(f)
        if found is None and not isinstance(f, int) and f.startswith("["):
            found = self.pool.extension(f)
        if found is None:
            raise KeyError(f"{self.desc.full_name} has no field {f}")
        return found

    def has(self, f) -> bool:
        """Lists and maps: not empty. Implicit presence: not the default, bit for bit. Else: set."""
        f = self._field(f)
        return f.number in self.fields if f.extendee == "" or f.number in self.fields else any(n == f.number for n, _, _ in self.unknown)

    def get(self, f):
        """The value, or the default of an unset field; an unset message is an empty one."""
        f = self._field(f)
        if f.number in self.fields:
            return self.fields[f.number]
        return self.default(f)

    def default(self, f: D.FieldDesc):
        if f.is_map:
            return {}
        if f.repeated:
            return []
        if f.is_message:
            return Message(self.pool, self.pool.messages[f.type_name])
        if f.default is not None:
            return f.default
        if f.type == D.ENUM:
            return self.pool.enums[f.type_name].default
        return DEFAULTS.get(f.type, 0)

    def set(self, f, value) -> None:
        """Sets a field after checking the value, or clears it: None, an empty list or map, the default of implicit presence."""
        f = self._field(f)
        if f.extendee and f.extendee != self.desc.full_name:
            raise EncodeError(f"{f.full_name} doesn't extend {self.desc.full_name}")
        if value is None or (f.repeated and not value):
            self.clear(f)
            return
        value = self._checked(f, value)
        if not f.repeated and not f.tracks_presence and not f.is_message and _bits(value) == _bits(DEFAULTS.get(f.type, 0)):
            self.clear(f)
            return
        self._clear_siblings(f)
        self.fields[f.number] = value

    def _checked(self, f: D.FieldDesc, value):
        if f.is_map:
            entry = self.pool.messages[f.type_name]
            return {self._one(entry.by_number[1], k): self._one(entry.by_number[2], v) for k, v in dict(value).items()}
        return [self._one(f, v) for v in value] if f.repeated else self._one(f, value)

    def _one(self, f: D.FieldDesc, value):
        if f.is_message:
            if isinstance(value, dict):
                value = Message.from_dict(self.pool, f.type_name, value)
            if not isinstance(value, Message) or value.desc.full_name != f.type_name:
                raise EncodeError(f"{f.full_name} takes a {f.type_name}")
            return value
        if f.type in RANGES:
            if isinstance(value, str) and f.type == D.ENUM:
                number = self.pool.enums[f.type_name].by_name.get(value)
                if number is None:
                    raise EncodeError(f"{f.type_name} has no value {value}")
                return number
            low, high = RANGES[f.type]
            if isinstance(value, bool) or int(value) != value or not low <= value <= high:
                raise EncodeError(f"{f.full_name} can't hold {value!r}")
            return int(value)
        if f.type == D.BOOL:
            return bool(value)
        if f.type == D.STRING:
            if not isinstance(value, str):
                raise EncodeError(f"{f.full_name} takes a string")
            return value
        if f.type == D.BYTES:
            return bytes(value)
        return to_float32(float(value)) if f.type == D.FLOAT else float(value)

    def clear(self, f) -> None:
        f = self._field(f)
        self.fields.pop(f.number, None)
        if f.extendee:
            self.unknown = [u for u in self.unknown if u[0] != f.number]

    def _clear_siblings(self, f: D.FieldDesc) -> None:
        if f.oneof is not None and not f.extendee:
            for n in self.desc.oneofs[f.oneof].fields:
                if n != f.number:
                    self.fields.pop(n, None)

    def which_oneof(self, name: str) -> str | None:
        for o in self.desc.oneofs:
            if o.name == name:
                return next((self.desc.by_number[n].name for n in o.fields if n in self.fields), None)
        raise KeyError(f"{self.desc.full_name} has no oneof {name}")

    def set_fields(self):
        """(field, value) of all set fields by number, extensions that the pool knows included."""
        for n in sorted(self.fields):
            yield self.desc.by_number.get(n) or self.pool.extension_for(self.desc.full_name, n), self.fields[n]
        for n in sorted({u[0] for u in self.unknown}):
            x = self.pool.extension_for(self.desc.full_name, n)
            if x is not None and n not in self.fields:
                yield x, self.extension(x)

    def extension(self, x):
        """The value of an extension, read from the unknown fields; its default if unset."""
        x = self.pool.extension(x) if isinstance(x, str) else x
        if x.extendee != self.desc.full_name:
            raise KeyError(f"{x.full_name} doesn't extend {self.desc.full_name}")
        if x.number in self.fields:
            return self.fields[x.number]
        holder = Message(self.pool, self.desc)
        context = Context(DEFAULT)
        for n, kind, value in self.unknown:
            if n == x.number:
                holder._merge_value(x, kind, value, context, DEFAULT.recursion_limit)
        return holder.fields.get(x.number, self.default(x))

    def set_extension(self, x, value) -> None:
        x = self.pool.extension(x) if isinstance(x, str) else x
        self.unknown = [u for u in self.unknown if u[0] != x.number]
        self.set(x, value)

    # -------------------------------------------------------- decoding

    @staticmethod
    def decode(pool: Pool, name: str, raw: bytes, options: Options = DEFAULT) -> "Message":
        m = Message(pool, pool.message(name))
        m.merge(raw, options)
        return m

    def merge(self, raw: bytes, options: Options = DEFAULT) -> None:
        if len(raw) > options.max_message_size:
            raise DecodeError("MESSAGE_TOO_LARGE", str(len(raw)))
        self._merge(raw, Context(options), options.recursion_limit)

    def _merge(self, raw, context: Context, depth: int) -> None:
        at, end = 0, len(raw)
        while at < end:
            number, kind, at = read_tag(raw, at, end)
            if kind == END_GROUP:
                raise DecodeError("UNEXPECTED_END_GROUP", str(number))
            value, at = read_value(raw, at, end, number, kind, depth)
            f = self.desc.by_number.get(number)
            if self.desc.message_set and context.options.message_set and number == 1 and kind == GROUP:
                self._message_set_item(value, context)
            elif f is None or not self._merge_value(f, kind, value, context, depth):
                if f is not None and context.options.strict_wire_type and not (f.type == D.ENUM and kind in (VARINT, BYTES)):
                    raise DecodeError("WIRE_TYPE_MISMATCH", f.full_name)
                self._keep(number, kind, value, context)

    def _keep(self, number, kind, value, context) -> None:
        context.count_unknown()
        if context.options.keep_unknown:
            self.unknown.append((number, kind, value))

    def _message_set_item(self, body: bytes, context) -> None:
        """An item of a MessageSet becomes the extension field of its type id."""
        type_id, payload, at = None, b"", 0
        while at < len(body):
            number, kind, at = read_tag(body, at, len(body))
            value, at = read_value(body, at, len(body), number, kind, 100)
            if number == 2 and kind == VARINT:
                type_id = value
            elif number == 3 and kind == BYTES:
                payload += value
        if not type_id or type_id > 0x7FFFFFFF:
            raise DecodeError("INVALID_MESSAGE_SET")
        self._keep(type_id, BYTES, payload, context)

    def _merge_value(self, f: D.FieldDesc, kind: int, value, context: Context, depth: int) -> bool:
        """Merges one record of a known field; False if it belongs among the unknown fields."""
        if f.is_map:
            return kind == BYTES and self._merge_entry(f, value, context, depth)
        want = WIRE[f.type]
        if f.is_message:
            if kind not in (BYTES, GROUP):
                return False
            if depth <= 1:
                raise DecodeError("RECURSION_LIMIT")
            desc = self.pool.messages[f.type_name]
            if f.repeated:
                context.count_element(len(value))
                child = Message(self.pool, desc)
                child._merge(value, context, depth - 1)
                self.fields.setdefault(f.number, []).append(child)
                return True
            self._clear_siblings(f)
            child = self.fields.get(f.number)
            if child is None:
                child = self.fields[f.number] = Message(self.pool, desc)
            child._merge(value, context, depth - 1)
            return True
        if f.repeated and kind == BYTES and want != BYTES:
            at, end = 0, len(value)
            while at < end:
                one, at = read_value(value, at, end, f.number, want, depth)
                self._element(f, one, context, packed=True)
            return True
        if kind != want:
            return False
        if f.repeated:
            self._element(f, value, context)
            return True
        scalar = self._scalar(f, value)
        if f.type == D.ENUM and self._outside(f, scalar):
            return False
        self._clear_siblings(f)
        if not f.tracks_presence and _bits(scalar) == _bits(DEFAULTS.get(f.type, 0)):
            self.fields.pop(f.number, None)
        else:
            self.fields[f.number] = scalar
        return True

    def _outside(self, f: D.FieldDesc, number: int) -> bool:
        e = self.pool.enums[f.type_name]
        return e.closed and number not in e.by_number

    def _element(self, f, value, context, packed: bool = False) -> None:
        scalar = self._scalar(f, value)
        if f.type == D.ENUM and self._outside(f, scalar):
            self._keep(f.number, VARINT, value, context)
            return
        if not packed:
            context.count_element(len(value) if isinstance(value, bytes) else 0)
        self.fields.setdefault(f.number, []).append(scalar)

    def _scalar(self, f: D.FieldDesc, value):
        t = f.type
        if t == D.STRING:
            try:
                return value.decode()
            except UnicodeDecodeError:
                raise DecodeError("INVALID_UTF8", f.full_name) from None
        if t == D.BYTES:
            return value
        if t in (D.INT32, D.ENUM, D.SFIXED32):
            return signed(value, 32)
        if t in (D.INT64, D.SFIXED64):
            return signed(value, 64)
        if t == D.UINT32:
            return value & 0xFFFFFFFF
        if t == D.SINT32:
            return unzigzag(value & 0xFFFFFFFF)
        if t == D.SINT64:
            return unzigzag(value)
        if t == D.BOOL:
            return value != 0
        if t == D.FLOAT:
            return struct.unpack("<f", struct.pack("<I", value))[0]
        if t == D.DOUBLE:
            return struct.unpack("<d", struct.pack("<Q", value))[0]
        return value

    def _merge_entry(self, f: D.FieldDesc, raw: bytes, context: Context, depth: int) -> bool:
        """One map entry: missing parts are defaults; a key or value of another wire type is left out; a value message that comes twice is merged."""
        if depth <= 1:
            raise DecodeError("RECURSION_LIMIT")
        context.count_element(len(raw))
        desc = self.pool.messages[f.type_name]
        entry = Message(self.pool, desc)
        inner = Context(context.options)
        entry._merge(raw, inner, depth - 1)
        key_field, value_field = desc.by_number[1], desc.by_number[2]
        if value_field.type == D.ENUM and self.pool.enums[value_field.type_name].closed and 2 not in entry.fields and any(u[0] == 2 and u[1] == VARINT for u in entry.unknown):
            return False
        self.fields.setdefault(f.number, {})[entry.get(key_field)] = entry.get(value_field)
        return True

    # -------------------------------------------------------- encoding

    def encode(self) -> bytes:
        out = bytearray()
        for n in sorted(self.fields):
            f = self.desc.by_number.get(n) or self.pool.extension_for(self.desc.full_name, n)
            self._write(f, self.fields[n], out)
        for f in self.desc.fields:
            if f.presence == "required" and f.number not in self.fields:
                self._write(f, self.default(f), out)
        for u in self.unknown:
            if self.desc.message_set and u[1] == BYTES and self.desc.in_extension_range(u[0]):
                out += record_bytes(1, GROUP, record_bytes(2, VARINT, u[0]) + record_bytes(3, BYTES, u[2]))
            else:
                out += record_bytes(*u)
        return bytes(out)

    def _write(self, f: D.FieldDesc, value, out: bytearray) -> None:
        if f.is_map:
            entry = self.pool.messages[f.type_name]
            for k in sorted(value):
                pair = bytearray()
                self._write_one(entry.by_number[1], k, pair)
                self._write_one(entry.by_number[2], value[k], pair)
                out += record_bytes(f.number, BYTES, bytes(pair))
        elif f.repeated and f.packed:
            out += record_bytes(f.number, BYTES, b"".join(_payload(f, v) for v in value))
        elif f.repeated:
            for v in value:
                self._write_one(f, v, out)
        else:
            self._write_one(f, value, out)

    def _write_one(self, f: D.FieldDesc, value, out: bytearray) -> None:
        if f.is_message:
            body = value.encode()
            out += record_bytes(f.number, GROUP if f.delimited else BYTES, body)
        elif f.type == D.STRING:
            out += record_bytes(f.number, BYTES, value.encode())
        elif f.type == D.BYTES:
            out += record_bytes(f.number, BYTES, value)
        else:
            out += varint(f.number << 3 | WIRE[f.type]) + _payload(f, value)

    # -------------------------------------------------------- plain values

    def to_dict(self) -> dict:
        """Set fields by proto name; messages as dicts, enums as numbers."""

        def plain(v):
            if isinstance(v, Message):
                return v.to_dict()
            if isinstance(v, list):
                return [plain(x) for x in v]
            return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v

        out = {}
        for n, v in self.fields.items():
            f = self.desc.by_number.get(n)
            out[f.name if f else f"[{self.pool.extension_for(self.desc.full_name, n).full_name}]"] = plain(v)
        return out

    @staticmethod
    def from_dict(pool: Pool, name: str, values: dict) -> "Message":
        m = Message(pool, pool.message(name))
        for k, v in values.items():
            m.set(k, v)
        return m


def to_float32(x: float) -> float:
    try:
        return struct.unpack("<f", struct.pack("<f", x))[0]
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


def _payload(f: D.FieldDesc, v) -> bytes:
    t = f.type
    if t == D.DOUBLE:
        return struct.pack("<d", v)
    if t == D.FLOAT:
        return struct.pack("<f", v)
    if t in (D.FIXED32, D.SFIXED32):
        return struct.pack("<I", v & 0xFFFFFFFF)
    if t in (D.FIXED64, D.SFIXED64):
        return struct.pack("<Q", v & ((1 << 64) - 1))
    if t == D.SINT32:
        return varint(zigzag(v) & 0xFFFFFFFF)
    if t == D.SINT64:
        return varint(zigzag(v))
    return varint(int(v))


def _bits(v):
    """Values that compare bit for bit: floats by their bytes."""
    if isinstance(v, float):
        return struct.pack("<d", v)
    if isinstance(v, list):
        return [_bits(x) for x in v]
    if isinstance(v, dict):
        return {k: _bits(x) for k, x in v.items()}
    return v


def read_delimited(raw: bytes, at: int = 0, limit: int = (1 << 31) - 1) -> tuple[bytes, int]:
    """One message after its varint length, and the place after it."""
    n, at = read_varint(raw, at, len(raw))
    if n > limit:
        raise DecodeError("MESSAGE_TOO_LARGE", str(n))
    if at + n > len(raw):
        raise DecodeError("UNEXPECTED_EOF", "length-delimited")
    return raw[at : at + n], at + n


def options_of(pool: Pool, desc) -> Message | None:
    """The options of a field, message, enum or file as a message with its extensions, if the pool has the descriptor types."""
    kind = {D.FieldDesc: "Field", D.MessageDesc: "Message", D.EnumDesc: "Enum", D.FileDesc: "File"}[type(desc)]
    name = f"google.protobuf.{kind}Options"
    return Message.decode(pool, name, desc.options) if name in pool.messages else None
