"""Descriptor sets written from Python, for schemas that have no compiled file."""

from __future__ import annotations

from dataclasses import dataclass, field

from .descriptors import ENUM, GROUP, MESSAGE, REPEATED, TYPE_NAMES
from .wire import BYTES as LEN
from .wire import VARINT, record_bytes

_TYPES = {v: k for k, v in TYPE_NAMES.items()}


@dataclass
class FieldDef:
    """type: a scalar name, or message:Name, group:Name, enum:Name, or map:key,value with value of the same forms."""

    name: str
    number: int
    type: str
    repeated: bool = False
    required: bool = False
    optional: bool = False
    oneof: str | None = None
    default: str | None = None
    packed: bool | None = None
    features: dict[int, int] = field(default_factory=dict)
    json_name: str | None = None


@dataclass
class OneofDef:
    name: str


@dataclass
class EnumDef:
    name: str
    values: dict[str, int]
    features: dict[int, int] = field(default_factory=dict)


@dataclass
class MessageDef:
    name: str
    fields: list[FieldDef]
    messages: list["MessageDef"] = field(default_factory=list)
    enums: list[EnumDef] = field(default_factory=list)
    extension_ranges: list[tuple[int, int]] = field(default_factory=list)
    message_set: bool = False


@dataclass
class FileDef:
    name: str
    package: str
    messages: list[MessageDef]
    enums: list[EnumDef] = field(default_factory=list)
    extensions: list[tuple[str, FieldDef]] = field(default_factory=list)
    services: dict[str, list[tuple[str, str, str, bool, bool]]] = field(default_factory=dict)
    dependencies: list[str] = field(default_factory=list)
    syntax: str = "proto3"
    edition: int = 0
    features: dict[int, int] = field(default_factory=dict)


def _b(number: int, value: bytes | str) -> bytes:
    return record_bytes(number, LEN, value.encode() if isinstance(value, str) else value)


def _v(number: int, value: int) -> bytes:
    return record_bytes(number, VARINT, value & ((1 << 64) - 1))


def _features(number: int, features: dict[int, int]) -> bytes:
    return _b(number, b"".join(_v(k, v) for k, v in features.items())) if features else b""


def _typed(spec: str) -> bytes:
    kind, _, name = spec.partition(":")
    out = _v(5, _TYPES[kind])
    return out + (_b(6, name) if _TYPES[kind] in (MESSAGE, GROUP, ENUM) else b"")


def _entry_name(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in name.split("_")) + "Entry"


def _field(f: FieldDef, oneofs: list[str], extendee: str = "") -> bytes:
    spec, repeated = f.type, f.repeated
    if spec.startswith("map:"):
        spec, repeated = "message:" + _entry_name(f.name), True
    out = _b(1, f.name) + (_b(2, extendee) if extendee else b"") + _v(3, f.number) + _v(4, REPEATED if repeated else 2 if f.required else 1) + _typed(spec)
    if f.default is not None:
        out += _b(7, f.default)
    options = (b"" if f.packed is None else _v(2, int(f.packed))) + _features(21, f.features)
    if options:
        out += _b(8, options)
    if f.oneof is not None or f.optional:
        out += _v(9, oneofs.index(f.oneof or "_" + f.name))
    if f.json_name:
        out += _b(10, f.json_name)
    return out + (_v(17, 1) if f.optional else b"")


def _enum(e: EnumDef) -> bytes:
    return _b(1, e.name) + b"".join(_b(2, _b(1, n) + _v(2, v)) for n, v in e.values.items()) + (_b(3, _features(7, e.features)) if e.features else b"")


def _message(m: MessageDef) -> bytes:
    oneofs = list(dict.fromkeys(f.oneof for f in m.fields if f.oneof)) + ["_" + f.name for f in m.fields if f.optional]
    out = _b(1, m.name) + b"".join(_b(2, _field(f, oneofs)) for f in m.fields) + b"".join(_b(3, _message(x)) for x in m.messages)
    for f in m.fields:
        if f.type.startswith("map:"):
            key, _, value = f.type[4:].partition(",")
            entry = b"".join(_b(2, _b(1, n) + _v(3, i) + _v(4, 1) + _typed(t)) for n, i, t in (("key", 1, key), ("value", 2, value)))
            out += _b(3, _b(1, _entry_name(f.name)) + entry + _b(7, _v(7, 1)))
    out += b"".join(_b(4, _enum(e)) for e in m.enums) + b"".join(_b(5, _v(1, a) + _v(2, b)) for a, b in m.extension_ranges)
    out += _b(7, _v(1, 1)) if m.message_set else b""
    return out + b"".join(_b(8, _b(1, o)) for o in oneofs)


def build(*files: FileDef) -> bytes:
    """The bytes of a FileDescriptorSet."""
    out = b""
    for f in files:
        raw = _b(1, f.name) + (_b(2, f.package) if f.package else b"") + b"".join(_b(3, d) for d in f.dependencies)
        raw += b"".join(_b(4, _message(m)) for m in f.messages) + b"".join(_b(5, _enum(e)) for e in f.enums)
        for name, methods in f.services.items():
            raw += _b(6, _b(1, name) + b"".join(_b(2, _b(1, m) + _b(2, i) + _b(3, o) + _v(5, int(c)) + _v(6, int(s))) for m, i, o, c, s in methods))
        raw += b"".join(_b(7, _field(x, [], extendee)) for extendee, x in f.extensions)
        raw += _b(8, _features(50, f.features)) if f.features else b""
        raw += _b(12, "editions" if f.edition else f.syntax) + (_v(14, f.edition) if f.edition else b"")
        out += _b(1, raw)
    return out
