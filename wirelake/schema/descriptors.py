"""Descriptors as plain picklable data, read from the bytes of a FileDescriptorSet."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .wire import records, signed

(DOUBLE, FLOAT, INT64, UINT64, INT32, FIXED64, FIXED32, BOOL, STRING, GROUP, MESSAGE, BYTES, UINT32, ENUM, SFIXED32, SFIXED64, SINT32, SINT64) = range(1, 19)
SCALAR_NAMES = {DOUBLE: "double", FLOAT: "float", INT64: "int64", UINT64: "uint64", INT32: "int32", FIXED64: "fixed64", FIXED32: "fixed32", BOOL: "bool", STRING: "string", BYTES: "bytes", UINT32: "uint32", SFIXED32: "sfixed32", SFIXED64: "sfixed64", SINT32: "sint32", SINT64: "sint64"}
TYPE_NAMES = {**SCALAR_NAMES, GROUP: "group", MESSAGE: "message", ENUM: "enum"}
OPTIONAL, REQUIRED, REPEATED = 1, 2, 3
KEY_TYPES = {INT64, UINT64, INT32, FIXED64, FIXED32, BOOL, STRING, UINT32, SFIXED32, SFIXED64, SINT32, SINT64}
#: Types whose repeated form can be packed.
PACKABLE = {DOUBLE, FLOAT, INT64, UINT64, INT32, FIXED64, FIXED32, BOOL, UINT32, ENUM, SFIXED32, SFIXED64, SINT32, SINT64}


@dataclass(frozen=True)
class Features:
    presence: str = "explicit"  # explicit, implicit, required
    enum: str = "open"
    repeated: str = "packed"
    utf8: str = "verify"
    encoding: str = "length_prefixed"
    json: str = "allow"


PROTO2 = Features("explicit", "closed", "expanded", "none", "length_prefixed", "best_effort")
PROTO3 = Features("implicit", "open", "packed", "verify", "length_prefixed", "allow")
EDITION_2023 = Features()
_FEATURE_VALUES = {
    1: ("presence", {1: "explicit", 2: "implicit", 3: "required"}),
    2: ("enum", {1: "open", 2: "closed"}),
    3: ("repeated", {1: "packed", 2: "expanded"}),
    4: ("utf8", {2: "verify", 3: "none"}),
    5: ("encoding", {1: "length_prefixed", 2: "delimited"}),
    6: ("json", {1: "allow", 2: "best_effort"}),
}


def override(parent: Features, raw: bytes | None) -> Features:
    """The parent's features with those set in the bytes of a FeatureSet."""
    changed = {}
    for number, _, value in records(raw) if raw else ():
        if number in _FEATURE_VALUES and isinstance(value, int):
            name, values = _FEATURE_VALUES[number]
            if value in values:
                changed[name] = values[value]
    return replace(parent, **changed)


def file_features(syntax: str, edition: int, raw: bytes | None) -> Features:
    """Edition 2024 and later ones have the presets of 2023 here."""
    base = PROTO3 if syntax == "proto3" else EDITION_2023 if syntax == "editions" or edition else PROTO2
    return override(base, raw)


@dataclass
class EnumDesc:
    full_name: str
    values: list[tuple[str, int]]
    closed: bool = False
    file: str = ""
    options: bytes = b""

    def __post_init__(self):
        self.by_name = dict(self.values)
        self.by_number: dict[int, str] = {}
        for name, number in self.values:
            self.by_number.setdefault(number, name)

    @property
    def default(self) -> int:
        return self.values[0][1]


@dataclass
class FieldDesc:
    name: str
    number: int
    type: int
    label: int = OPTIONAL
    type_name: str = ""
    json_name: str = ""
    oneof: int | None = None
    proto3_optional: bool = False
    default_text: str | None = None
    packed_option: bool | None = None
    options: bytes = b""
    extendee: str = ""
    full_name: str = ""
    # Linked
    presence: str = "explicit"
    packed: bool = False
    utf8: str = "verify"
    delimited: bool = False
    is_map: bool = False
    default: object = None

    @property
    def repeated(self) -> bool:
        return self.label == REPEATED

    @property
    def is_message(self) -> bool:
        return self.type in (MESSAGE, GROUP)

    @property
    def tracks_presence(self) -> bool:
        return not self.repeated and self.presence != "implicit"


@dataclass
class OneofDesc:
    name: str
    synthetic: bool = False
    fields: list[int] = field(default_factory=list)
    options: bytes = b""


@dataclass
class MessageDesc:
    full_name: str
    fields: list[FieldDesc]
    oneofs: list[OneofDesc] = field(default_factory=list)
    extension_ranges: list[tuple[int, int]] = field(default_factory=list)
    map_entry: bool = False
    message_set: bool = False
    file: str = ""
    options: bytes = b""
    features: Features = PROTO2

    def index(self) -> None:
        self.by_number = {f.number: f for f in self.fields}
        self.by_name = {f.name: f for f in self.fields}
        self.by_json = {f.json_name: f for f in self.fields}

    def field_named(self, name: str) -> FieldDesc | None:
        """By proto name or JSON name."""
        return self.by_name.get(name) or self.by_json.get(name)

    def in_extension_range(self, number: int) -> bool:
        return any(a <= number < b for a, b in self.extension_ranges)


@dataclass
class MethodDesc:
    name: str
    input: str
    output: str
    client_streaming: bool = False
    server_streaming: bool = False


@dataclass
class ServiceDesc:
    full_name: str
    methods: list[MethodDesc]
    file: str = ""


@dataclass
class FileDesc:
    name: str
    package: str
    dependencies: list[str]
    syntax: str
    edition: int
    messages: list[MessageDesc]
    enums: list[EnumDesc]
    services: list[ServiceDesc]
    extensions: list[FieldDesc]
    raw: bytes = b""
    options: bytes = b""


def json_name(name: str) -> str:
    out, up = [], False
    for c in name:
        if c == "_":
            up = True
        else:
            out.append(c.upper() if up and "a" <= c <= "z" else c)
            up = False
    return "".join(out)


def _all(recs, number):
    return [v for n, _, v in recs if n == number]


def _last(recs, number, default=None):
    found = _all(recs, number)
    return found[-1] if found else default


def _text(recs, number, default=""):
    v = _last(recs, number)
    return default if v is None else v.decode()


def _forced(features: Features, name: str, overrides: dict | None) -> Features:
    return replace(features, **overrides[name]) if overrides and name in overrides else features


def read_file(raw: bytes, overrides: dict[str, dict[str, str]] | None = None) -> FileDesc:
    """``overrides``: features by full name of a message, enum or field, or name of a file; they count as if they stood there."""
    recs = records(raw)
    package = _text(recs, 2)
    syntax = _text(recs, 12, "proto2")
    edition = _last(recs, 14, 0)
    options = b"".join(_all(recs, 8))
    features = _forced(file_features(syntax, edition, b"".join(_all(records(options), 50))), _text(recs, 1), overrides)
    out = FileDesc(_text(recs, 1), package, [x.decode() for x in _all(recs, 3)], syntax, edition, [], [], [], [], raw, options)
    prefix = package + "." if package else ""
    for m in _all(recs, 4):
        _read_message(m, prefix, features, out, overrides)
    for e in _all(recs, 5):
        out.enums.append(_read_enum(e, prefix, features, out.name, overrides))
    for s in _all(recs, 6):
        r = records(s)
        methods = [records(m) for m in _all(r, 2)]
        out.services.append(ServiceDesc(prefix + _text(r, 1), [MethodDesc(_text(m, 1), _text(m, 2).lstrip("."), _text(m, 3).lstrip("."), bool(_last(m, 5, 0)), bool(_last(m, 6, 0))) for m in methods], out.name))
    for x in _all(recs, 7):
        out.extensions.append(_read_field(x, prefix, features, [], overrides))
    return out


def _read_enum(raw: bytes, prefix: str, features: Features, file: str, overrides: dict | None) -> EnumDesc:
    recs = records(raw)
    options = b"".join(_all(recs, 3))
    features = _forced(override(features, b"".join(_all(records(options), 7))), prefix + _text(recs, 1), overrides)
    values = [records(v) for v in _all(recs, 2)]
    return EnumDesc(prefix + _text(recs, 1), [(_text(v, 1), signed(_last(v, 2, 0), 32)) for v in values], features.enum == "closed", file, options)


def _read_message(raw: bytes, prefix: str, features: Features, file: FileDesc, overrides: dict | None) -> None:
    recs = records(raw)
    name = prefix + _text(recs, 1)
    options = b"".join(_all(recs, 7))
    opts = records(options)
    features = _forced(override(features, b"".join(_all(opts, 12))), name, overrides)
    oneofs = [OneofDesc(_text(o, 1), options=b"".join(_all(o, 2))) for o in map(records, _all(recs, 8))]
    fields = [_read_field(f, name + ".", features, oneofs, overrides) for f in _all(recs, 2)]
    ranges = [(_last(r, 1, 0), _last(r, 2, 0)) for r in map(records, _all(recs, 5))]
    message = MessageDesc(name, fields, oneofs, ranges, bool(_last(opts, 7, 0)), bool(_last(opts, 1, 0)), file.name, options, features)
    for f in fields:
        if f.oneof is not None and f.oneof < len(oneofs):
            oneofs[f.oneof].fields.append(f.number)
            oneofs[f.oneof].synthetic |= f.proto3_optional
    file.messages.append(message)
    for x in _all(recs, 6):
        file.extensions.append(_read_field(x, name + ".", features, [], overrides))
    for m in _all(recs, 3):
        _read_message(m, name + ".", features, file, overrides)
    for e in _all(recs, 4):
        file.enums.append(_read_enum(e, name + ".", features, file.name, overrides))


def _read_field(raw: bytes, prefix: str, features: Features, oneofs: list[OneofDesc], overrides: dict | None) -> FieldDesc:
    recs = records(raw)
    options = b"".join(_all(recs, 8))
    opts = records(options)
    name = _text(recs, 1)
    oneof = _last(recs, 9)
    parent = features
    if oneof is not None and oneof < len(oneofs):
        parent = override(features, b"".join(_all(records(oneofs[oneof].options), 1)))
    own = _forced(override(parent, b"".join(_all(opts, 21))), prefix + name, overrides)
    packed = _last(opts, 2)
    f = FieldDesc(
        name, signed(_last(recs, 3, 0), 32), _last(recs, 5, 0), _last(recs, 4, OPTIONAL), _text(recs, 6).lstrip("."), _text(recs, 10) or json_name(name), oneof, bool(_last(recs, 17, 0)),
        None if _last(recs, 7) is None else _text(recs, 7), None if packed is None else bool(packed), options, _text(recs, 2).lstrip("."), prefix + name,
    )
    f.utf8 = own.utf8
    f.delimited = f.type == GROUP or (f.type == MESSAGE and own.encoding == "delimited")
    f.packed = f.repeated and f.type in PACKABLE and (own.repeated == "packed" if f.packed_option is None else f.packed_option)
    if f.label == REQUIRED or own.presence == "required":
        f.presence = "required"
    elif f.is_message or oneof is not None or f.extendee or f.proto3_optional:
        f.presence = "explicit"
    else:
        f.presence = own.presence
    return f
