"""Linked pools of descriptors: loading, adding, lookups, and catalogs as DataFrames."""

from __future__ import annotations

import copy
import math

from .descriptors import BOOL, BYTES, DOUBLE, ENUM, FLOAT, GROUP, KEY_TYPES, MESSAGE, STRING, TYPE_NAMES, EnumDesc, FieldDesc, FileDesc, MessageDesc, ServiceDesc, read_file
from .wire import MAX_FIELD, DecodeError, records

MAX_FIELDS = 65_535


class SchemaError(ValueError):
    """A descriptor set that can't be linked; ``code`` says why."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


class Pool:
    """Messages, enums, services and extensions by full name. Plain data: it pickles into tasks."""

    def __init__(self, descriptor_set: bytes | None = None, overrides: dict[str, dict[str, str]] | None = None):
        self.files: dict[str, FileDesc] = {}
        self.messages: dict[str, MessageDesc] = {}
        self.enums: dict[str, EnumDesc] = {}
        self.services: dict[str, ServiceDesc] = {}
        self.extensions: dict[str, FieldDesc] = {}
        self._by_extendee: dict[tuple[str, int], FieldDesc] = {}
        if descriptor_set is not None:
            self.add(descriptor_set, overrides)

    @staticmethod
    def from_file(path: str) -> "Pool":
        """A compiled descriptor set in a local file of the driver."""
        with open(path, "rb") as f:
            return Pool(f.read())

    def add(self, descriptor_set: bytes, overrides: dict[str, dict[str, str]] | None = None) -> "Pool":
        """Adds the files of a set, with features overridden by name (see ``read_file``). A file of a name that is there already is left out if its bytes are the same, else an error. All or nothing."""
        try:
            raws = [v for n, _, v in records(descriptor_set) if n == 1]
            files = [read_file(r, overrides) for r in raws]
        except (DecodeError, UnicodeDecodeError, AttributeError, TypeError) as e:
            raise SchemaError("BAD_DESCRIPTOR_SET", str(e)) from e
        staged = copy.copy(self)
        for part in ("files", "messages", "enums", "services", "extensions", "_by_extendee"):
            setattr(staged, part, dict(getattr(self, part)))
        fresh = []
        for f in files:
            if f.name in staged.files:
                if staged.files[f.name].raw != f.raw:
                    raise SchemaError("DUPLICATE_FILE", f.name)
                continue
            staged.files[f.name] = f
            fresh.append(f)
        for f in fresh:
            staged._register(f)
        for f in fresh:
            staged._link(f)
        self.__dict__.update(staged.__dict__)
        return self

    def _register(self, f: FileDesc) -> None:
        for missing in (d for d in f.dependencies if d not in self.files):
            raise SchemaError("MISSING_DEPENDENCY", f"{f.name} needs {missing}")
        taken = lambda n: n in self.messages or n in self.enums or n in self.services or n in self.extensions
        for m in f.messages:
            if taken(m.full_name):
                raise SchemaError("DUPLICATE_SYMBOL", m.full_name)
            if len(m.fields) > MAX_FIELDS:
                raise SchemaError("TOO_MANY_FIELDS", m.full_name)
            self.messages[m.full_name] = m
        for e in f.enums:
            if taken(e.full_name):
                raise SchemaError("DUPLICATE_SYMBOL", e.full_name)
            if not e.values:
                raise SchemaError("EMPTY_ENUM", e.full_name)
            if not e.closed and e.values[0][1] != 0:
                raise SchemaError("OPEN_ENUM_NOT_ZERO", e.full_name)
            self.enums[e.full_name] = e
        for s in f.services:
            if taken(s.full_name):
                raise SchemaError("DUPLICATE_SYMBOL", s.full_name)
            self.services[s.full_name] = s
        for x in f.extensions:
            if taken(x.full_name):
                raise SchemaError("DUPLICATE_SYMBOL", x.full_name)
            self.extensions[x.full_name] = x

    def _resolve(self, name: str, scope: str, kinds: tuple[dict, ...]):
        """A name as it is, or by C++ scoping from the innermost scope outwards."""
        while True:
            full = f"{scope}.{name}" if scope else name
            for kind in kinds:
                if full in kind:
                    return full
            if not scope:
                return None
            scope = scope.rpartition(".")[0]

    def _link(self, f: FileDesc) -> None:
        for m in f.messages:
            numbers, names = set(), set()
            for x in m.fields:
                self._link_field(x, m.full_name)
                if x.number in numbers:
                    raise SchemaError("DUPLICATE_FIELD_NUMBER", f"{m.full_name}.{x.name}")
                if x.name in names:
                    raise SchemaError("DUPLICATE_FIELD_NAME", f"{m.full_name}.{x.name}")
                if x.oneof is not None and not 0 <= x.oneof < len(m.oneofs):
                    raise SchemaError("BAD_ONEOF_INDEX", f"{m.full_name}.{x.name}")
                numbers.add(x.number)
                names.add(x.name)
            m.index()
        for m in f.messages:
            for x in m.fields:
                if x.is_map and (set(self.messages[x.type_name].by_number) != {1, 2} or self.messages[x.type_name].by_number[1].type not in KEY_TYPES):
                    raise SchemaError("BAD_MAP_ENTRY", x.full_name)
        for x in f.extensions:
            scope = x.full_name.rpartition(".")[0]
            found = self._resolve(x.extendee, scope, (self.messages,))
            if found is None:
                raise SchemaError("UNKNOWN_TYPE", f"{x.full_name} extends {x.extendee}")
            x.extendee = found
            self._link_field(x, scope)
            if not self.messages[found].in_extension_range(x.number):
                raise SchemaError("NOT_IN_EXTENSION_RANGE", x.full_name)
            if (found, x.number) in self._by_extendee:
                raise SchemaError("DUPLICATE_EXTENSION", x.full_name)
            self._by_extendee[found, x.number] = x
        for s in f.services:
            for method in s.methods:
                for side in ("input", "output"):
                    found = self._resolve(getattr(method, side), s.full_name, (self.messages,))
                    if found is None:
                        raise SchemaError("UNKNOWN_TYPE", f"{s.full_name}.{method.name}: {getattr(method, side)}")
                    setattr(method, side, found)

    def _link_field(self, x: FieldDesc, scope: str) -> None:
        if not 1 <= x.number <= MAX_FIELD or 19_000 <= x.number <= 19_999:
            raise SchemaError("BAD_FIELD_NUMBER", f"{x.full_name} = {x.number}")
        if x.type_name:
            found = self._resolve(x.type_name, scope, (self.messages, self.enums))
            if found is None:
                raise SchemaError("UNKNOWN_TYPE", f"{x.full_name}: {x.type_name}")
            x.type_name = found
            if not x.type:
                x.type = MESSAGE if found in self.messages else ENUM
            if (x.type == ENUM) != (found in self.enums):
                raise SchemaError("KIND_MISMATCH", f"{x.full_name}: {found}")
        if x.type not in TYPE_NAMES:
            raise SchemaError("BAD_TYPE", f"{x.full_name}: {x.type}")
        if x.type in (MESSAGE, GROUP, ENUM) and not x.type_name:
            raise SchemaError("NO_TYPE_NAME", x.full_name)
        if x.type in (MESSAGE, GROUP):
            x.is_map = x.repeated and self.messages[x.type_name].map_entry
            if x.is_map:
                x.delimited = False
        elif x.default_text is not None:
            x.default = self._default(x)

    def _default(self, x: FieldDesc):
        text = x.default_text
        try:
            if x.type == STRING:
                return text
            if x.type == BYTES:
                return c_unescape(text)
            if x.type == BOOL:
                return {"true": True, "false": False}[text]
            if x.type in (FLOAT, DOUBLE):
                return {"inf": math.inf, "-inf": -math.inf, "nan": math.nan}[text] if text in ("inf", "-inf", "nan") else float(text)
            if x.type == ENUM:
                return self.enums[x.type_name].by_name[text]
            return int(text, 0)
        except (KeyError, ValueError) as e:
            raise SchemaError("BAD_DEFAULT", f"{x.full_name}: {text!r}") from e

    # ------------------------------------------------------------ lookups

    def message(self, name: str) -> MessageDesc:
        found = self.messages.get(name.lstrip("."))
        if found is None:
            raise SchemaError("NO_SUCH_MESSAGE", name)
        return found

    def enum(self, name: str) -> EnumDesc:
        found = self.enums.get(name.lstrip("."))
        if found is None:
            raise SchemaError("NO_SUCH_ENUM", name)
        return found

    def extension(self, name: str) -> FieldDesc:
        found = self.extensions.get(name.strip("[]").lstrip("."))
        if found is None:
            raise SchemaError("NO_SUCH_EXTENSION", name)
        return found

    def extension_for(self, extendee: str, number: int) -> FieldDesc | None:
        return self._by_extendee.get((extendee, number))

    def extensions_of(self, extendee: str) -> list[FieldDesc]:
        return [x for (e, _), x in sorted(self._by_extendee.items()) if e == extendee]

    def file_containing(self, symbol: str) -> FileDesc | None:
        symbol = symbol.lstrip(".")
        for kind in (self.messages, self.enums, self.services):
            if symbol in kind:
                return self.files[kind[symbol].file]
        for f in self.files.values():
            if any(x.full_name == symbol for x in f.extensions) or any(x.full_name == symbol for m in f.messages for x in m.fields):
                return f
        return None

    def is_recursive(self, name: str) -> bool:
        """Whether a message can hold itself."""
        seen, todo = set(), [name]
        while todo:
            for x in self.messages[todo.pop()].fields:
                if x.type in (MESSAGE, GROUP):
                    if x.type_name == name:
                        return True
                    if x.type_name not in seen:
                        seen.add(x.type_name)
                        todo.append(x.type_name)
        return False

    # ------------------------------------------------------------ catalogs

    def messages_df(self, spark):
        rows = [(m.full_name, m.file, len(m.fields), m.map_entry, m.message_set, self.is_recursive(m.full_name)) for m in self.messages.values()]
        return spark.createDataFrame(rows, "message string, file string, n_fields int, map_entry boolean, message_set boolean, recursive boolean")

    def fields_df(self, spark):
        rows = []
        for m in self.messages.values():
            for x in m.fields:
                oneof = None if x.oneof is None else m.oneofs[x.oneof].name
                rows.append((m.full_name, x.name, x.json_name, x.number, TYPE_NAMES[x.type], x.type_name or None, "map" if x.is_map else "repeated" if x.repeated else "singular", x.presence, x.packed, x.delimited, oneof))
        return spark.createDataFrame(rows, "message string, field string, json_name string, number int, type string, type_name string, cardinality string, presence string, packed boolean, delimited boolean, oneof string")

    def enums_df(self, spark):
        rows = [(e.full_name, name, number, e.closed) for e in self.enums.values() for name, number in e.values]
        return spark.createDataFrame(rows, "enum string, value string, number int, closed boolean")

    def services_df(self, spark):
        rows = [(s.full_name, m.name, m.input, m.output, m.client_streaming, m.server_streaming) for s in self.services.values() for m in s.methods]
        return spark.createDataFrame(rows, "service string, method string, input string, output string, client_streaming boolean, server_streaming boolean")

    def extensions_df(self, spark):
        rows = [(x.full_name, x.extendee, x.number, TYPE_NAMES[x.type], x.repeated) for x in self.extensions.values()]
        return spark.createDataFrame(rows, "extension string, extendee string, number int, type string, repeated boolean")


_ESCAPES = {"n": 10, "r": 13, "t": 9, "a": 7, "b": 8, "f": 12, "v": 11, "\\": 92, "'": 39, '"': 34, "?": 63}


def c_unescape(text: str) -> bytes:
    """Bytes of a string with C escapes."""
    out, i = bytearray(), 0
    while i < len(text):
        c = text[i]
        i += 1
        if c != "\\":
            out += c.encode()
            continue
        if i >= len(text):
            raise ValueError("an escape is cut off")
        c = text[i]
        i += 1
        if c in _ESCAPES:
            out.append(_ESCAPES[c])
        elif c in "xX":
            j = i
            while j < min(i + 2, len(text)) and text[j] in "0123456789abcdefABCDEF":
                j += 1
            if j == i:
                raise ValueError("no digits after \\x")
            out.append(int(text[i:j], 16))
            i = j
        elif c in "01234567":
            j = i
            while j < min(i + 2, len(text)) and text[j] in "01234567":
                j += 1
            value = int(text[i - 1 : j], 8)
            if value > 255:
                raise ValueError("octal escape above 255")
            out.append(value)
            i = j
        elif c in "uU":
            n = 4 if c == "u" else 8
            digits = text[i : i + n]
            if len(digits) < n:
                raise ValueError("an escape is cut off")
            value = int(digits, 16)
            i += n
            if 0xD800 <= value < 0xDC00 and text[i : i + 2] == "\\u":
                low = int(text[i + 2 : i + 6], 16)
                if not 0xDC00 <= low < 0xE000:
                    raise ValueError("half a surrogate pair")
                value = 0x10000 + ((value - 0xD800) << 10) + (low - 0xDC00)
                i += 6
            if 0xD800 <= value < 0xE000 or value > 0x10FFFF:
                raise ValueError("no such code point")
            out += chr(value).encode()
        else:
            raise ValueError(f"unknown escape \\{c}")
    return bytes(out)
