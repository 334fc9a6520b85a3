"""Protobuf text format of dynamic messages, driven by descriptors."""

from __future__ import annotations

import math
import re

import numpy as np

from ..schema import descriptors as D
from ..schema.pool import Pool, c_unescape
from ..schema.wire import BYTES, FIXED32, GROUP, VARINT, DecodeError, records
from .message import RANGES, Message, to_float32


class TextError(ValueError):
    """Text that isn't a message, with line and column."""


# ---------------------------------------------------------------- writing

_SHORT = {10: "\\n", 13: "\\r", 9: "\\t", 34: '\\"', 39: "\\'", 92: "\\\\"}


def escape_bytes(raw: bytes) -> str:
    return "".join(_SHORT.get(b) or (chr(b) if 32 <= b < 127 else f"\\{b:03o}") for b in raw)


def escape_text(text: str) -> str:
    return "".join(_SHORT.get(ord(c)) or (f"\\{ord(c):03o}" if ord(c) < 32 or ord(c) == 127 else c) for c in text)


def to_text(m: Message, pretty: bool = False, unknown: bool = False) -> str:
    """One line, or a field a line with two blanks for each level. ``unknown``: unknown fields by number, too."""
    lines: list[str] = []
    _write(m, 0, lines, unknown)
    return "".join("  " * d + s + "\n" for d, s in lines) if pretty else " ".join(s for _, s in lines)


def _name(pool: Pool, f: D.FieldDesc) -> str:
    if f.extendee:
        return f"[{f.full_name}]"
    if f.type == D.GROUP and f.type_name.rpartition(".")[2].lower() == f.name.lower():
        return f.type_name.rpartition(".")[2]
    return f.name


def _write(m: Message, depth: int, out: list, unknown: bool) -> None:
    if m.desc.full_name == "google.protobuf.Any" and "/" in m.get(1):
        inner = m.pool.messages.get(m.get(1).rpartition("/")[2])
        if inner is not None:
            try:
                body = Message.decode(m.pool, inner.full_name, m.get(2))
            except DecodeError:
                body = None
            if body is not None:
                out.append((depth, f"[{m.get(1)}] {{"))
                _write(body, depth + 1, out, unknown)
                out.append((depth, "}"))
                return
    shown = set()
    for f, v in m.set_fields():
        shown.add(f.number)
        name = _name(m.pool, f)
        if f.is_map:
            entry = m.pool.messages[f.type_name]
            for k in sorted(v):
                out.append((depth, f"{name} {{"))
                _write_one(m.pool, entry.by_number[1], "key", k, depth + 1, out, unknown)
                _write_one(m.pool, entry.by_number[2], "value", v[k], depth + 1, out, unknown)
                out.append((depth, "}"))
        else:
            for x in v if f.repeated else [v]:
                _write_one(m.pool, f, name, x, depth, out, unknown)
    if unknown:
        for number, kind, value in m.unknown:
            if number not in shown:
                _write_unknown(number, kind, value, depth, out)


def _write_one(pool, f, name, v, depth, out, unknown) -> None:
    if f.is_message:
        out.append((depth, f"{name} {{"))
        _write(v, depth + 1, out, unknown)
        out.append((depth, "}"))
    else:
        out.append((depth, f"{name}: {_scalar(pool, f, v)}"))


def _scalar(pool: Pool, f: D.FieldDesc, v) -> str:
    if f.type == D.STRING:
        return f'"{escape_text(v)}"'
    if f.type == D.BYTES:
        return f'"{escape_bytes(v)}"'
    if f.type == D.BOOL:
        return "true" if v else "false"
    if f.type == D.ENUM:
        return pool.enums[f.type_name].by_number.get(v, str(v))
    if f.type in (D.FLOAT, D.DOUBLE):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        text = str(np.float32(v)) if f.type == D.FLOAT else repr(v)
        return text.removesuffix(".0") if "e" not in text else text
    return str(v)


def _write_unknown(number, kind, value, depth, out) -> None:
    if kind == VARINT:
        out.append((depth, f"{number}: {value}"))
    elif kind == GROUP:
        out.append((depth, f"{number} {{"))
        for r in records(value):
            _write_unknown(*r, depth + 1, out)
        out.append((depth, "}"))
    elif kind == BYTES:
        try:
            inner = records(value) if value else []
        except DecodeError:
            inner = []
        if inner:
            out.append((depth, f"{number} {{"))
            for r in inner:
                _write_unknown(*r, depth + 1, out)
            out.append((depth, "}"))
        else:
            out.append((depth, f'{number}: "{escape_bytes(value)}"'))
    else:
        out.append((depth, f"{number}: 0x{value:0{8 if kind == FIXED32 else 16}x}"))


# ---------------------------------------------------------------- reading

_TOKEN = re.compile(
    r"""(?P<space>(?:[ \t\r\n\v\f]|\#[^\n]*)+)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<number>(?:0[xX][0-9a-fA-F]+|(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?[fF]?)(?![\w.]))|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>[-{}<>\[\]:,;/.])""",
    re.DOTALL,
)


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                self.at = at
                raise self.error("no token", at)
            if found.lastgroup != "space":
                self.tokens.append((found.lastgroup, found[0], at))
            at = found.end()
        self.tokens.append(("end", "", len(text)))
        self.i = 0

    def error(self, what: str, at: int | None = None) -> TextError:
        at = self.tokens[self.i][2] if at is None else at
        line = self.text.count("\n", 0, at) + 1
        return TextError(f"{what} at {line}:{at - (self.text.rfind(chr(10), 0, at) + 1) + 1}")

    @property
    def kind(self):
        return self.tokens[self.i][0]

    @property
    def value(self):
        return self.tokens[self.i][1]

    def take(self, *values: str) -> bool:
        if self.value in values and self.kind == "sign":
            self.i += 1
            return True
        return False

    def need(self, *values: str) -> str:
        value = self.value
        if not self.take(*values):
            raise self.error(f"expected {' or '.join(values)}, found {value!r}")
        return value

    def word(self) -> str:
        if self.kind != "name":
            raise self.error(f"expected a name, found {self.value!r}")
        self.i += 1
        return self.tokens[self.i - 1][1]


def from_text(pool: Pool, name: str, text: str) -> Message:
    m = Message(pool, pool.message(name))
    merge_text(m, text)
    return m


def merge_text(m: Message, text: str) -> None:
    """Merges text into a message: lists grow, messages merge, scalars are replaced."""
    r = _Reader(text)
    _read(m, r, "", 100)
    if r.kind != "end":
        raise r.error(f"unexpected {r.value!r}")


def _bracketed(r: _Reader) -> str:
    parts = []
    while not r.take("]"):
        if r.kind == "end":
            raise r.error("] is missing")
        parts.append(r.value)
        r.i += 1
    return "".join(parts)


def _read(m: Message, r: _Reader, close: str, depth: int) -> None:
    if depth <= 0:
        raise r.error("nested too deeply")
    once: set[int] = set()
    while r.kind != "end" and not (r.kind == "sign" and r.value == close):
        if r.take("["):
            name = _bracketed(r)
            if "/" in name:
                _read_any(m, r, name, depth)
                r.take(",", ";")
                continue
            f = m.pool.extensions.get(name)
            if f is None or f.extendee != m.desc.full_name:
                raise r.error(f"{m.desc.full_name} has no extension {name}")
        else:
            name = r.word()
            f = m.desc.by_name.get(name)
            if f is None:
                f = next((x for x in m.desc.fields if x.type == D.GROUP and x.type_name.rpartition(".")[2] == name), None)
            if f is None:
                raise r.error(f"{m.desc.full_name} has no field {name}")
        if not f.repeated:
            if f.number in once:
                raise r.error(f"{name} comes twice")
            once.add(f.number)
            siblings = m.desc.oneofs[f.oneof].fields if f.oneof is not None and not f.extendee else []
            if any(n in once for n in siblings if n != f.number):
                raise r.error(f"two members of {m.desc.oneofs[f.oneof].name}")
        if f.is_message:
            r.take(":")
        else:
            r.need(":")
        if f.repeated and r.take("["):
            if not r.take("]"):
                while True:
                    _read_value(m, f, r, depth)
                    if r.need(",", "]") == "]":
                        break
        else:
            _read_value(m, f, r, depth)
        r.take(",", ";")


def _read_any(m: Message, r: _Reader, url: str, depth: int) -> None:
    if m.desc.full_name != "google.protobuf.Any":
        raise r.error("a type URL outside an Any")
    inner = m.pool.messages.get(url.rpartition("/")[2])
    if inner is None:
        raise r.error(f"unknown type {url}")
    r.take(":")
    body = Message(m.pool, inner)
    _read(body, r, "}" if r.need("{", "<") == "{" else ">", depth - 1)
    r.need("}", ">")
    m.set(1, url)
    m.set(2, body.encode())


def _read_value(m: Message, f: D.FieldDesc, r: _Reader, depth: int) -> None:
    if f.is_message:
        child = Message(m.pool, m.pool.messages[f.type_name])
        if not f.repeated and f.number in m.fields:
            child = m.fields[f.number]
        close = "}" if r.need("{", "<") == "{" else ">"
        _read(child, r, close, depth - 1)
        r.need(close)
        if f.is_map:
            m.fields.setdefault(f.number, {})[child.get(1)] = child.get(2)
        elif f.repeated:
            m.fields.setdefault(f.number, []).append(child)
        else:
            m.set(f, child)
            m.fields[f.number] = child
        return
    value = _read_scalar(m.pool, f, r)
    if f.repeated:
        m.fields.setdefault(f.number, []).append(value)
    else:
        m.set(f, value)


def _read_scalar(pool: Pool, f: D.FieldDesc, r: _Reader):
    if f.type in (D.STRING, D.BYTES):
        raw = b""
        if r.kind != "string":
            raise r.error(f"{f.name} takes a string")
        while r.kind == "string":
            try:
                raw += c_unescape(r.value[1:-1])
            except ValueError as e:
                raise r.error(str(e)) from e
            r.i += 1
        if f.type == D.BYTES:
            return raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            raise r.error(f"{f.name} is no UTF-8") from None
    minus = r.take("-")
    kind, text = r.kind, r.value
    if kind not in ("number", "name"):
        raise r.error(f"{f.name} takes a value, found {text!r}")
    r.i += 1
    try:
        if f.type == D.ENUM:
            if kind == "name":
                if minus:
                    raise ValueError
                return pool.enums[f.type_name].by_name[text]
            number = _int(text, minus)
            e = pool.enums[f.type_name]
            if e.closed and number not in e.by_number:
                raise ValueError
            if not -(1 << 31) <= number < 1 << 31:
                raise ValueError
            return number
        if f.type == D.BOOL:
            return {"true": True, "True": True, "t": True, "1": True, "false": False, "False": False, "f": False, "0": False, "0x1": True, "0x0": False, "01": True, "00": False}[text] if not minus else {}["-"]
        if f.type in (D.FLOAT, D.DOUBLE):
            if kind == "name":
                x = {"inf": math.inf, "infinity": math.inf, "nan": math.nan}[text.lower()]
            else:
                x = float(_int(text, False)) if re.fullmatch(r"0[xX].*|0[0-7]+", text) and "." not in text else float(text.rstrip("fF"))
            x = -x if minus else x
            return to_float32(x) if f.type == D.FLOAT else x
        number = _int(text, minus)
        low, high = RANGES[f.type]
        if not low <= number <= high:
            raise ValueError
        return number
    except (KeyError, ValueError):
        r.i -= 1
        raise r.error(f"{f.name} can't hold {'-' * minus}{text}") from None


def _int(text: str, minus: bool) -> int:
    if re.fullmatch(r"0[xX][0-9a-fA-F]+", text):
        n = int(text, 16)
    elif re.fullmatch(r"0[0-7]+", text):
        n = int(text, 8)
    elif text.isdigit() and (text == "0" or text[0] != "0"):
        n = int(text)
    else:
        raise ValueError
    return -n if minus else n
