"""Text format and YAML of whole batches: columns of lines, joined by row. For messages without recursion, special types and extensions; others go row by row."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ..plans.compile import FieldPlan, Plan
from ..schema import descriptors as D
from ..schema.pool import Pool
from . import text_codec, yaml_codec
from .json_codec import JsonOptions, W, float_text


def _absent(f: FieldPlan, values: list, written: list[str]) -> list[str]:
    """Nothing where a singular scalar isn't set."""
    if f.desc.tracks_presence:
        return ["" if v is None else t for v, t in zip(values, written)]
    if f.desc.type in (D.FLOAT, D.DOUBLE):
        return [t if v or (v is not None and str(v)[0] == "-") else "" for v, t in zip(values, written)]
    return [t if v else "" for v, t in zip(values, written)]


def _inner(column, values: pa.Array) -> tuple[pa.Array, list[int]]:
    """The elements of a list or map column, and where each row's begin and end among them."""
    offsets = np.asarray(column.offsets)
    lo = int(offsets[0])
    return values.slice(lo, int(offsets[-1]) - lo), (offsets - lo).tolist()


def _sorted(plain: list, a: int, b: int):
    return range(a, b) if b - a < 2 else sorted(range(a, b), key=plain.__getitem__)


# ---------------------------------------------------------------- text format


def text(pool: Pool, plan: Plan, struct: pa.StructArray, pretty: bool) -> list[str]:
    """The text of every row; rows that are null give that of an empty message."""
    rows = _text(pool, plan, struct, 0, pretty)
    return rows if pretty else [r[:-1] for r in rows]


def _text(pool: Pool, plan: Plan, struct: pa.StructArray, depth: int, pretty: bool) -> list[str]:
    parts = [_text_field(pool, f, struct.field(f.name), depth, pretty) for f in sorted(plan.fields, key=lambda f: f.desc.number)]
    return list(map("".join, zip(*parts))) if parts else [""] * len(struct)


def _text_values(pool: Pool, d: D.FieldDesc, values: list) -> list[str]:
    if d.type == D.STRING:
        plain = re.compile(r"[^\x00-\x1f\x7f\"'\\]*").fullmatch
        return [f'"{v if plain(v) else text_codec.escape_text(v)}"' if v is not None else "" for v in values]
    if d.type == D.ENUM:
        names = pool.enums[d.type_name].by_number
        return [names.get(v) or str(v) for v in values]
    if d.type in (D.BYTES, D.BOOL, D.FLOAT, D.DOUBLE):
        return ["" if v is None else text_codec._scalar(pool, d, v) for v in values]
    return list(map(str, values))


def _text_lines(pool: Pool, f: FieldPlan, name: str, column: pa.Array, depth: int, pretty: bool) -> list[str]:
    pad, end = ("  " * depth, "\n") if pretty else ("", " ")
    if f.desc.is_message:
        left, right = f"{pad}{name} {{{end}", f"{pad}}}{end}"
        return [f"{left}{body}{right}" for body in _text(pool, f.child, column, depth + 1, pretty)]
    return [f"{pad}{name}: {v}{end}" for v in _text_values(pool, f.desc, column.to_pylist())]


def _text_field(pool: Pool, f: FieldPlan, column: pa.Array, depth: int, pretty: bool) -> list[str]:
    d, name = f.desc, text_codec._name(pool, f.desc)
    if d.is_map:
        pad, end = ("  " * depth, "\n") if pretty else ("", " ")
        left, right = f"{pad}{name} {{{end}", f"{pad}}}{end}"
        key, value = f.child.fields
        keys, cuts = _inner(column, column.keys)
        plain = keys.to_pylist()
        entries = [f"{left}{k}{v}{right}" for k, v in zip(_text_lines(pool, key, "key", keys, depth + 1, pretty), _text_lines(pool, value, "value", _inner(column, column.items)[0], depth + 1, pretty))]
        return ["".join([entries[i] for i in _sorted(plain, a, b)]) for a, b in zip(cuts, cuts[1:])]
    if d.repeated:
        elements, cuts = _inner(column, column.values)
        lines = _text_lines(pool, f, name, elements, depth, pretty)
        return ["".join(lines[a:b]) for a, b in zip(cuts, cuts[1:])]
    lines = _text_lines(pool, f, name, column, depth, pretty)
    if d.is_message:
        return [t if ok else "" for t, ok in zip(lines, column.is_valid().to_pylist())]
    return _absent(f, column.to_pylist(), lines)


# ---------------------------------------------------------------- YAML

#: Stands in a row that has what only the row codec writes; YAML never has this character.
BY_ROW = "\0"
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")
_DIGITS = re.compile(r"-?(?:0|[1-9][0-9]*)", re.ASCII)


def yaml(pool: Pool, plan: Plan, struct: pa.StructArray, options: JsonOptions) -> list[str]:
    """The YAML of every row; rows that are null give that of an empty message. A row with ``BY_ROW`` in it is to be written by the row codec."""
    return [r or "{}\n" for r in _yaml(pool, plan, struct, "", options)]


@lru_cache(maxsize=4096)
def _string(s: str) -> str:
    if _WORD.fullmatch(s) and s.lower() not in yaml_codec.WORDS:
        return s
    if _DIGITS.fullmatch(s):
        return f"'{s}'"
    if any(c in s for c in "\n\r\x85\u2028\u2029"):
        return BY_ROW
    return yaml_codec.dump({"k": s})[3:-1]


def _key(s: str) -> str:
    return _string(s) if len(s) < 100 and (_WORD.fullmatch(s) or _DIGITS.fullmatch(s)) else BY_ROW


def _number(x: float, single: bool) -> str:
    shown = float_text(x, single)
    if shown[0] == '"':
        return _string(shown[1:-1])
    shown = repr(float(shown)) if single else shown
    return shown.replace("e", ".0e", 1) if "." not in shown else shown


def _yaml_values(pool: Pool, d: D.FieldDesc, values: list, o: JsonOptions) -> list[str]:
    t = d.type
    if t == D.STRING:
        return ["" if v is None else _string(v) for v in values]
    if t == D.BYTES:
        return ["" if v is None else _string(base64.b64encode(v).decode()) for v in values]
    if t == D.BOOL:
        return ["true" if v else "false" for v in values]
    if t in (D.INT64, D.UINT64, D.FIXED64, D.SFIXED64, D.SINT64):
        return [f"'{v}'" for v in values]
    if t in (D.FLOAT, D.DOUBLE):
        return ["" if v is None else _number(v, t == D.FLOAT) for v in values]
    if t == D.ENUM:
        if d.type_name == W + "NullValue":
            return ["null"] * len(values)
        names = {} if o.numbers_for_enums else {n: _string(name) for n, name in pool.enums[d.type_name].by_number.items()}
        return [names.get(v) or str(v) for v in values]
    return list(map(str, values))


def _after_key(pool: Pool, f: FieldPlan, column: pa.Array, pad: str, o: JsonOptions) -> list[str]:
    """What follows a key and its colon, with the line's end."""
    if f.desc.is_message:
        return ["\n" + t if t else " {}\n" for t in _yaml(pool, f.child, column, pad + "  ", o)]
    return [f" {v}\n" for v in _yaml_values(pool, f.desc, column.to_pylist(), o)]


def _yaml(pool: Pool, plan: Plan, struct: pa.StructArray, pad: str, o: JsonOptions) -> list[str]:
    parts = [_yaml_field(pool, f, struct.field(f.name), pad, o) for f in sorted(plan.fields, key=lambda f: f.desc.number)]
    return list(map("".join, zip(*parts))) if parts else [""] * len(struct)


def _yaml_field(pool: Pool, f: FieldPlan, column: pa.Array, pad: str, o: JsonOptions) -> list[str]:
    d = f.desc
    head = f"{pad}{_key(d.name if o.proto_names else d.json_name)}:"
    if d.is_map:
        key, value = f.child.fields
        keys, cuts = _inner(column, column.keys)
        plain = keys.to_pylist()
        shown = [_key(str(k).lower() if key.desc.type == D.BOOL else str(k)) for k in plain]
        entries = [f"{pad}  {k}:{v}" for k, v in zip(shown, _after_key(pool, value, _inner(column, column.items)[0], pad + "  ", o))]
        return [f"{head}\n{''.join([entries[i] for i in _sorted(plain, a, b)])}" if b > a else "" for a, b in zip(cuts, cuts[1:])]
    if d.repeated:
        elements, cuts = _inner(column, column.values)
        if d.is_message:
            lines = [f"{pad}- {t[len(pad) + 2 :] or '{}' + chr(10)}" for t in _yaml(pool, f.child, elements, pad + "  ", o)]
        else:
            lines = [f"{pad}- {v}\n" for v in _yaml_values(pool, d, elements.to_pylist(), o)]
        return [f"{head}\n{''.join(lines[a:b])}" if b > a else "" for a, b in zip(cuts, cuts[1:])]
    lines = [head + t for t in _after_key(pool, f, column, pad, o)]
    if d.is_message:
        return [t if ok else "" for t, ok in zip(lines, column.is_valid().to_pylist())]
    return _absent(f, column.to_pylist(), lines)
