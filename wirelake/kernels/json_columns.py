"""Protobuf JSON of whole batches: columns of text, joined by row. For messages without recursion, special types and extensions; others go row by row."""

from __future__ import annotations

import base64
from json.encoder import encode_basestring

import numpy as np
import pyarrow as pa

from ..plans.compile import FieldPlan, Plan
from ..schema import descriptors as D
from ..schema.pool import Pool
from .json_codec import SPECIAL, JsonOptions, W, float_text


def can_write(pool: Pool, message: str, options: JsonOptions) -> bool:
    if options.always_print:
        return False
    seen, todo = set(), [message.lstrip(".")]
    while todo:
        name = todo.pop()
        if name in SPECIAL or name not in pool.messages or pool.is_recursive(name) or pool.extensions_of(name):
            return False
        seen.add(name)
        todo += [f.type_name for f in pool.messages[name].fields if f.is_message and f.type_name not in seen]
    return True


def _converter(pool: Pool, f: D.FieldDesc, o: JsonOptions):
    t = f.type
    if t == D.STRING:
        return encode_basestring
    if t == D.BYTES:
        return lambda v: f'"{base64.b64encode(v).decode()}"'
    if t == D.BOOL:
        return lambda v: "true" if v else "false"
    if t in (D.INT64, D.UINT64, D.FIXED64, D.SFIXED64, D.SINT64):
        return lambda v: f'"{v}"'
    if t in (D.FLOAT, D.DOUBLE):
        return lambda v: float_text(v, t == D.FLOAT)
    if t == D.ENUM:
        if f.type_name == W + "NullValue":
            return lambda v: "null"
        names = {} if o.numbers_for_enums else {n: f'"{name}"' for n, name in pool.enums[f.type_name].by_number.items()}
        return lambda v: names.get(v) or str(v)
    return str


def write(pool: Pool, plan: Plan, struct: pa.StructArray, options: JsonOptions) -> list[str]:
    """The JSON of every row; rows that are null give that of an empty message."""
    parts = []
    for f in sorted(plan.fields, key=lambda f: f.desc.number):
        key = encode_basestring(f.desc.name if options.proto_names else f.desc.json_name) + ":"
        parts.append(_field(pool, f, struct.field(f.name), key, options))
    if not parts:
        return ["{}"] * len(struct)
    return ["{" + ",".join(filter(None, row)) + "}" for row in zip(*parts)]


def _grouped(texts: list[str], offsets: np.ndarray, key: str, left: str, right: str) -> list[str]:
    cuts = (offsets - offsets[0]).tolist()
    return [f"{key}{left}{','.join(texts[a:b])}{right}" if b > a else "" for a, b in zip(cuts, cuts[1:])]


def _texts(pool: Pool, f: FieldPlan, column: pa.Array, o: JsonOptions) -> list[str]:
    if f.desc.is_message:
        return write(pool, f.child, column, o)
    return list(map(_converter(pool, f.desc, o), column.to_pylist()))


def _field(pool: Pool, f: FieldPlan, column: pa.Array, key: str, o: JsonOptions) -> list[str]:
    d = f.desc
    if d.is_map:
        offsets = np.asarray(column.offsets)
        lo, hi = int(offsets[0]), int(offsets[-1])
        name, value = f.child.fields
        keys = column.keys.slice(lo, hi - lo)
        plain = keys.to_pylist()
        shown = [encode_basestring(k) for k in plain] if name.desc.type == D.STRING else [f'"{str(k).lower() if name.desc.type == D.BOOL else k}"' for k in plain]
        items = _texts(pool, value, column.items.slice(lo, hi - lo), o)
        cuts = (offsets - lo).tolist()
        out = []
        for a, b in zip(cuts, cuts[1:]):
            order = range(a, b) if b - a < 2 else sorted(range(a, b), key=plain.__getitem__)
            out.append(f"{key}{{{','.join(f'{shown[i]}:{items[i]}' for i in order)}}}" if b > a else "")
        return out
    if d.repeated:
        offsets = np.asarray(column.offsets)
        return _grouped(_texts(pool, f, column.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])), o), offsets, key, "[", "]")
    if d.is_message:
        there = column.is_valid().to_pylist()
        return [key + t if ok else "" for t, ok in zip(write(pool, f.child, column, o), there)]
    to = _converter(pool, d, o)
    values = column.to_pylist()
    if d.tracks_presence:
        return ["" if v is None else key + to(v) for v in values]
    if d.type in (D.FLOAT, D.DOUBLE):
        return [key + to(v) if v or str(v)[0] == "-" else "" for v in values]
    return [key + to(v) if v else "" for v in values]
