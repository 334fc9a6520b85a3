"""Presence, edits, unknown fields and merging on decoded structs and payloads; all but extensions run in the JVM."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wire import is_default, varint_size, zigzag64
from ..kernels.message import Message
from ..plans.compile import UNKNOWN
from ..schema import descriptors as D
from ..schema.pool import Pool
from ..schema.wire import varint as _varint
from .codec import from_json


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has(struct, pool: Pool, message: str, field: str) -> Column:
    """Lists and maps: not empty. Implicit presence: not the default, bit for bit. Else: not null."""
    f = pool.message(message).field_named(field)
    if f is None:
        raise KeyError(f"{message} has no field {field}")
    c = _col(struct)[f.name]
    if f.repeated:
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if f.tracks_presence:
        return c.isNotNull()
    if f.type in (D.STRING, D.BYTES):
        return F.coalesce(F.octet_length(c) > 0, F.lit(False))
    if f.type == D.BOOL:
        return F.coalesce(c, F.lit(False))
    if f.type in (D.FLOAT, D.DOUBLE):
        return F.coalesce(c.cast("string") != "0.0", F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def field_or_default(struct, pool: Pool, message: str, field: str) -> Column:
    """The value, or the default of an unset scalar."""
    f = pool.message(message).field_named(field)
    c = _col(struct)[f.name]
    if f.repeated or f.is_message or not f.tracks_presence:
        return c
    default = Message(pool, pool.message(message)).default(f)
    return F.coalesce(c, F.lit(default))


def set_field_names(struct, pool: Pool, message: str) -> Column:
    """The names of all fields that are set, by number."""
    fields = sorted(pool.message(message).fields, key=lambda f: f.number)
    return F.filter(F.array(*[F.when(has(struct, pool, message, f.name), F.lit(f.name)) for f in fields]), lambda x: x.isNotNull())


def field_by_number(struct, pool: Pool, message: str, number: int) -> Column:
    return _col(struct)[pool.message(message).by_number[number].name]


def encoded_len(struct, pool: Pool, message: str, fields: list[str] | None = None) -> Column:
    """The bytes that singular scalar fields of a struct take, from the values alone. Fields that are lists, maps or messages need an encoding: they are an error here."""
    desc = pool.message(message)
    total = F.lit(0).cast("long")
    for f in desc.fields if fields is None else [desc.field_named(n) for n in fields]:
        if f.repeated or f.is_message:
            raise ValueError(f"{f.full_name} is no singular scalar")
        c = _col(struct)[f.name]
        tag = (len(_varint(f.number << 3)))
        if f.type in (D.STRING, D.BYTES):
            size = varint_size(F.octet_length(c)) + F.octet_length(c)
        elif f.type in (D.FIXED32, D.SFIXED32, D.FLOAT):
            size = F.lit(4)
        elif f.type in (D.FIXED64, D.SFIXED64, D.DOUBLE):
            size = F.lit(8)
        elif f.type == D.BOOL:
            size = F.lit(1)
        elif f.type in (D.SINT32, D.SINT64):
            size = varint_size(zigzag64(c))
        elif f.type == D.UINT64:
            size = varint_size(F.when(c > 2**63 - 1, c - 2**64).otherwise(c))
        else:
            size = varint_size(c)
        shown = c.isNotNull() if f.tracks_presence else ~is_default(c, _KINDS.get(f.type, "number"))
        total = total + F.coalesce(F.when(shown, size + tag), F.lit(0)).cast("long")
    return total


_KINDS = {D.STRING: "string", D.BYTES: "bytes", D.BOOL: "bool", D.FLOAT: "float", D.DOUBLE: "double"}


def which_oneof(struct, oneof: str) -> Column:
    """The name of the member that is set, null if none is."""
    return _col(struct)[oneof + "_case"]


def set_fields(struct, values: dict[str, Column]) -> Column:
    """The struct with fields set by dotted path."""
    out = _col(struct)
    for path, value in values.items():
        out = out.withField(path, value)
    return out


def set_paths(struct, other, paths: list[str]) -> Column:
    """The struct with the fields at these paths, as a field mask has them, taken from another of the same type."""
    pick = _col(other)
    out = _col(struct)
    for path in paths:
        value = pick
        for part in path.split("."):
            value = value[part]
        out = out.withField(path, value)
    return out


def clear_fields(struct, *paths: str) -> Column:
    return _col(struct).dropFields(*paths)


# ---------------------------------------------------------------- unknown fields


def unknown_numbers(struct) -> Column:
    return F.transform(_col(struct)[UNKNOWN], lambda u: u["number"])


def keep_unknown(struct, condition) -> Column:
    """The struct with only those unknown fields for which condition(record) holds."""
    c = _col(struct)
    return c.withField(UNKNOWN, F.filter(c[UNKNOWN], condition))


def get_extension(struct, pool: Pool, extension: str) -> Column:
    """The payload of the fields of an extension, under its number: decode it with a message that has it as a field, or take its JSON."""
    x = pool.extension(extension)

    @F.arrow_udf("string")
    def run(unknown: pa.Array) -> pa.Array:
        from ..kernels import json_codec

        out = []
        for records in unknown.to_pylist():
            found = [r for r in records or () if r["number"] == x.number]
            if not found:
                out.append(None)
                continue
            m = Message(pool, pool.messages[x.extendee])
            m.unknown = [(r["number"], r["wire_type"], r["bytes"] if r["bytes"] is not None else int(r["varint"])) for r in found]
            out.append(json_codec._write_field(pool, x, m.extension(x), json_codec.DEFAULT))
        return pa.array(out, pa.string())

    return run(_col(struct)[UNKNOWN])


def has_extension(struct, pool: Pool, extension: str) -> Column:
    number = pool.extension(extension).number
    return F.exists(_col(struct)[UNKNOWN], lambda u: u["number"] == number)


def clear_extension(struct, pool: Pool, extension: str) -> Column:
    number = pool.extension(extension).number
    return keep_unknown(struct, lambda u: u["number"] != number)


def extension_payload(json, pool: Pool, extension: str) -> Column:
    """The payload of an extension set to a JSON value: after another payload it replaces a singular extension there and adds to a repeated one."""
    x = pool.extension(extension)
    key = f'{{"[{x.full_name}]":'
    return from_json(F.concat(F.lit(key), _col(json), F.lit("}")), pool, x.extendee)


# ---------------------------------------------------------------- merging


def merge_payloads(*payloads) -> Column:
    """Payloads one after another are their merge."""
    return F.concat(*[F.coalesce(_col(p), F.lit(b"")) for p in payloads])


def merge_by_key(df: DataFrame, keys: list[str], order: str, payload: str, out: str = "payload") -> DataFrame:
    """One payload for each key: all of its payloads in order, which decodes to their merge. The order must be unique within a key.

    The result holds every byte of the group, so it is for groups that fit in a row; where only the last scalars matter, ``merge_columns``
    needs no more than one row per key and task.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(payload).alias("p")))), lambda x: x["p"])
    return df.groupBy(*keys).agg(ordered.alias("__all")).select(*keys, F.aggregate("__all", F.lit(b""), lambda a, p: F.concat(a, F.coalesce(p, F.lit(b"")))).alias(out))


def merge_columns(df: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """The merge of scalar columns: of each the last value in order that is set. Combines before it shuffles."""
    return df.groupBy(*keys).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f.rpartition(".")[2]) for f in fields])


def map_last_wins(df: DataFrame, keys: list[str], order: str, key: str, value: str) -> DataFrame:
    """The last value of each map key, as a repeated key in a map field has it."""
    return df.groupBy(*keys, key).agg(F.max_by(value, order).alias(value))
