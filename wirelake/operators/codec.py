"""Payload columns to structs, text and back.

Each function returns a Column over an Arrow UDF, so only the column it takes goes to Python, in batches, and all
others stay in the JVM. Pools and plans travel in the closure as plain data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import columnar, json_codec, json_columns, text_codec, text_columns, transcode, wkt, yaml_codec
from ..kernels.message import DEFAULT, Message, Options, read_delimited
from ..plans import compile_plan, spark_type
from ..schema.pool import Pool
from ..schema.wire import DecodeError, EncodeError

FAILFAST, PERMISSIVE, DROPMALFORMED = "FAILFAST", "PERMISSIVE", "DROPMALFORMED"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _nullable(t: T.DataType) -> T.DataType:
    """The type with everything nullable: Arrow UDFs promise nothing else."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_nullable(t.elementType), True)
    return T.MapType(t.keyType, _nullable(t.valueType), True) if isinstance(t, T.MapType) else t


def _cast(array: pa.Array, t: T.DataType) -> pa.Array:
    return _loosen(array, columnar.arrow_type(t))


def _loosen(array: pa.Array, kind: pa.DataType) -> pa.Array:
    """The same buffers under a type with other nullability."""
    if array.type == kind:
        return array
    children = []
    if pa.types.is_struct(kind):
        children = [_loosen(array.field(i), kind.field(i).type) for i in range(kind.num_fields)]
        mask = array.is_null() if array.null_count else None
        return pa.StructArray.from_arrays(children, fields=[kind.field(i) for i in range(kind.num_fields)], mask=mask)
    if pa.types.is_map(kind):
        return pa.MapArray.from_arrays(array.offsets, _loosen(array.keys, kind.key_type), _loosen(array.items, kind.item_type)).cast(kind)
    if pa.types.is_list(kind):
        return pa.ListArray.from_arrays(array.offsets, _loosen(array.values, kind.value_type), type=kind)
    return array.cast(kind)


def _checked(decoded: columnar.Decoded, column: pa.Array) -> None:
    if decoded.errors.any():
        row = int(decoded.errors.nonzero()[0][0])
        raise DecodeError(columnar.CODES[decoded.errors[row]], f"payload {column[row].as_py()[:40].hex()}")


def _with_nulls(struct: pa.StructArray, mask) -> pa.StructArray:
    return pa.StructArray.from_arrays([struct.field(i) for i in range(struct.type.num_fields)], fields=[struct.type.field(i) for i in range(struct.type.num_fields)], mask=mask) if struct.type.num_fields else struct


def decode(column, pool: Pool, message: str, fields: list[str] | None = None, shallow: bool = False, unknown: bool = False, max_depth: int = 6, options: Options = DEFAULT, mode: str = FAILFAST) -> Column:
    """The struct of a payload column.

    ``fields``: dotted paths; all other fields are stepped over. ``shallow``: nested messages stay binary. ``unknown``: with the
    column _unknown. FAILFAST ends the query at the first broken payload; PERMISSIVE makes its struct null. A null payload is null.
    """
    plan = compile_plan(pool, message, fields, shallow, unknown, max_depth=max_depth, utf8_as_bytes=options.utf8_as_bytes)
    kind = _nullable(spark_type(plan))

    @F.arrow_udf(kind)
    def run(payload: pa.Array) -> pa.Array:
        made = columnar.decode_column(plan, payload, options)
        if mode == FAILFAST:
            _checked(made, payload)
        broken = pa.array(made.errors != 0)
        struct = _cast(made.struct, kind)
        mask = pa.compute.or_(broken, payload.is_null()) if payload.null_count or made.errors.any() else None
        return _with_nulls(struct, mask) if mask is not None else struct

    return run(_col(column))


def decode_frame(df: DataFrame, column: str, pool: Pool, message: str, out: str = "value", mode: str = PERMISSIVE, error: str = "_error", **how) -> DataFrame:
    """``df`` with the struct ``out`` and the column ``error``, the code of what is wrong with a payload. DROPMALFORMED leaves such rows out, and the column."""
    options = how.pop("options", DEFAULT)
    if mode == FAILFAST:
        return df.withColumn(out, decode(column, pool, message, options=options, **how))
    plan = compile_plan(pool, message, how.get("fields"), how.get("shallow", False), how.get("unknown", False), max_depth=how.get("max_depth", 6), utf8_as_bytes=options.utf8_as_bytes)
    kind = T.StructType([T.StructField("value", _nullable(spark_type(plan))), T.StructField("error", T.StringType())])

    def decoded(payload: pa.Array) -> pa.StructArray:
        made = columnar.decode_column(plan, payload, options)
        gone = pa.compute.or_(pa.array(made.errors != 0), payload.is_null())
        return pa.StructArray.from_arrays([_with_nulls(_cast(made.struct, kind["value"].dataType), gone), made.codes()], fields=[columnar.arrow_type(kind).field(i) for i in range(2)])

    if mode == DROPMALFORMED:
        # A list of one value, or of none, exploded: rows are left out in the pass that decodes them. A condition on the error would be pushed below
        # the decoding, and Spark would decode, and do what lies beneath, once for the condition and once more for the value.
        @F.arrow_udf(T.ArrayType(kind["value"].dataType))
        def kept(payload: pa.Array) -> pa.Array:
            both = decoded(payload)
            good = both.field(1).is_null()
            values = both.field(0).filter(good)
            offsets = np.concatenate([[0], np.cumsum(good.to_numpy(zero_copy_only=False))])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=pa.list_(pa.field("element", values.type)))

        return df.withColumn(out, F.explode(kept(_col(column))))

    @F.arrow_udf(kind)
    def run(payload: pa.Array) -> pa.Array:
        return decoded(payload)

    both = df.withColumn("__decoded", run(_col(column)))
    return both.withColumns({out: F.col("__decoded.value"), error: F.col("__decoded.error")}).drop("__decoded")


def encode(column, pool: Pool, message: str, max_depth: int = 6, max_encoded_size: int = (1 << 31) - 1) -> Column:
    """The payload of a struct column. The struct may lack fields, which are then unset; names are those of the schema. A null struct is null.

    Values out of range, two members of one oneof, or more bytes than ``max_encoded_size`` end the query."""
    plan = compile_plan(pool, message, max_depth=max_depth)

    @F.arrow_udf("binary")
    def run(struct: pa.Array) -> pa.Array:
        made = columnar.encode_column(plan, struct)
        sizes = pa.compute.max(pa.compute.binary_length(made)).as_py() if len(made) else 0
        if sizes and sizes > max_encoded_size:
            raise EncodeError(f"a payload of {sizes} bytes")
        return made

    return run(_col(column))


def encoded_size(payload) -> Column:
    return F.octet_length(_col(payload))


def unframe(column, max_message_size: int = (1 << 31) - 1) -> Column:
    """array<binary>: the messages of bytes that hold one length-prefixed message after another. Bytes that break off end the query."""

    @F.arrow_udf("array<binary>")
    def run(raw: pa.Array) -> pa.Array:
        rows = []
        for x in raw.to_pylist():
            if x is None:
                rows.append(None)
                continue
            at, out = 0, []
            while at < len(x):
                one, at = read_delimited(x, at, max_message_size)
                out.append(one)
            rows.append(out)
        return pa.array(rows, pa.list_(pa.binary()))

    return run(_col(column))


# ---------------------------------------------------------------- text


def convert(column, kind: str, one, mode: str = FAILFAST, errors: tuple = (ValueError, KeyError)) -> Column:
    """A Column of ``one`` of every value that isn't null; PERMISSIVE makes what fails null."""

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                out.append(None if v is None else one(v))
            except errors:
                if mode == FAILFAST:
                    raise
                out.append(None)
        return pa.array(out, pa.binary() if kind == "binary" else pa.string())

    return run(_col(column))


def _written(payload, pool: Pool, message: str, write, mode: str) -> Column:
    """Text of payloads by columns: ``write`` has (plan, struct, payloads, which of them have none)."""
    plan = compile_plan(pool, message, cases=False, max_depth=100)

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        made = columnar.decode_column(plan, values)
        if mode == FAILFAST:
            _checked(made, values)
        gone = (made.errors != 0) | values.is_null().to_numpy(zero_copy_only=False)
        return pa.array(write(plan, made.struct, values, gone), pa.string(), mask=gone)

    return run(_col(payload))


def _read(text, pool: Pool, message: str, quick, slow, mode: str, tree: bool) -> Column:
    """Payloads of text: straight to bytes where the message allows it and the text has the usual form, else by way of a message."""
    if not json_columns.can_write(pool, message, json_codec.DEFAULT):
        return convert(text, "binary", lambda s: slow(s).encode(), mode)
    shapes: list[transcode.Shape] = []

    def one(s: str) -> bytes:
        if not shapes:
            shapes.append(transcode.Shape(pool, message, tree))
        try:
            return quick(shapes[0], s)
        except transcode.LEFT:
            return slow(s).encode()

    return convert(text, "binary", one, mode)


def to_json(payload, pool: Pool, message: str, options: json_codec.JsonOptions = json_codec.DEFAULT, mode: str = FAILFAST) -> Column:
    """Protobuf JSON of a payload: by columns where the message has neither recursion, special types nor extensions, else row by row."""
    if not json_columns.can_write(pool, message, options):
        return convert(payload, "string", lambda raw: json_codec.to_json(Message.decode(pool, message, raw), options), mode)
    return _written(payload, pool, message, lambda plan, struct, *_: json_columns.write(pool, plan, struct, options), mode)


def from_json(text, pool: Pool, message: str, options: json_codec.JsonOptions = json_codec.DEFAULT, mode: str = FAILFAST) -> Column:
    """The payload of protobuf JSON."""
    return _read(text, pool, message, transcode.from_json, lambda s: json_codec.from_json(pool, message, s, options), mode, True)


def to_text(payload, pool: Pool, message: str, pretty: bool = False, unknown: bool = False, mode: str = FAILFAST) -> Column:
    """Text format of a payload, by columns or row by row as JSON; with unknown fields row by row."""
    if unknown or not json_columns.can_write(pool, message, json_codec.DEFAULT):
        return convert(payload, "string", lambda raw: text_codec.to_text(Message.decode(pool, message, raw), pretty, unknown), mode)
    return _written(payload, pool, message, lambda plan, struct, *_: text_columns.text(pool, plan, struct, pretty), mode)


def from_text(text, pool: Pool, message: str, mode: str = FAILFAST) -> Column:
    return _read(text, pool, message, transcode.from_text, lambda s: text_codec.from_text(pool, message, s), mode, False)


def to_yaml(payload, pool: Pool, message: str, options: json_codec.JsonOptions = json_codec.DEFAULT, mode: str = FAILFAST) -> Column:
    """YAML of a payload, by columns or row by row as JSON; rows with text of several lines go row by row."""

    def one(raw: bytes) -> str:
        return yaml_codec.to_yaml(Message.decode(pool, message, raw), options)

    if not json_columns.can_write(pool, message, options):
        return convert(payload, "string", one, mode)

    def write(plan, struct, values: pa.Array, gone) -> list[str]:
        yaml_codec._need()
        rows = text_columns.yaml(pool, plan, struct, options)
        for i, row in enumerate(rows):
            if text_columns.BY_ROW in row and not gone[i]:
                rows[i] = one(values[i].as_py())
        return rows

    return _written(payload, pool, message, write, mode)


def from_yaml(text, pool: Pool, message: str, options: json_codec.JsonOptions = json_codec.DEFAULT, mode: str = FAILFAST) -> Column:
    return _read(text, pool, message, transcode.from_yaml, lambda s: yaml_codec.from_yaml(pool, message, s, options), mode, True)


def to_variant(payload, pool: Pool, message: str = "google.protobuf.Struct") -> Column:
    """A Struct, Value or ListValue payload, or any other by its JSON, as a variant."""
    return F.parse_json(to_json(payload, pool, message))


def repack(payload, pool: Pool, message: str, options: Options = DEFAULT) -> Column:
    """The payload decoded and encoded again: fields by number, merged, unknown ones last."""
    return convert(payload, "binary", lambda raw: Message.decode(pool, message, raw, options).encode())


def repack(payload, pool: Pool, message: str, options: Options = DEFAULT) -> Column:
    """The payload decoded and encoded again: fields by number, merged, unknown ones last."""
    return convert(payload, "binary", lambda raw: Message.decode(pool, message, raw, options).encode())


def text_to_timestamp(text, mode: str = FAILFAST) -> Column:
    """struct<seconds, nanos> of RFC 3339 text."""

    @F.arrow_udf("struct<seconds:bigint,nanos:int>")
    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                out.append(None if v is None else dict(zip(("seconds", "nanos"), wkt.parse_timestamp(v))))
            except wkt.BadText:
                if mode == FAILFAST:
                    raise
                out.append(None)
        return pa.array(out, pa.struct([("seconds", pa.int64()), ("nanos", pa.int32())]))

    return run(_col(text))


# ---------------------------------------------------------------- Any


def any_pack(payload, message: str, prefix: str = "type.googleapis.com/") -> Column:
    return F.struct(F.lit(prefix + message).alias("type_url"), _col(payload).alias("value"))


def dynamic_type(any_column) -> Column:
    """The message name of an Any: what follows the last slash of its URL; null without a slash."""
    url = _col(any_column)["type_url"]
    return F.when(url.contains("/"), F.substring_index(url, "/", -1))


def any_unpack(any_column, pool: Pool, message: str, **how) -> Column:
    """The struct of an Any of that message; null for others."""
    c = _col(any_column)
    return decode(F.when(dynamic_type(c) == message, c["value"]), pool, message, **how)


def any_is(any_column, message: str) -> Column:
    return F.coalesce(dynamic_type(any_column) == message, F.lit(False))
