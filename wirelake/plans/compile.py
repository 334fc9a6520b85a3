"""From a message descriptor and the columns asked for to a plan of plain data, and to a Spark type.

A plan says for each field of a message which column it fills and how. Fields that weren't asked for aren't in
it: the decoder steps over their bytes. Messages below ``max_depth``, or all nested ones of a shallow plan, stay
binary columns, which another decode can open later.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..schema import descriptors as D
from ..schema.pool import Pool

UNKNOWN = "_unknown"
UNKNOWN_TYPE = T.ArrayType(T.StructType([T.StructField("number", T.IntegerType(), False), T.StructField("wire_type", T.IntegerType(), False), T.StructField("varint", T.DecimalType(20, 0)), T.StructField("bytes", T.BinaryType())]), False)
SPARK_SCALARS = {
    D.DOUBLE: T.DoubleType(), D.FLOAT: T.FloatType(), D.INT64: T.LongType(), D.UINT64: T.DecimalType(20, 0), D.INT32: T.IntegerType(), D.FIXED64: T.DecimalType(20, 0), D.FIXED32: T.LongType(),
    D.BOOL: T.BooleanType(), D.STRING: T.StringType(), D.BYTES: T.BinaryType(), D.UINT32: T.LongType(), D.ENUM: T.IntegerType(), D.SFIXED32: T.IntegerType(), D.SFIXED64: T.LongType(),
    D.SINT32: T.IntegerType(), D.SINT64: T.LongType(),
}


@dataclass
class FieldPlan:
    desc: D.FieldDesc
    child: "Plan | None" = None  # of a message that is opened; of the entries of a map
    oneof: int | None = None  # real oneofs only
    closed: frozenset[int] | None = None  # the numbers of a closed enum
    default: object = None
    raw_utf8: bool = False

    @property
    def name(self) -> str:
        return self.desc.name


@dataclass
class Plan:
    message: str
    fields: list[FieldPlan]
    oneofs: dict[int, str]  # those with a case column
    unknown: bool = False
    depth: int = 0
    #: All members of each oneof, asked for or not: one of them ends another.
    members: dict[int, list[int]] = field(default_factory=dict)
    #: Numbers of all fields of the message; the others are unknown.
    known: dict[int, D.FieldDesc] = field(default_factory=dict)
    entry: bool = False

    def columns(self) -> list[tuple[str, object]]:
        """(name, FieldPlan, oneof index or UNKNOWN) in the order of the struct: a oneof's case stands before its first member."""
        out, done = [], set()
        for f in self.fields:
            if f.oneof is not None and f.oneof in self.oneofs and f.oneof not in done:
                done.add(f.oneof)
                out.append((self.oneofs[f.oneof], f.oneof))
            out.append((f.name, f))
        if self.unknown:
            out.append((UNKNOWN, UNKNOWN))
        return out


def _tree(paths) -> dict | None:
    """Dotted paths as nested dicts; None asks for everything below."""
    if paths is None:
        return None
    root: dict = {}
    for path in paths:
        at, parts = root, path.split(".")
        for i, part in enumerate(parts):
            if part in at and at[part] is None:
                break
            if i == len(parts) - 1:
                at[part] = None
            else:
                at = at.setdefault(part, {})
    return root


def compile_plan(pool: Pool, message: str, fields: list[str] | None = None, shallow: bool = False, unknown: bool = False, cases: bool = True, max_depth: int = 6, utf8_as_bytes: bool = False) -> Plan:
    """``fields``: dotted paths of what to decode, all if None. ``cases``: add the column <oneof>_case, the name of the member that is set."""
    return _compile(pool, message, _tree(fields), shallow, unknown, cases, max_depth, 0, utf8_as_bytes)


def _compile(pool, message, tree, shallow, unknown, cases, max_depth, depth, raw) -> Plan:
    desc = pool.message(message)
    if tree is not None:
        for name in tree:
            if desc.field_named(name) is None and name != UNKNOWN:
                raise KeyError(f"{message} has no field {name}")
        unknown = unknown or UNKNOWN in tree
    plan = Plan(desc.full_name, [], {}, unknown, depth, {i: o.fields for i, o in enumerate(desc.oneofs)}, desc.by_number, desc.map_entry)
    for f in desc.fields:
        if tree is not None and f.name not in tree and f.json_name not in tree:
            continue
        below = None if tree is None else tree.get(f.name, tree.get(f.json_name))
        made = FieldPlan(f, raw_utf8=raw and f.utf8 == "none")
        if f.oneof is not None and not desc.oneofs[f.oneof].synthetic:
            made.oneof = f.oneof
            if cases:
                plan.oneofs[f.oneof] = desc.oneofs[f.oneof].name + "_case"
        if f.is_map:
            made.child = _compile(pool, f.type_name, None, shallow, False, cases, max_depth, depth + 1, raw)
        elif f.is_message and not shallow and depth + 1 < max_depth:
            made.child = _compile(pool, f.type_name, below, shallow, unknown and below is None, cases, max_depth, depth + 1, raw)
        if f.type == D.ENUM:
            e = pool.enums[f.type_name]
            made.closed = frozenset(e.by_number) if e.closed else None
            made.default = e.default if f.default is None else f.default
        elif f.default is not None:
            made.default = f.default
        plan.fields.append(made)
    return plan


def spark_type(plan: Plan) -> T.StructType:
    out = []
    for name, what in plan.columns():
        if what == UNKNOWN:
            out.append(T.StructField(name, UNKNOWN_TYPE, False))
        elif isinstance(what, int):
            out.append(T.StructField(name, T.StringType(), True))
        else:
            f = what.desc
            if f.is_map:
                key, value = what.child.fields
                out.append(T.StructField(name, T.MapType(element_type(key), element_type(value), False), False))
            elif f.repeated:
                out.append(T.StructField(name, T.ArrayType(element_type(what), False), False))
            else:
                out.append(T.StructField(name, element_type(what), f.tracks_presence and not plan.entry))
    return T.StructType(out)


def element_type(f: FieldPlan) -> T.DataType:
    if f.desc.is_message:
        return spark_type(f.child) if f.child is not None else T.BinaryType()
    return T.BinaryType() if f.raw_utf8 else SPARK_SCALARS[f.desc.type]
