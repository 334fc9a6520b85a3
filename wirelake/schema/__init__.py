"""Schemas: descriptor sets, linked pools, resolved features, Spark types."""

from .builder import EnumDef, FieldDef, FileDef, MessageDef, OneofDef, build
from .pool import Pool, SchemaError

__all__ = ["EnumDef", "FieldDef", "FileDef", "MessageDef", "OneofDef", "Pool", "SchemaError", "build"]
