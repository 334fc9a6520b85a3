"""Column expressions: wire primitives and text forms that Catalyst compiles, without Python on the executors."""

from .text import base64_to_bytes, bytes_to_base64, camel_to_snake, days_of, duration_struct, duration_to_text, enum_name, enum_number, json_number, mask_contains, mask_to_text, snake_to_camel, struct_to_timestamp, text_to_duration, text_to_mask, timestamp_struct, timestamp_to_text
from .wire import (
    count_varints, fixed32, fixed64, fixed_field, is_default, length_delimited, string_field, tag, tag_field_number, tag_wire_type, unzigzag32, unzigzag64, varint, varint_field, varint_size, zigzag32, zigzag64,
)

__all__ = [
    "base64_to_bytes", "bytes_to_base64", "camel_to_snake", "count_varints", "days_of", "duration_struct", "duration_to_text", "enum_name", "enum_number", "fixed32", "fixed64", "fixed_field", "is_default", "json_number", "length_delimited", "mask_contains", "mask_to_text",
    "snake_to_camel", "string_field", "struct_to_timestamp", "tag", "tag_field_number", "tag_wire_type", "text_to_duration", "text_to_mask", "timestamp_struct", "timestamp_to_text", "unzigzag32", "unzigzag64", "varint", "varint_field", "varint_size", "zigzag32", "zigzag64",
]
