"""Operators on payload columns and on decoded structs."""

from .codec import any_is, any_pack, any_unpack, convert, decode, decode_frame, dynamic_type, encode, encoded_size, from_json, from_text, from_yaml, repack, text_to_timestamp, to_json, to_text, to_yaml, to_variant, unframe
from .fields import clear_extension, clear_fields, encoded_len, extension_payload, field_by_number, field_or_default, get_extension, has, has_extension, keep_unknown, map_last_wins, merge_by_key, merge_columns, merge_payloads, set_field_names, set_fields, set_paths, unknown_numbers, which_oneof

__all__ = [
    "any_is", "any_pack", "any_unpack", "clear_extension", "clear_fields", "convert", "decode", "decode_frame", "dynamic_type", "encode", "encoded_len", "encoded_size", "extension_payload", "field_by_number", "field_or_default", "from_json", "from_text", "from_yaml", "get_extension", "has", "has_extension", "keep_unknown",
    "map_last_wins", "merge_by_key", "merge_columns", "merge_payloads", "repack", "set_field_names", "set_fields", "set_paths", "text_to_timestamp", "to_json", "to_text", "to_variant", "to_yaml", "unframe", "unknown_numbers", "which_oneof",
]
