"""YAML of dynamic messages: the JSON model in YAML's clothes. Needs PyYAML; without it these functions say so."""

from __future__ import annotations

from ..schema.pool import Pool
from . import json_codec
from .message import Message

try:
    import yaml
except ImportError:  # pragma: no cover
    yaml = None


#: Plain words that are no strings, in lower case.
WORDS = frozenset(("true", "false", "yes", "no", "on", "off", "null"))


class YamlError(ValueError):
    """Text that is no YAML of the message."""


def _need() -> None:
    if yaml is None:
        raise YamlError("PyYAML isn't installed")


def to_yaml(m: Message, options: json_codec.JsonOptions = json_codec.DEFAULT) -> str:
    _need()
    return dump(_plain(json_codec.parse_text(json_codec.to_json(m, options))))


def dump(tree) -> str:
    return yaml.safe_dump(tree, sort_keys=False, allow_unicode=True, default_flow_style=False, width=1 << 30)


def _plain(tree):
    if isinstance(tree, json_codec._Pairs):
        return {k: _plain(v) for k, v in tree}
    if isinstance(tree, list):
        return [_plain(v) for v in tree]
    if isinstance(tree, json_codec.Number):
        return int(tree) if tree.lstrip("-").isdigit() else float(tree)
    return tree


def from_yaml(pool: Pool, name: str, text: str | bytes, options: json_codec.JsonOptions = json_codec.DEFAULT) -> Message:
    """Plain scalars are strings until a field's type is known, so long numbers and time stamps stay as written. Anchors may be used, tags not."""
    _need()
    try:
        node = yaml.compose(text, Loader=yaml.SafeLoader)
    except yaml.YAMLError as e:
        raise YamlError(str(e)) from e
    if node is None:
        return Message(pool, pool.message(name))
    return json_codec.from_tree(pool, name, _tree(node, 100), options)


def _tree(node, depth: int):
    if depth <= 0:
        raise YamlError("nested too deeply")
    if isinstance(node, yaml.MappingNode):
        return json_codec._Pairs((_key(k), _tree(v, depth - 1)) for k, v in node.value)
    if isinstance(node, yaml.SequenceNode):
        return [_tree(v, depth - 1) for v in node.value]
    kind = node.tag.rpartition(":")[2]
    if kind == "null":
        return None
    if kind == "bool":
        return node.value.lower() in ("true", "yes", "on")
    if kind in ("int", "float"):
        special = {".nan": "NaN", ".inf": "Infinity", "+.inf": "Infinity", "-.inf": "-Infinity"}.get(node.value.lower())
        return special or json_codec.Number(node.value.lstrip("+").replace("_", ""))
    if kind in ("str", "timestamp"):
        return node.value
    raise YamlError(f"tag {node.tag}")


def _key(node) -> str:
    if not isinstance(node, yaml.ScalarNode):
        raise YamlError("a key that is no scalar")
    return {"True": "true", "False": "false", "yes": "true", "no": "false"}.get(node.value, node.value) if node.tag.endswith(":bool") else node.value
