"""Pools: linking, lookups, errors, features, defaults, MessageSets."""

import pickle

import pytest

from tests.schemas import PROTO2, PROTO3, SET
from wirelake.kernels.message import Message, Options
from wirelake.schema import EnumDef, FieldDef, FileDef, MessageDef, Pool, SchemaError, build
from wirelake.schema.pool import c_unescape

F = FieldDef


def code(*files):
    with pytest.raises(SchemaError) as e:
        Pool(build(*files))
    return e.value.code


def one(*fields, **more):
    return FileDef("f.proto", "p", [MessageDef("M", list(fields), **more)])


def test_lookups_and_catalogs(spark):
    p = pickle.loads(pickle.dumps(Pool(SET)))
    assert p.message("t3.Leaf").by_number[2].name == "name"
    assert p.message("t3.All").field_named("fInt32").number == 1
    assert p.file_containing("t2.Old").name == "t2.proto" and p.file_containing("t2.ext_int").name == "t2.proto" and p.file_containing("x") is None
    assert p.extension_for("t2.Old", 100).name == "ext_int" and [x.number for x in p.extensions_of("t2.Old")] == [100, 101, 102]
    assert p.is_recursive("t3.All") and not p.is_recursive("t3.Leaf")
    assert p.services["t2.Find"].methods[0].server_streaming
    assert p.fields_df(spark).where("message = 't3.Leaf'").count() == 3
    assert p.enums_df(spark).where("enum = 't3.Color' and number = -1").first().value == "DARK"
    assert p.messages_df(spark).where("recursive").count() >= 1 and p.services_df(spark).count() == 1 and p.extensions_df(spark).count() == 4


def test_adding_is_idempotent_and_all_or_nothing():
    p = Pool(build(PROTO3))
    p.add(build(PROTO3))
    with pytest.raises(SchemaError, match="DUPLICATE_FILE"):
        p.add(build(FileDef("t3.proto", "other", [])))
    with pytest.raises(SchemaError, match="UNKNOWN_TYPE"):
        p.add(build(FileDef("new.proto", "n", [MessageDef("Fine", [])]), FileDef("bad.proto", "n", [MessageDef("M", [F("a", 1, "message:Nope")])])))
    assert "new.proto" not in p.files and "n.Fine" not in p.messages
    p.add(build(PROTO2))
    assert "t2.Old" in p.messages


def test_link_errors():
    assert code(one(F("a", 1, "message:Nope"))) == "UNKNOWN_TYPE"
    assert code(one(F("a", 0, "int32"))) == "BAD_FIELD_NUMBER"
    assert code(one(F("a", 19500, "int32"))) == "BAD_FIELD_NUMBER"
    assert code(one(F("a", 1, "int32"), F("b", 1, "int32"))) == "DUPLICATE_FIELD_NUMBER"
    assert code(one(F("a", 1, "int32"), F("a", 2, "int32"))) == "DUPLICATE_FIELD_NAME"
    assert code(FileDef("f.proto", "p", [], [EnumDef("E", {})])) == "EMPTY_ENUM"
    assert code(FileDef("f.proto", "p", [], [EnumDef("E", {"A": 1})])) == "OPEN_ENUM_NOT_ZERO"
    assert code(FileDef("f.proto", "p", [MessageDef("M", []), MessageDef("M", [])])) == "DUPLICATE_SYMBOL"
    assert code(FileDef("f.proto", "p", [], dependencies=["no.proto"])) == "MISSING_DEPENDENCY"
    assert code(FileDef("f.proto", "p", [MessageDef("M", [])], extensions=[("M", F("x", 5, "int32"))])) == "NOT_IN_EXTENSION_RANGE"
    assert code(one(F("a", 1, "int32", default="z"))) == "BAD_DEFAULT"
    assert code(one(F("a", 1, "map:double,int32"))) == "BAD_MAP_ENTRY"
    with pytest.raises(SchemaError, match="BAD_DESCRIPTOR_SET"):
        Pool(b"\x0a\xff")


def test_features_and_presence():
    p = Pool(SET)
    assert p.message("t3.All").by_name["f_int32"].presence == "implicit" and p.message("t3.All").by_name["o_int32"].presence == "explicit"
    assert p.message("t3.All").by_name["r_int32"].packed and not p.message("t3.All").by_name["loose"].packed
    assert p.message("t2.Old").by_name["need"].presence == "required" and not p.message("t2.Old").by_name["kinds"].packed and p.enums["t2.Kind"].closed
    e = Pool(build(FileDef("e.proto", "e", [MessageDef("M", [F("a", 1, "int32"), F("b", 2, "int32", features={1: 2}), F("c", 3, "message:M", features={5: 2}), F("d", 4, "int32", repeated=True, features={3: 2})])], [EnumDef("C", {"X": 1}, features={2: 2})], edition=1000)))
    m = e.message("e.M")
    assert m.by_name["a"].presence == "explicit" and m.by_name["b"].presence == "implicit" and m.by_name["c"].delimited and not m.by_name["d"].packed and e.enums["e.C"].closed
    assert Message.from_dict(e, "e.M", {"a": 0, "b": 0, "c": {"a": 1}, "d": [1]}).encode().hex() == "08001b08011c2001"


def test_defaults_and_required():
    m = Message(Pool(SET), Pool(SET).message("t2.Old"))
    assert m.get("need") == 7 and m.get("name") == "x\\ty" and m.get("kind") == 0 and not m.has("need")
    assert m.encode().hex() == "0807"
    assert c_unescape(r"\x41\101\né\U0001f600") == b"AA\n" + "é😀".encode()
    for bad in ("\\", "\\x", "\\400", "\\ud800", "\\q"):
        with pytest.raises(ValueError):
            c_unescape(bad)


def test_message_sets():
    p = Pool(SET)
    inner = Message.from_dict(p, "t2.Old", {"need": 4})
    m = Message(p, p.message("t2.Set"))
    m.unknown.append((10, 2, inner.encode()))
    raw = m.encode()
    assert raw.hex() == "0b100a1a0208040c"
    again = Message.decode(p, "t2.Set", raw, Options(message_set=True))
    assert again.extension("t2.in_set").get("need") == 4
    assert Message.decode(p, "t2.Set", raw).unknown[0][0] == 1


def test_feature_overrides():
    p = Pool(SET, {"t3.Leaf.id": {"presence": "explicit"}, "t3.Color": {"enum": "closed"}, "t3.All.r_int32": {"repeated": "expanded"}})
    assert p.message("t3.Leaf").by_name["id"].presence == "explicit" and p.message("t3.Leaf").by_name["name"].presence == "implicit"
    assert p.enums["t3.Color"].closed and not p.message("t3.All").by_name["r_int32"].packed
    assert Message.from_dict(p, "t3.Leaf", {"id": 0}).encode().hex() == "0800"


def test_options_are_messages():
    from google.protobuf import descriptor_pb2

    from wirelake.kernels.message import options_of
    from wirelake.schema.wire import record_bytes

    f = descriptor_pb2.FileDescriptorProto(name="o.proto", package="o", dependency=["google/protobuf/descriptor.proto"], syntax="proto2")
    f.extension.add(name="mark", number=50_000, label=1, type=9, extendee=".google.protobuf.FieldOptions")
    field = f.message_type.add(name="M").field.add(name="a", number=1, label=1, type=5)
    field.options.deprecated = True
    field.options.MergeFromString(record_bytes(50_000, 2, b"seen"))
    p = Pool(record_bytes(1, 2, descriptor_pb2.DESCRIPTOR.serialized_pb) + record_bytes(1, 2, f.SerializeToString()))
    options = options_of(p, p.message("o.M").by_name["a"])
    assert options.get("deprecated") is True and options.extension("o.mark") == "seen"
    assert options_of(Pool(SET), Pool(SET).message("t3.Leaf")) is None
