"""JSON, text format and YAML: choices at the edges, and agreement with google.protobuf."""

import json
import math
import random

import pytest
from google.protobuf import any_pb2, descriptor_pb2, descriptor_pool, duration_pb2, field_mask_pb2, json_format, message_factory, struct_pb2, text_format, timestamp_pb2, wrappers_pb2

from tests.schemas import SET
from tests.test_codec import fill
from wirelake.kernels import json_codec, text_codec, wkt, yaml_codec
from wirelake.kernels.json_codec import JsonError, JsonOptions
from wirelake.kernels.message import Message
from wirelake.schema import Pool
from wirelake.schema.wire import record_bytes

WKT_FILES = [m.DESCRIPTOR.serialized_pb for m in (any_pb2, duration_pb2, field_mask_pb2, struct_pb2, timestamp_pb2, wrappers_pb2)]
POOL = Pool(SET).add(b"".join(record_bytes(1, 2, f) for f in WKT_FILES))


@pytest.fixture(scope="module")
def all_class():
    pool = descriptor_pool.DescriptorPool()
    for f in descriptor_pb2.FileDescriptorSet.FromString(SET).file:
        pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("t3.All"))


def test_json_agrees_with_google(all_class):
    r = random.Random(5)
    for _ in range(60):
        m = fill(r, all_class())
        ours = json_codec.to_json(Message.decode(POOL, "t3.All", m.SerializeToString()))
        assert json_format.Parse(ours, all_class()) == m
        assert json.loads(ours) == json.loads(json_format.MessageToJson(m))
        assert json_codec.from_json(POOL, "t3.All", json_format.MessageToJson(m)).encode() == Message.decode(POOL, "t3.All", m.SerializeToString()).encode()


def test_json_by_columns_is_json_by_rows(all_class):
    import pyarrow as pa

    from wirelake.kernels import columnar, json_columns
    from wirelake.plans import compile_plan

    r = random.Random(8)
    raw = [fill(r, all_class(), 2).SerializeToString() for _ in range(80)] + [b""]
    plan = compile_plan(POOL, "t3.Flat", cases=False)
    for options in (JsonOptions(), JsonOptions(proto_names=True, numbers_for_enums=True)):
        assert json_columns.can_write(POOL, "t3.Flat", options) and not json_columns.can_write(POOL, "t3.All", options) and not json_columns.can_write(POOL, "t2.Old", options)
        got = json_columns.write(POOL, plan, columnar.decode_column(plan, pa.array(raw)).struct, options)
        assert got == [json_codec.to_json(Message.decode(POOL, "t3.Flat", x), options) for x in raw]


def test_text_agrees_with_google(all_class):
    r = random.Random(6)
    for _ in range(60):
        m = fill(r, all_class())
        dynamic = Message.decode(POOL, "t3.All", m.SerializeToString())
        for pretty in (False, True):
            assert text_format.Parse(text_codec.to_text(dynamic, pretty), all_class()) == m
        assert text_codec.from_text(POOL, "t3.All", text_format.MessageToString(m)) == dynamic


def test_yaml_round_trip(all_class):
    r = random.Random(7)
    for _ in range(40):
        m = Message.decode(POOL, "t3.All", fill(r, all_class()).SerializeToString())
        assert yaml_codec.from_yaml(POOL, "t3.All", yaml_codec.to_yaml(m)) == m


@pytest.mark.parametrize(
    "text,field,value",
    [
        ('{"fInt32":"1e3"}', "f_int32", 1000), ('{"fInt32":5.0}', "f_int32", 5), ('{"f_int32":1}', "f_int32", 1), ('{"fInt64":"9223372036854775807"}', "f_int64", 2**63 - 1), ('{"fUint64":18446744073709551615}', "f_uint64", 2**64 - 1),
        ('{"fFloat":"Infinity"}', "f_float", math.inf), ('{"fBytes":"-_8"}', "f_bytes", b"\xfb\xff"), ('{"fBytes":"+/8="}', "f_bytes", b"\xfb\xff"), ('{"color":"BLUE"}', "color", 2), ('{"color":9}', "color", 9), ('{"fString":null}', "f_string", ""),
    ],
)
def test_json_accepts(text, field, value):
    assert json_codec.from_json(POOL, "t3.All", text).get(field) == value


@pytest.mark.parametrize(
    "text",
    ['{"fInt32":1.5}', '{"fInt32":2147483648}', '{"fInt32":true}', '{"fUint32":-1}', '{"fBool":1}', '{"fString":1}', '{"color":"MAUVE"}', '{"nope":1}', '{"fInt32":1,"f_int32":2}', '{"pickInt":1,"pickText":"a"}', '{"rInt32":[null]}', '{"counts":{"a":null}}', '{"fFloat":1e60}', '{"fString":"\\ud800"}', "[]", '{"fInt32":01}', '{"fBytes":"a"}', '{"fInt32":NaN}', '{"leaves":{"x":{}}}', "{"],
)
def test_json_rejects(text):
    with pytest.raises(JsonError):
        json_codec.from_json(POOL, "t3.All", text)


def test_json_options():
    assert json_codec.from_json(POOL, "t3.All", '{"nope":1,"fInt32":2}', JsonOptions(ignore_unknown=True)).get("f_int32") == 2
    lenient = json_codec.from_json(POOL, "t3.All", '{"color":"MAUVE","colors":["RED","MAUVE"]}', JsonOptions(ignore_unknown_enums=True))
    assert lenient.get("color") == 0 and lenient.get("colors") == [0]
    m = Message.from_dict(POOL, "t3.Leaf", {"id": 1})
    assert json_codec.to_json(m, JsonOptions(always_print=True)) == '{"id":1,"name":"","tags":[]}'
    assert json_codec.to_json(Message.from_dict(POOL, "t3.All", {"f_int32": 1}), JsonOptions(proto_names=True)) == '{"f_int32":1}'
    assert '"fFloat":0.1' in json_codec.to_json(Message.from_dict(POOL, "t3.All", {"f_float": 0.1}))


def test_well_known_json():
    for name, text, cls in (
        ("Timestamp", '"2024-02-29T12:34:56.789Z"', timestamp_pb2.Timestamp), ("Duration", '"-1.500s"', duration_pb2.Duration), ("FieldMask", '"aB,c.dE"', field_mask_pb2.FieldMask),
        ("Struct", '{"a":[1,"x",null,true,{"b":2.5}]}', struct_pb2.Struct), ("Int64Value", '"5"', wrappers_pb2.Int64Value), ("BoolValue", "true", wrappers_pb2.BoolValue),
    ):
        m = json_codec.from_json(POOL, "google.protobuf." + name, text)
        assert cls.FromString(m.encode()) == json_format.Parse(text, cls())
        assert json_codec.to_json(m) == text


def test_any_json_and_text():
    text = '{"@type":"type.googleapis.com/t3.Leaf","id":3,"name":"n"}'
    m = json_codec.from_json(POOL, "google.protobuf.Any", text)
    assert json_codec.to_json(m) == text
    assert text_codec.to_text(m) == '[type.googleapis.com/t3.Leaf] { id: 3 name: "n" }'
    assert text_codec.from_text(POOL, "google.protobuf.Any", text_codec.to_text(m)) == m
    special = '{"@type":"a/google.protobuf.Duration","value":"1s"}'
    assert json_codec.to_json(json_codec.from_json(POOL, "google.protobuf.Any", special)) == special
    for bad in ('{"@type":"t3.Leaf"}', '{"@type":"a/no.Such"}', '{"id":1}'):
        with pytest.raises(JsonError):
            json_codec.from_json(POOL, "google.protobuf.Any", bad)
    assert json_codec.from_json(POOL, "google.protobuf.Any", "{}").encode() == b""
    kept = json_codec.from_json(POOL, "google.protobuf.Any", '{"@type":"a/no.Such","value":"AQ=="}', JsonOptions(any_as_base64=True))
    assert kept.get("value") == b"\x01"


@pytest.mark.parametrize("seconds,nanos,text", [(0, 0, "1970-01-01T00:00:00Z"), (-1, 0, "1969-12-31T23:59:59Z"), (0, 500_000_000, "1970-01-01T00:00:00.500Z"), (0, 1, "1970-01-01T00:00:00.000000001Z"), (253402300799, 0, "9999-12-31T23:59:59Z"), (-62135596800, 0, "0001-01-01T00:00:00Z")])
def test_timestamps(seconds, nanos, text):
    assert wkt.format_timestamp(seconds, nanos) == text and wkt.parse_timestamp(text) == (seconds, nanos)


@pytest.mark.parametrize("text", ["0000-01-01T00:00:00Z", "2023-02-30T00:00:00Z", "2023-01-01t00:00:00Z", "2023-01-01T00:00:00z", "2023-01-01T00:00:60Z", "2023-13-01T00:00:00Z", "２023-01-01T00:00:00Z", "2023-01-01T00:00:00"])
def test_bad_timestamps(text):
    with pytest.raises(wkt.BadText):
        wkt.parse_timestamp(text)


def test_durations():
    for seconds, nanos, text in ((1, 500_000_000, "1.500s"), (-1, -500_000_000, "-1.500s"), (0, -1, "-0.000000001s")):
        assert wkt.format_duration(seconds, nanos) == text and wkt.parse_duration(text) == (seconds, nanos)
    for bad in ("--1s", "1", "1e3s", "1.s", "315576000001s"):
        with pytest.raises(wkt.BadText):
            wkt.parse_duration(bad)
    with pytest.raises(wkt.BadText):
        wkt.format_duration(1, -1)


def test_text_format_forms():
    text = 'f_int32: 0x10 f_string: "a" \'b\' r_int32: [1, 2] r_int32: 3; leaf < id: 1 > # note\n kids { id: 2, name: "\\303\\251" } f_float: 1.5f f_double: -inf color: BLUE counts { key: "k" value: 4 }'
    m = text_codec.from_text(POOL, "t3.All", text)
    assert (m.get("f_int32"), m.get("f_string"), m.get("r_int32"), m.get("f_float"), m.get("f_double"), m.get("color"), m.get("counts")) == (16, "ab", [1, 2, 3], 1.5, -math.inf, 2, {"k": 4})
    assert m.get("kids")[0].get("name") == "é"
    for bad in ("f_int32: 1 f_int32: 2", "nope: 1", "f_int32 1", "f_string: 1", "color: MAUVE", "leaf {", "f_int32: 09", "pick_int: 1 pick_text: 'a'"):
        with pytest.raises(text_codec.TextError):
            text_codec.from_text(POOL, "t3.All", bad)
    m = Message.decode(POOL, "t3.Leaf", bytes.fromhex("2805"))
    assert text_codec.to_text(m) == "" and text_codec.to_text(m, unknown=True) == "5: 5"


def test_groups_and_extensions_in_text():
    m = text_codec.from_text(POOL, "t2.Old", "need: 1 Box { a: 2 } [t2.ext_int]: 5 [t2.ext_old] { need: 3 }")
    assert m.get("box").get("a") == 2 and m.extension("t2.ext_int") == 5
    again = Message.decode(POOL, "t2.Old", m.encode())
    assert again.extension("t2.ext_old").get("need") == 3
    assert text_codec.to_text(again) == "need: 1 Box { a: 2 } [t2.ext_int]: 5 [t2.ext_old] { need: 3 }"
    assert json_codec.to_json(again) == '{"need":1,"box":{"a":2},"[t2.ext_int]":5,"[t2.ext_old]":{"need":3}}'
    assert json_codec.from_json(POOL, "t2.Old", json_codec.to_json(again)).encode() == again.encode()
