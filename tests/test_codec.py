"""Both codecs against each other and against google.protobuf on random messages; fixed wire vectors."""

import random

import numpy as np
import pyarrow as pa
import pytest
from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

from tests.schemas import SCALARS, SET
from wirelake.kernels import columnar
from wirelake.kernels.message import Message, Options
from wirelake.plans import compile_plan
from wirelake.schema import Pool
from wirelake.schema.wire import DecodeError

POOL = Pool(SET)


@pytest.fixture(scope="module")
def classes():
    pool = descriptor_pool.DescriptorPool()
    for f in descriptor_pb2.FileDescriptorSet.FromString(SET).file:
        pool.Add(f)
    return {n: message_factory.GetMessageClass(pool.FindMessageTypeByName(n)) for n in ("t3.All", "t3.Leaf", "t2.Old")}


INTS = {"int32": (-(1 << 31), (1 << 31) - 1), "int64": (-(1 << 63), (1 << 63) - 1), "uint32": (0, (1 << 32) - 1), "uint64": (0, (1 << 64) - 1)}
for a, b in (("sint32", "int32"), ("sfixed32", "int32"), ("sint64", "int64"), ("sfixed64", "int64"), ("fixed32", "uint32"), ("fixed64", "uint64")):
    INTS[a] = INTS[b]


def scalar(r, kind):
    if kind in INTS:
        low, high = INTS[kind]
        return r.choice([0, 1, low, high, r.randint(low, high), r.randint(max(low, -300), 300)])
    return {"float": lambda: float(np.float32(r.choice([0.0, -0.0, 1.5, r.random() * 1e9]))), "double": lambda: r.choice([0.0, -0.0, r.random(), 1e300]), "bool": lambda: r.random() < 0.5, "string": lambda: r.choice(["", "a", "é中😀", "x" * r.randint(0, 200)]), "bytes": lambda: bytes(r.randrange(256) for _ in range(r.randint(0, 20)))}[kind]()


def fill(r, m, depth=0):
    for s in SCALARS:
        if r.random() < 0.4:
            setattr(m, "f_" + s, scalar(r, s))
        if r.random() < 0.3:
            setattr(m, "o_" + s, scalar(r, s))
        if r.random() < 0.3:
            getattr(m, "r_" + s).extend(scalar(r, s) for _ in range(r.randint(0, 4)))
    if depth < 2 and r.random() < 0.4:
        fill(r, m.child, depth + 1)
    for _ in range(r.randint(0, 3)):
        k = m.kids.add()
        k.id, k.name = r.randint(-5, 5), r.choice(["", "n"])
        k.tags.extend(["t"] * r.randint(0, 2))
    if r.random() < 0.5:
        m.leaf.name = "leaf"
    m.color = r.choice([0, 1, 2, -1, 77])
    m.colors.extend(r.choice([0, 1, 5]) for _ in range(r.randint(0, 3)))
    for _ in range(r.randint(0, 3)):
        m.counts[r.choice("abc")] = r.randint(-3, 3)
        m.leaves[r.randint(0, 3)].id = r.randint(0, 9)
        m.flags[r.random() < 0.5] = r.choice([0, 1])
    r.choice([lambda: None, lambda: setattr(m, "pick_int", r.randint(0, 3)), lambda: setattr(m, "pick_text", ""), lambda: setattr(m.pick_leaf, "id", 3)])()
    m.loose.extend(range(r.randint(0, 3)))
    return m


def plain(m):
    """What google.protobuf says of a message, as our struct would have it."""
    out = {}
    for f in m.DESCRIPTOR.fields:
        v = getattr(m, f.name)
        if f.message_type is not None and f.message_type.GetOptions().map_entry:
            out[f.name] = sorted((k, plain(v[k]) if f.message_type.fields_by_name["value"].message_type else v[k]) for k in v)
        elif f.is_repeated:
            out[f.name] = [plain(x) if f.message_type else x for x in v]
        elif f.message_type:
            out[f.name] = plain(v) if m.HasField(f.name) else None
        else:
            out[f.name] = v if not f.has_presence or m.HasField(f.name) else None
    return out


def ours(row, plan):
    """Our struct in the same form."""
    out = {}
    for f in plan.fields:
        v = row[f.name]
        if f.desc.is_map:
            out[f.name] = sorted((k, ours(x, f.child.fields[1].child) if isinstance(x, dict) else x) for k, x in v)
        elif f.desc.repeated:
            out[f.name] = [ours(x, f.child) if f.child else _int(x) for x in v]
        else:
            out[f.name] = ours(v, f.child) if isinstance(v, dict) and f.child else _int(v)
    return out


def _int(v):
    from decimal import Decimal

    return int(v) if isinstance(v, Decimal) else v


def bits(v):
    return repr(v)


def test_random_messages_decode_like_google(classes):
    r = random.Random(1)
    made = [fill(r, classes["t3.All"]()) for _ in range(300)]
    raw = [m.SerializeToString() for m in made]
    plan = compile_plan(POOL, "t3.All", max_depth=6)
    got = columnar.decode_column(plan, pa.array(raw))
    assert not got.errors.any()
    for m, row, payload in zip(made, got.struct.to_pylist(), raw):
        assert bits(ours(row, plan)) == bits(plain(m))
        assert row["pick_case"] == m.WhichOneof("pick")
        assert classes["t3.All"].FromString(Message.decode(POOL, "t3.All", payload).encode()) == m


def test_encoding_decodes_to_the_same(classes):
    r = random.Random(2)
    made = [fill(r, classes["t3.All"]()) for _ in range(200)]
    plan = compile_plan(POOL, "t3.All", max_depth=6)
    struct = columnar.decode_column(plan, pa.array([m.SerializeToString() for m in made])).struct
    for m, payload in zip(made, columnar.encode_column(plan, struct).to_pylist()):
        assert classes["t3.All"].FromString(payload) == m


def test_merging_is_decoding_one_after_another(classes):
    r = random.Random(3)
    pairs = [(fill(r, classes["t3.All"]()), fill(r, classes["t3.All"]())) for _ in range(100)]
    plan = compile_plan(POOL, "t3.All", max_depth=6)
    got = columnar.decode_column(plan, pa.array([a.SerializeToString() + b.SerializeToString() for a, b in pairs])).struct.to_pylist()
    for (a, b), row in zip(pairs, got):
        whole = classes["t3.All"].FromString(a.SerializeToString() + b.SerializeToString())
        assert bits(ours(row, plan)) == bits(plain(whole))


def test_broken_payloads_fail_alike(classes):
    """Truncated and changed payloads: both codecs accept or reject the same ones, and what is accepted is equal."""
    r = random.Random(4)
    payloads = []
    for _ in range(400):
        raw = bytearray(fill(r, classes["t3.All"](), 1).SerializeToString())
        if raw and r.random() < 0.5:
            raw = raw[: r.randrange(len(raw))]
        for _ in range(r.randint(0, 2)):
            if raw:
                raw[r.randrange(len(raw))] = r.randrange(256)
        payloads.append(bytes(raw))
    plan = compile_plan(POOL, "t3.All", max_depth=6)
    got = columnar.decode_column(plan, pa.array(payloads))
    for raw, row, code in zip(payloads, got.struct.to_pylist(), got.errors):
        try:
            m = Message.decode(POOL, "t3.All", raw)
        except DecodeError:
            assert code, raw.hex()
            continue
        assert not code, (raw.hex(), columnar.CODES[code])
        assert bits(ours(row, plan)) == bits(ours(columnar.decode_column(plan, pa.array([m.encode()])).struct.to_pylist()[0], plan))


VECTORS = [("f_int32", -1, "08ffffffffffffffffff01"), ("f_int64", 300, "10ac02"), ("f_uint64", 2**64 - 1, "20ffffffffffffffffff01"), ("f_sint32", -1, "2801"), ("f_sint64", -(2**63), "30ffffffffffffffffff01"), ("f_fixed32", 1, "3d01000000"), ("f_float", 1.5, "5d0000c03f"), ("f_double", -0.0, "610000000000000080"), ("f_double", 0.0, ""), ("f_bool", True, "6801"), ("f_string", "é", "7202c3a9"), ("f_bytes", b"\xfb\xff", "7a02fbff")]


@pytest.mark.parametrize("name,value,hexed", VECTORS)
def test_wire_vectors(name, value, hexed):
    assert Message.from_dict(POOL, "t3.All", {name: value}).encode().hex() == hexed
    plan = compile_plan(POOL, "t3.All", [name])
    struct = columnar.decode_column(plan, pa.array([bytes.fromhex(hexed)])).struct
    assert repr(_int(struct.to_pylist()[0][name])) == repr(value)
    assert columnar.encode_column(plan, struct).to_pylist()[0].hex() == hexed


def test_decode_only_vectors():
    plan = compile_plan(POOL, "t3.All", ["f_int32", "f_bool", "counts"], unknown=True)
    rows = columnar.decode_column(plan, pa.array([bytes.fromhex(x) for x in ("08ffffffff1f", "6802", "0d01000000", "aa01050a01611001aa01050a01611002")])).struct.to_pylist()
    assert rows[0]["f_int32"] == -1 and rows[1]["f_bool"] is True and rows[2]["f_int32"] == 0 and rows[3]["counts"] == [("a", 2)]
    assert [u["number"] for u in rows[2]["_unknown"]] == [1]
    again = columnar.encode_column(plan, columnar.decode_column(plan, pa.array([bytes.fromhex("0d01000000")])).struct)
    assert again.to_pylist()[0].hex() == "0d01000000"


def test_closed_enums_groups_and_extensions():
    raw = Message.from_dict(POOL, "t2.Old", {"need": 1, "box": {"a": 5}, "boxes": [{"b": "x"}, {"b": "y"}], "packed": [-1, 2]})
    raw.set_extension("t2.ext_int", 9)
    raw.set_extension("t2.ext_list", [-3, 4])
    data = raw.encode() + bytes.fromhex("1805" + "2001" + "2005" + "2a050a01611009")
    m = Message.decode(POOL, "t2.Old", data)
    assert m.get("box").get("a") == 5 and [b.get("b") for b in m.get("boxes")] == ["x", "y"] and m.get("packed") == [-1, 2]
    assert not m.has("kind") and m.get("kinds") == [1] and m.get("by_key") == {}
    assert m.extension("t2.ext_int") == 9 and m.extension("t2.ext_list") == [-3, 4] and m.has("[t2.ext_int]")
    plan = compile_plan(POOL, "t2.Old", unknown=True)
    got = columnar.decode_column(plan, pa.array([data]))
    row = got.struct.to_pylist()[0]
    assert row["box"]["a"] == 5 and row["kinds"] == [1] and row["kind"] is None and row["name"] is None
    assert sorted(u["number"] for u in row["_unknown"]) == sorted(u[0] for u in m.unknown)
    assert Message.decode(POOL, "t2.Old", columnar.encode_column(plan, got.struct).to_pylist()[0]).extension("t2.ext_list") == [-3, 4]


def test_limits():
    deep = b""
    for _ in range(120):
        deep = bytes.fromhex("8201") + bytes(columnar.one_varint(len(deep))) + deep
    with pytest.raises(DecodeError, match="RECURSION_LIMIT"):
        Message.decode(POOL, "t3.All", deep)
    plan = compile_plan(POOL, "t3.All", ["f_int32"])
    many = bytes.fromhex("f83f01") * 5
    assert columnar.decode_column(plan, pa.array([many]), Options(unknown_field_limit=4)).codes().to_pylist() == ["UNKNOWN_FIELD_LIMIT"]
    assert columnar.decode_column(plan, pa.array([many]), Options(max_message_size=3)).codes().to_pylist() == ["MESSAGE_TOO_LARGE"]
    assert columnar.decode_column(plan, pa.array([bytes.fromhex("0d01000000")]), Options(strict_wire_type=True)).codes().to_pylist() == ["WIRE_TYPE_MISMATCH"]
    with pytest.raises(DecodeError, match="ELEMENT_MEMORY_LIMIT"):
        Message.decode(POOL, "t3.All", bytes.fromhex("d8010a") * 50, Options(element_memory_limit=500))


def test_shallow_and_pruned():
    m = Message.from_dict(POOL, "t3.All", {"leaf": {"id": 3, "name": "n"}, "kids": [{"id": 1}, {"id": 2}], "f_int32": 4})
    shallow = columnar.decode_column(compile_plan(POOL, "t3.All", shallow=True), pa.array([m.encode()])).struct.to_pylist()[0]
    assert Message.decode(POOL, "t3.Leaf", shallow["leaf"]).get("name") == "n" and len(shallow["kids"]) == 2
    pruned = columnar.decode_column(compile_plan(POOL, "t3.All", ["leaf.id", "f_int32"]), pa.array([m.encode()])).struct.to_pylist()[0]
    assert pruned == {"f_int32": 4, "leaf": {"id": 3}}


def test_empty_and_null_columns():
    plan = compile_plan(POOL, "t3.Leaf")
    assert len(columnar.decode_column(plan, pa.array([], pa.binary())).struct) == 0
    assert len(columnar.encode_column(plan, columnar.decode_column(plan, pa.array([], pa.binary())).struct)) == 0
    assert columnar.decode_column(plan, pa.array([None, b""], pa.binary())).struct.to_pylist()[1]["id"] == 0


@pytest.mark.parametrize("name", ["t3.All", "t2.Old"])
def test_random_bytes(name):
    """Both codecs take and refuse the same bytes, and what they take they write alike, unknown fields included."""
    r = random.Random(9)
    payloads = [bytes(r.choice([8, 10, 16, 18, 0, 1, 2, 3, 255, 128, 130, 138, r.randrange(256)]) for _ in range(r.randint(0, 30))) for _ in range(5000)]
    plan = compile_plan(POOL, name, unknown=True)
    got = columnar.decode_column(plan, pa.array(payloads))
    for raw, code, again in zip(payloads, got.errors, columnar.encode_column(plan, got.struct).to_pylist()):
        try:
            m = Message.decode(POOL, name, raw)
        except DecodeError:
            assert code, raw.hex()
            continue
        assert not code, raw.hex()
        assert Message.decode(POOL, name, again) == Message.decode(POOL, name, m.encode())
