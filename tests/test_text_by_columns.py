"""Text format, YAML and JSON by columns and straight to payloads: the same as by messages, whatever the text."""

import random

import pyarrow as pa
import pytest
from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
from pyspark.sql import functions as F

from tests.schemas import SET
from tests.test_codec import fill
from wirelake import operators as op
from wirelake import tables
from wirelake.kernels import columnar, json_codec, text_codec, text_columns, transcode, yaml_codec
from wirelake.kernels.json_codec import JsonOptions
from wirelake.kernels.message import Message
from wirelake.plans import compile_plan
from wirelake.schema import Pool

POOL = Pool(SET)
READERS = {
    "text": (transcode.from_text, lambda s: text_codec.from_text(POOL, "t3.Flat", s), False),
    "json": (transcode.from_json, lambda s: json_codec.from_json(POOL, "t3.Flat", s), True),
    "yaml": (transcode.from_yaml, lambda s: yaml_codec.from_yaml(POOL, "t3.Flat", s), True),
}


@pytest.fixture(scope="module")
def messages():
    pool = descriptor_pool.DescriptorPool()
    for f in descriptor_pb2.FileDescriptorSet.FromString(SET).file:
        pool.Add(f)
    made = message_factory.GetMessageClass(pool.FindMessageTypeByName("t3.All"))
    r = random.Random(9)
    raw = [fill(r, made(), 2).SerializeToString() for _ in range(80)] + [b""]
    odd = ["", "true", "No", "null", "5", "-0", "007", "1.5", "1e5", "a b", " a", "a ", "a: b", "- a", "a #b", "#", "'", '"', "it's", "\\", "\n", "a\nb", " ", "é", "日本", "\x00", "\x7f", "~", "=", "2024-01-01", "[]", "{}", "&a", "*a", "!a", "x" * 200, "﻿", "😀"]
    for i in range(60):
        m = Message.from_dict(POOL, "t3.Flat", {"f_int32": i, "f_double": i / 7, "counts": {"a": i, "b": -i}, "leaf": {"id": i, "name": "x y"}, "kids": [{"id": 1, "tags": ["a", "5"]}, {}, {"name": "true"}], "r_sint64": [-i, 2], "o_bool": i % 2 == 0, "color": 1, "pick_leaf": {}})
        raw.append(m.encode())
    for s in odd:
        m = Message(POOL, POOL.message("t3.Flat"))
        for k, v in {"f_string": s, "r_string": [s, "x", s], "o_bytes": s.encode(), "counts": {s: 1, "z": 0}, "leaf": {"name": s}, "kids": [{"name": s, "tags": [s]}, {}], "leaves": {-1: {"name": s}, 2: {}}, "flags": {True: 1, False: 9}, "pick_text": s, "color": -1, "f_double": -0.0, "r_double": [1e16, -1e-7, float("nan"), float("inf")], "r_float": [0.1, 1e20, float("-inf")], "o_uint64": 2**64 - 1, "o_int32": 0}.items():
            m.set(k, v)
        raw.append(m.encode())
    return raw


def test_writers_by_columns_write_what_row_codecs_write(messages):
    plan = compile_plan(POOL, "t3.Flat", cases=False)
    struct = columnar.decode_column(plan, pa.array(messages)).struct
    rows = [Message.decode(POOL, "t3.Flat", x) for x in messages]
    for pretty in (False, True):
        assert text_columns.text(POOL, plan, struct, pretty) == [text_codec.to_text(m, pretty) for m in rows]
    for options in (JsonOptions(), JsonOptions(proto_names=True, numbers_for_enums=True)):
        left = 0
        for got, m in zip(text_columns.yaml(POOL, plan, struct, options), rows):
            left += text_columns.BY_ROW in got
            assert text_columns.BY_ROW in got or got == yaml_codec.to_yaml(m, options)
        assert left < len(rows) * 0.8


def _result(read, text):
    try:
        return read(text)
    except ValueError as e:
        return type(e), str(e)


@pytest.mark.parametrize("form", READERS)
def test_quick_readers_read_what_row_codecs_read(messages, form):
    quick, slow, tree = READERS[form]
    shape = transcode.Shape(POOL, "t3.Flat", tree)
    write = {"text": text_codec.to_text, "json": json_codec.to_json, "yaml": yaml_codec.to_yaml}[form]
    r, done = random.Random(3), 0
    for raw in messages:
        text = write(Message.decode(POOL, "t3.Flat", raw))
        changed = [text]
        for _ in range(12):
            a, b = sorted(r.randrange(len(text) + 1) for _ in range(2))
            changed.append(text[:a] + r.choice(["", " ", "\n", ":", '"', "'", "-", "0", "7", "e", ".", "{", "}", "[", "]", ",", "#", "null", "true", "  ", "\t", "é", text[a : a + 30], text[b : b + 30]]) + text[a + r.choice([0, 0, 1, 1, 3, b - a]) :])
        for t in changed:
            try:
                got = quick(shape, t)
            except transcode.LEFT:
                continue
            done += 1
            assert got == _result(lambda s: slow(s).encode(), t), t
    assert done > 50


def test_event_texts_take_the_short_way(spark, monkeypatch):
    """The queries' own texts need no message at all: neither to be written nor to be read."""
    spark_rows = tables.events(spark, "/root/testdata/sf0.001").limit(200).collect()
    p = tables.pool()
    raw = [bytes(x.payload) for x in spark_rows]
    plan = compile_plan(p, "tables.Event", cases=False)
    struct = columnar.decode_column(plan, pa.array(raw)).struct
    for read, texts, tree in ((transcode.from_text, text_columns.text(p, plan, struct, False), False), (transcode.from_yaml, text_columns.yaml(p, plan, struct, json_codec.DEFAULT), True)):
        shape = transcode.Shape(p, "tables.Event", tree)
        assert [read(shape, t) for t in texts] == raw


def test_modes_and_odd_rows(spark):
    """Broken and null rows, rows of several lines, and messages that go row by row."""
    p = tables.pool()
    note = Message.from_dict(p, "tables.Event", {"note": "a\nb", "event_id": 3}).encode()
    df = spark.createDataFrame([(0, note), (1, None), (2, note[:-1])], "i int, payload binary")
    for there, back in ((op.to_yaml, op.from_yaml), (op.to_text, op.from_text), (op.to_json, op.from_json)):
        text = df.select("i", there("payload", p, "tables.Event", mode="PERMISSIVE").alias("text"))
        got = text.select("i", "text", back("text", p, "tables.Event").alias("again")).orderBy("i").collect()
        assert bytes(got[0].again) == note and [got[1].text, got[1].again, got[2].text] == [None, None, None]
        with pytest.raises(Exception, match="UNEXPECTED_EOF"):
            df.select(there("payload", p, "tables.Event")).collect()
    bad = spark.createDataFrame([("nonsense: 1",)], "text string")
    assert bad.select(op.from_text("text", p, "tables.Event", mode="PERMISSIVE").alias("x")).first().x is None
    with pytest.raises(Exception, match="has no field nonsense"):
        bad.select(op.from_text(F.col("text"), p, "tables.Event")).collect()
