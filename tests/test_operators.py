"""Operators, functions, sources and streams on Spark."""

import os

import pytest
from pyspark.sql import functions as F

from tests.schemas import SET
from wirelake import functions as fn
from wirelake import operators as op
from wirelake.kernels.message import Message
from wirelake.schema import Pool
from wirelake.schema.wire import varint, zigzag
from wirelake.sources import containers, register, write_containers
from wirelake.streaming import decode_stream, last_by_key

POOL = Pool(SET)
NUMBERS = [0, 1, 127, 128, 255, 300, 16383, 16384, 2**31, 2**62, 2**63 - 1, -1, -300, -(2**63)]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_wire_columns(spark):
    df = spark.createDataFrame([(n,) for n in NUMBERS], "n long")
    got = rows(df.select("n", fn.varint("n"), fn.varint_size("n"), fn.zigzag64("n"), fn.unzigzag64(fn.zigzag64("n")), fn.fixed64("n"), fn.unzigzag32(fn.zigzag32(F.col("n").bitwiseAND(F.lit(0x7FFFFFF)).cast("int")))))
    for n, v, size, z, back, fixed, small in got:
        assert bytes(v) == varint(n) and size == len(varint(n)) and z % 2**64 == zigzag(n) and back == n and bytes(fixed) == (n % 2**64).to_bytes(8, "little")
        assert small == n & 0x7FFFFFF
    packed = b"".join(varint(n) for n in NUMBERS)
    assert spark.range(1).select(fn.count_varints(F.lit(packed))).first()[0] == len(NUMBERS)
    assert spark.range(1).select(fn.is_default(F.lit(-0.0), "double"), fn.is_default(F.lit(0.0), "double")).first()[:] == (False, True)
    with pytest.raises(ValueError):
        fn.tag(0, 1)


def test_text_columns(spark):
    df = spark.createDataFrame([(0, 0), (-1, 0), (0, 500_000_000), (0, 1), (253402300799, 1000), (253402300800, 0), (-62135596800, 0)], "s long, n int")
    assert [r[0] for r in rows(df.select(fn.timestamp_to_text("s", "n")))] == ["1970-01-01T00:00:00Z", "1969-12-31T23:59:59Z", "1970-01-01T00:00:00.500Z", "1970-01-01T00:00:00.000000001Z", "9999-12-31T23:59:59.000001Z", None, "0001-01-01T00:00:00Z"]
    d = spark.createDataFrame([(1, 500_000_000), (-1, -500_000_000), (0, -1), (1, -1)], "s long, n int").withColumn("t", fn.duration_to_text("s", "n"))
    assert [r[0] for r in rows(d.select("t"))] == ["1.500s", "-1.500s", "-0.000000001s", None]
    assert rows(d.where("t is not null").select(F.col("s"), F.col("n"), fn.text_to_duration("t")["seconds"], fn.text_to_duration("t")["nanos"])) == [(1, 500_000_000, 1, 500_000_000), (-1, -500_000_000, -1, -500_000_000), (0, -1, 0, -1)]
    b = spark.createDataFrame([("-_8",), ("+/8=",), ("",)], "t string")
    assert [bytes(r[0]) for r in rows(b.select(fn.base64_to_bytes("t")))] == [b"\xfb\xff", b"\xfb\xff", b""]
    m = spark.createDataFrame([(["a_b", "c.d_e"],), (["aB"],)], "p array<string>")
    assert [r[0] for r in rows(m.select(fn.mask_to_text("p")))] == ["aB,c.dE", None]


def payloads(spark, messages, name="t3.All"):
    return spark.createDataFrame([(i, Message.from_dict(POOL, name, m).encode()) for i, m in enumerate(messages)], "i long, payload binary")


def test_decode_modes(spark):
    df = payloads(spark, [{"f_int32": 1}, {"f_int32": 2}]).withColumn("payload", F.when(F.col("i") == 1, F.expr("substring(payload, 1, 1)")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="UNEXPECTED_EOF"):
        df.select(op.decode("payload", POOL, "t3.All", ["f_int32"])).collect()
    assert rows(df.select(op.decode("payload", POOL, "t3.All", ["f_int32"], mode="PERMISSIVE")["f_int32"])) == [(1,), (None,)]
    assert rows(op.decode_frame(df, "payload", POOL, "t3.All", fields=["f_int32"]).select("_error")) == [(None,), ("UNEXPECTED_EOF",)]
    assert op.decode_frame(df, "payload", POOL, "t3.All", mode="DROPMALFORMED").count() == 1


def test_recursion_stays_binary_below_the_depth(spark):
    df = payloads(spark, [{"child": {"child": {"f_int32": 7}}}])
    v = df.select(op.decode("payload", POOL, "t3.All", ["child", "f_int32"], max_depth=2).alias("v"))
    inner = v.select(op.decode("v.child.child", POOL, "t3.All", ["f_int32"])["f_int32"])
    assert rows(inner) == [(7,)]


def test_presence_and_edits(spark):
    df = payloads(spark, [{"f_double": -0.0, "o_int32": 0, "r_int32": [1], "pick_text": ""}, {}]).select("i", op.decode("payload", POOL, "t3.All").alias("v"))
    names = ["f_double", "o_int32", "r_int32", "f_int32", "leaf", "pick_text"]
    assert rows(df.orderBy("i").select(*[op.has("v", POOL, "t3.All", n) for n in names])) == [(True, True, True, False, False, True), (False,) * 6]
    assert rows(df.orderBy("i").select(op.which_oneof("v", "pick"), op.field_or_default("v", POOL, "t3.All", "o_int32"))) == [("pick_text", 0), (None, 0)]
    edited = df.select("i", op.set_fields("v", {"f_int32": F.lit(5)}).alias("v"))
    assert rows(edited.select(op.decode(op.encode("v", POOL, "t3.All"), POOL, "t3.All")["f_int32"])) == [(5,), (5,)]


def test_encoding_errors(spark):
    two = spark.range(1).select(F.struct(F.lit(1).alias("pick_int"), F.lit("a").alias("pick_text")).alias("v"))
    with pytest.raises(Exception, match="more than one member"):
        two.select(op.encode("v", POOL, "t3.All")).collect()
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(op.encode(F.struct(F.lit(2**40).alias("f_uint32")), POOL, "t3.All")).collect()
    with pytest.raises(Exception, match="a payload of"):
        spark.range(1).select(op.encode(F.struct(F.lit("x" * 99).alias("f_string")), POOL, "t3.All", max_encoded_size=50)).collect()


def test_merging(spark):
    df = payloads(spark, [{"f_int32": 1, "r_int32": [1], "leaf": {"id": 1}}, {"f_string": "s", "r_int32": [2], "leaf": {"name": "n"}}]).withColumn("k", F.lit(1))
    v = op.merge_by_key(df, ["k"], "i", "payload").select(op.decode("payload", POOL, "t3.All").alias("v"))
    assert rows(v.select("v.f_int32", "v.f_string", "v.r_int32", "v.leaf.id", "v.leaf.name")) == [(1, "s", [1, 2], 1, "n")]


def test_any_and_variant(spark):
    df = payloads(spark, [{"id": 4}], "t3.Leaf").select(op.any_pack("payload", "t3.Leaf").alias("a"))
    assert rows(df.select(op.dynamic_type("a"), op.any_unpack("a", POOL, "t3.Leaf")["id"], op.any_unpack("a", POOL, "t3.All")["f_int32"])) == [("t3.Leaf", 4, None)]
    assert df.select(F.variant_get(op.to_variant("a.value", POOL, "t3.Leaf"), "$.id", "int")).first()[0] == 4


def test_delimited_files(spark, tmp_path):
    register(spark)
    df = payloads(spark, [{"f_int32": i, "f_bytes": b"x" * (i * 1000)} for i in range(50)])
    path = str(tmp_path / "d")
    df.write.format("delimited").mode("append").save(path)
    back = spark.read.format("delimited").load(path)
    assert sorted(r[0] for r in rows(back.select(op.decode("payload", POOL, "t3.All", ["f_int32"])["f_int32"]))) == list(range(50))
    file = next(f for f in os.listdir(path) if f.endswith(".pb"))
    with open(f"{path}/{file}", "ab") as f:
        f.write(b"\x05ab")
    with pytest.raises(Exception, match="UNEXPECTED_EOF"):
        spark.read.format("delimited").load(path).count()
    empty = tmp_path / "e"
    empty.mkdir()
    assert spark.read.format("delimited").load(str(empty)).count() == 0


def test_a_stream_waits_for_the_rest_of_a_record(spark, tmp_path):
    path = tmp_path / "s"
    path.mkdir()
    record = lambda i: (lambda raw: varint(len(raw)) + raw)(Message.from_dict(POOL, "t3.All", {"f_int32": i}).encode())
    whole = record(5)
    (path / "a.pb").write_bytes(record(3) + record(4) + whole[:2])
    s = decode_stream(spark, str(path), POOL, "t3.All", fields=["f_int32"]).select("value.f_int32")
    q = s.writeStream.format("memory").queryName("waits").outputMode("append").start()
    q.processAllAvailable()
    assert sorted(r[0] for r in spark.table("waits").collect()) == [3, 4]
    with open(path / "a.pb", "ab") as f:
        f.write(whole[2:])
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.table("waits").collect()) == [3, 4, 5]


def test_boundaries(tmp_path):
    import random

    from pyarrow import fs

    from wirelake.sources.delimited import last_boundary

    r = random.Random(3)
    raw, ends = b"", [0]
    for _ in range(300):
        n = r.choice([0, 1, 100, 127, 128, 20_000])
        raw += varint(n) + bytes(n)
        ends.append(len(raw))
    (tmp_path / "a").write_bytes(raw)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a")) as f:
        for size in [0, 1, len(raw), *[r.randrange(len(raw)) for _ in range(50)]]:
            want = max(e for e in ends if e <= size)
            assert last_boundary(f, 0, size, 1 << 20) == want and last_boundary(f, max(e for e in ends if e <= want // 2), size, 1 << 20) == want


def test_late_rows_are_left_out(spark, tmp_path):
    """A watermark: what comes after a window is closed doesn't count, in append output."""
    from wirelake.streaming import windowed

    path = tmp_path / "w"
    path.mkdir()
    record = lambda i: (lambda raw: varint(len(raw)) + raw)(Message.from_dict(POOL, "t3.All", {"f_int64": i}).encode())
    s = decode_stream(spark, str(path), POOL, "t3.All", fields=["f_int64"])
    counted = windowed(s, F.timestamp_seconds(F.col("value.f_int64")), "1 minute", {"odd": F.col("value.f_int64") % 2}, {"n": F.count(F.lit(1))}, late="30 seconds")
    q = counted.writeStream.format("memory").queryName("late").outputMode("append").start()
    for k, seconds in enumerate([[0, 2, 5], [200], [4], [400], [600]]):
        (path / f"{k}.pb").write_bytes(b"".join(map(record, seconds)))
        q.processAllAvailable()
    q.stop()
    assert sorted((r.window_start.minute, r.odd, r.n) for r in spark.table("late").collect()) == [(0, 0, 2), (0, 1, 1), (3, 0, 1), (6, 0, 1)]


def test_containers(spark, tmp_path):
    register(spark)
    df = payloads(spark, [{"f_int32": i} for i in range(5)])
    write_containers(df, str(tmp_path / "c"), "numbers", "t3.All")
    from wirelake.sources.container import CONTAINER

    v = spark.read.format("delimited").load(str(tmp_path / "c")).select(op.decode("payload", Pool(CONTAINER), "wirelake.Container").alias("c"))
    assert rows(v.select("c.name", F.size("c.payload")).distinct()) == [("numbers", 1)] and v.count() == 5
    assert containers(df, "n", "m").count() == 5


def test_last_by_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, x string")
    assert sorted(rows(last_by_key(df, ["k"], "o"))) == [(1, 2, "b"), (2, 1, "c")]


def test_pruned_scans_reach_parquet(spark):
    from wirelake.tables import payloads as table_payloads

    plan = table_payloads(spark, "/root/testdata/sf0.001", "Nation").select(op.decode("payload", POOL, "t3.Leaf"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<n_nationkey:int,n_name:string,n_regionkey:int>" in plan and "ArrowEvalPython" in plan
