"""What a Python worker holds at once, and how often a payload is decoded."""

from pyspark.sql import functions as F

from tests.schemas import SET
from wirelake import operators as op
from wirelake import queries
from wirelake.kernels.message import Message
from wirelake.schema import Pool

POOL = Pool(SET)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_malformed_rows_are_dropped_in_one_pass(spark):
    """Payloads are encoded once and decoded once: no second pass for the condition, not even under a condition on the value."""
    df = queries.QUERIES["drop_malformed"](spark, "/root/testdata/sf0.001")
    assert plan_of(df).count("ArrowEvalPython") == 2
    assert plan_of(df.where("event_id > 500")).count("ArrowEvalPython") == 2


def test_dropped_rows(spark):
    """Broken rows go, null payloads stay and are null, other columns and conditions on them are as before, and a column of that name is replaced."""
    good = Message.from_dict(POOL, "t3.All", {"f_int32": 5, "kids": [{"id": 1}]}).encode()
    df = spark.createDataFrame([(0, good), (1, good[:-1]), (2, None), (3, b""), (4, good)], "i int, payload binary")
    for out in ("value", "payload"):
        got = op.decode_frame(df, "payload", POOL, "t3.All", out, "DROPMALFORMED", fields=["f_int32"])
        assert got.columns == (["i", "payload", "value"] if out == "value" else ["i", "payload"])
        assert sorted((x.i, x.v) for x in got.select("i", F.col(out + ".f_int32").alias("v")).collect()) == [(0, 5), (2, None), (3, 0), (4, 5)]
        assert [x.i for x in got.where(f"i > 1 and {out}.f_int32 = 5").collect()] == [4]


def test_long_batches_are_decoded_in_slices(monkeypatch):
    """The same columns and errors as in one piece, and never more bytes at once than the limit, but for a longer payload by itself."""
    import numpy as np
    import pyarrow as pa

    from wirelake.kernels import columnar
    from wirelake.plans import compile_plan

    plan = compile_plan(POOL, "t3.Flat", unknown=True)
    made = [Message.from_dict(POOL, "t3.Flat", {"f_int32": i, "f_string": "é" * (i % 7), "r_string": ["a", "b"] * (i % 3), "counts": {"k": i}, "leaf": {"id": i} if i % 2 else None, "pick_text": "x", "o_uint64": 2**64 - 1}).encode() for i in range(400)]
    made[7], made[200], made[201], made[399] = made[7][:-1], None, made[1] * 100, b""
    column = pa.array([b"before", *made, b"after"], pa.binary()).slice(1, 400)
    whole = columnar.decode_column(plan, column)
    sizes = []
    one = columnar._decode_slice

    def seen(plan, part, options):
        sizes.append((len(part), sum(len(x.as_py() or b"") for x in part)))
        return one(plan, part, options)

    monkeypatch.setattr(columnar, "_decode_slice", seen)
    got = columnar.decode_column(plan, column, limit=1000)
    assert got.struct.equals(whole.struct) and got.struct.type == whole.struct.type and (got.errors == whole.errors).all() and np.flatnonzero(got.errors).tolist() == [7]
    assert sum(n for n, _ in sizes) == 400 and all(n == 1 or size <= 1000 for n, size in sizes)
    assert columnar.SLICE_BYTES <= 8 << 20
