"""Links of few classes: rows that explode makes aren't collected on the driver."""

import random

from wirelake.llm import simhash


def test_no_exploded_rows_are_broadcast(spark, tmp_path):
    r = random.Random(4)
    prints = [r.getrandbits(62) for _ in range(300)]
    prints += [x ^ 1 << 7 ^ 1 << 40 for x in prints[:50]]
    spark.createDataFrame(list(enumerate(prints)), "node long, fingerprint long").write.parquet(path := f"{tmp_path}/classes")
    for parts in (2, 3):
        found = simhash.links(spark.read.parquet(path), 4, parts)
        assert {(p.a, p.b) for p in found.collect()} == {(a, b) for a in range(350) for b in range(a + 1, 350) if (prints[a] ^ prints[b]).bit_count() <= 4}
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
