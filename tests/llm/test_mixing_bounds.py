"""Sources that a few long documents or shared hashes dominate come as near their targets as can be."""

import random

from pyspark.sql import functions as F

from wirelake.llm import mixing


def taken(spark, sizes, share, most_epochs=1):
    """Words taken of one source whose documents have such (size, hash), against a target of a share of them."""
    total = sum(n for n, _ in sizes)
    sized = spark.createDataFrame([("s", n, h) for n, h in sizes], "source string, size long, hash long")
    known = spark.createDataFrame([("s", total, float(share), 0, below(sizes, share))], "source string, source_size long, target double, whole long, below long")
    made = mixing._topped_up(sized, known, 1)
    return mixing._with_sources(sized, made, 1, "source").agg(F.sum(F.col("size") * mixing.repetitions(F.col("hash")))).first()[0]


def below(sizes, share):
    for h in sorted({h for _, h in sizes}):
        if sum(n for n, k in sizes if k <= h) >= share:
            return h


def test_one_long_document(spark):
    assert taken(spark, [(1000, i) for i in range(10)] + [(90_000, 99)], 95_000) == 100_000
    assert taken(spark, [(90_000, 0)] + [(1000, 1 + i) for i in range(10)], 40_000) in range(8_000, 10_001)


def test_a_shared_hash_is_not_picked_again(spark):
    assert taken(spark, [(500, 1), (900, 5)] + [(300, 7)] * 9 + [(200, 8), (150, 9)], 900) == 500 + 200 + 150


def test_never_more_than_half_the_bound(spark):
    r = random.Random(3)
    for _ in range(6):
        sizes = [(r.choice([1, 5, 40, 1000, 5000]), r.randrange(12)) for _ in range(25)]
        share = r.uniform(0.1, 0.95) * sum(n for n, _ in sizes)
        bound = below(sizes, share)
        assert 2 * abs(taken(spark, sizes, share) - share) <= sum(n for n, h in sizes if h == bound)
