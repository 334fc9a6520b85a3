"""Mixing sources to target weights by capped water-filling, in DataFrame operations.

A source's target is its weight's share of all words, but no more than so many times its own words; what
is cut off goes to the others by weight until none is above its cap. A document is taken whole as often
as its source's target holds the source, and the documents with the smallest seeded hashes once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import words_of
from .shared import discard_table, stored

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
DIGIT_BITS, DIGITS = 12, 3
BROADCAST_ROWS = 100_000


def hashed(key: Column, seed: int) -> Column:
    """A number of 36 bits that depends on key and seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 64 - DIGIT_BITS * DIGITS)


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``totals`` (source, source_size) with target: one row per source.

    Sources by code point, null last, take the weights in turn. With sources ordered by how soon they fill, all before the
    first that the level doesn't fill are at their caps, and the level there is the highest that fits. The windows hold one row per source, never documents.
    """
    ranked = totals.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1))
    everyone = Window.partitionBy()
    order = Window.orderBy("fills", F.asc_nulls_last("source"))
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    filled = ranked.withColumns({"cap": F.col("source_size") * most_epochs, "all": F.sum("source_size").over(everyone)}).withColumn("fills", F.col("cap") / F.col("w"))
    levels = filled.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(on))
    settled = levels.withColumn("final", F.max(F.when(F.col("level") <= F.col("fills"), F.col("level"))).over(everyone))
    return settled.select("source", "source_size", F.least(F.coalesce(F.col("final") * F.col("w"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def _with_sources(df: DataFrame, sources: DataFrame, rows: int, source: str) -> DataFrame:
    """Joins what is known of each source; it is sent to all executors only when it has few rows."""
    side = sources.withColumnRenamed("source", "__source")
    return df.join(F.broadcast(side) if rows <= BROADCAST_ROWS else side, F.col(source).eqNullSafe(F.col("__source"))).drop("__source")


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> tuple[DataFrame, int]:
    """Per source: source_size, target, whole (full repetitions), below (hashes under it are taken once more) and more (hashes that are, too); and the number of sources.

    ``sized``: source, size, hash. The bound is found digit by digit: sums by the leading digit of the hash, then within the
    digit in which the fraction ends, so no window holds more than 4,096 rows of a source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = stored(targets(totals, weights, most_epochs).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")), "targets")
    rows = known.count()
    left = F.col("target") - F.col("whole") * F.col("source_size")
    bounds = known.select("source", F.lit(0).cast("long").alias("prefix"), left.alias("left"))
    for d in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - d)
        inside = _with_sources(sized.select("source", "size", "hash"), bounds, rows, "source").where(F.shiftrightunsigned("hash", shift + DIGIT_BITS) == F.col("prefix"))
        digit = F.shiftrightunsigned("hash", shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        sums = inside.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("mass"), F.first("prefix").alias("prefix"), F.first("left").alias("left"))
        running = sums.withColumn("upto", F.sum("mass").over(Window.partitionBy("source").orderBy("digit")))
        # The first digit that the fraction doesn't exceed.
        over = running.where(F.col("upto") >= F.col("left")).groupBy("source").agg(F.min_by(F.struct("digit", "prefix", (F.col("left") - F.col("upto") + F.col("mass")).alias("rest"), "mass"), "digit").alias("b"))
        moved = (F.col("b.prefix") * (1 << DIGIT_BITS) + F.col("b.digit")).alias("prefix")
        made = over.select("source", moved, F.col("b.rest").alias("left"), F.col("b.mass").alias("mass"))
        if d == DIGITS - 1:
            made = made.select("source", F.col("prefix").alias("below"), (F.col("left") <= 0).alias("none"))
        bounds = stored(made, "bounds")
    side = bounds.withColumnRenamed("source", "__source")
    made = known.join(side, F.col("source").eqNullSafe(F.col("__source")), "left").select("source", "source_size", "target", "whole", F.when(F.coalesce("none", F.lit(True)), 0).otherwise(F.col("below")).cast("long").alias("below"))
    return _topped_up(sized, stored(made, "mix"), rows), rows


def _topped_up(sized: DataFrame, sources: DataFrame, rows: int, rounds: int = 8, near: float = 0.005) -> DataFrame:
    """Adds ``more``, an array of hashes above the bound that are taken once more as well: in each round the one that holds most words that fit in
    what a source still lacks, until every source is within ``near`` of its target or nothing fits. Where it ends nearer its target with one that
    holds more than was lacking in some round, such as that at the bound, this is taken in place of those of that and later rounds."""
    whole = F.least(F.col("whole") + (F.col("hash") < F.col("below")).cast("long"), F.lit(MOST_EPOCHS).cast("long"))
    known = _with_sources(sized.select("source", "size", "hash"), sources, rows, "source")
    now = known.groupBy("source").agg(F.sum(F.col("size") * whole).alias("now"))
    above = stored(known.where((F.col("hash") >= F.col("below")) & (F.col("whole") < MOST_EPOCHS)).groupBy("source", "hash").agg(F.sum("size").alias("mass")).where("mass > 0"), "above")
    hashes = F.array().cast("array<bigint>")
    begun = _with_sources(sources, now, rows, "source").withColumns({"lack": F.col("target") - F.col("now"), "more": hashes, "other": hashes})
    state = stored(begun.withColumn("miss", F.abs("lack")).drop("now"), "lack")
    for _ in range(rounds):
        if not state.where(F.col("lack") > near * F.col("target")).limit(1).count():
            break
        left = _with_sources(above, state.select("source", "lack", "more"), rows, "source").where(~F.array_contains("more", F.col("hash")) & (F.col("mass") < 2 * F.col("lack")))
        fits = F.col("mass") <= F.col("lack")
        best = left.groupBy("source").agg(F.max(F.when(fits, F.struct("mass", "hash"))).alias("fit"), F.min(F.when(~fits, F.struct("mass", "hash"))).alias("over"))
        joined = state.join(best.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        nearer = F.coalesce(F.col("over.mass") - F.col("lack") < F.col("miss"), F.lit(False))
        joined = joined.withColumns({"other": F.when(nearer, F.array_append("more", F.col("over.hash"))).otherwise(F.col("other")), "miss": F.when(nearer, F.col("over.mass") - F.col("lack")).otherwise(F.col("miss"))})
        fitted = F.col("fit").isNotNull()
        joined = joined.withColumns({"more": F.when(fitted, F.array_append("more", F.col("fit.hash"))).otherwise(F.col("more")), "lack": F.when(fitted, F.col("lack") - F.col("fit.mass")).otherwise(F.col("lack")), "moved": fitted})
        state = stored(joined.drop("fit", "over"), "mix")
        if not state.where("moved").limit(1).count():
            break
        state = state.drop("moved")
    chosen = F.when(F.col("miss") < F.abs("lack"), F.col("other")).otherwise(F.col("more"))
    return state.select("source", "source_size", "target", "whole", "below", chosen.alias("more"))


def repetitions(hash_: Column) -> Column:
    once_more = (hash_ < F.col("below")) | F.array_contains("more", hash_)
    return F.least(F.col("whole") + once_more.cast("long"), F.lit(MOST_EPOCHS).cast("long"))


def _sized(df: DataFrame, text: str, source: str, key: str, seed: int, keep: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(k) for k in keep], F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"), hashed(F.col(key), seed).alias("hash"))


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """(key, size, source_size, target, taken) for every row.

    size: words; a null text has none and is never taken. taken: size times its repetitions. Rows that repeat a key are taken alike;
    a null key has one hash. A null source is a source of its own, the last. A source's taken words miss its target by
    at most half of what the hash at its bound holds, or half a percent. An empty table gives an empty table. Extra columns are ignored.
    """
    sized = stored(_sized(df, text, source, key, seed, (key,)), "sizes")
    sources, rows = plan(sized)
    return _with_sources(sized, sources, rows, "source").select(key, "size", "source_size", "target", (F.col("size") * repetitions(F.col("hash"))).alias("taken"))


def mixed(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, with all columns. Texts aren't shuffled: what is joined is one row per source."""
    sized = stored(_sized(df, text, source, key, seed, ()), "sizes")
    sources, rows = plan(sized)
    # All columns travel in one struct, so none clashes with what is known of a source.
    joined = _with_sources(df.select(F.struct("*").alias("__row"), F.col(source).alias("__of"), hashed(F.col(key), seed).alias("__hash")), sources, rows, "__of")
    taken = joined.withColumn("__times", repetitions(F.col("__hash"))).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    out = taken.select("__row.*")
    discard_table(sized)
    return out
