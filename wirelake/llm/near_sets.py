"""Near duplicates by the exact Jaccard similarity of sets of word shingles.

Shingles are 64-bit hashes, and texts with equal sets collapse to one class first. All sets are ordered alike, shingles
that a sample has often last. Two sets of n and m shingles that are similar enough share one of the first
n - ceil(s * n) + 1 and m - ceil(s * m) + 1, so these prefixes are grouped by shingle and what meets in a group is
compared by size and by place. Of pairs that may still be similar, sketches tell most that meet in vain: in how many bits two sketches
differ, in so many shingles the sets differ at least. The rest are decided on whole sets. That goes in two rounds: first
each class meets those whose SimHash fingerprints are few bits apart, and the two before it under each shingle, which joins most
copies of a text; then classes meet those that they aren't joined with, as fingerprints of sets with a similarity of 0.8 differ in some ten bits. No link between groups is lost, as pairs within one can't change what is linked; the sample only tells
how many meet in vain. Pairs go in as many slices as keep what is on disk in proportion to the texts, however many meet.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import CHUNK_BYTES, chunks, flat, trimmed, word_loads
from .shared import discard_table, release_shuffles, stored
from .simhash import components, links, majority, spaced_words, xxh64

WIDTH, SIMILARITY = 5, Fraction(4, 5)
#: Documents in the sample, and how many often-met shingles are taken from it at most; each is in so many of its documents at least.
SAMPLE, MOST_OFTEN, OFTEN = 1 << 14, 1 << 17, 4
#: Bits that tell which texts to hash again: 8 MB at any size. A text that is hashed in vain does no harm.
FILTER_BITS = 1 << 26
#: Bits in which the SimHash fingerprints of the first round's pairs differ at most.
RADIUS = 4
#: Bytes that a slice of pairs may take for each shingle of all texts, and at any size; what a meeting of two classes takes, and a shingle of a pair whose sets are compared.
SLICE_BYTES, LEAST_BYTES, MEETING_BYTES, PAIR_BYTES = 4, 1 << 26, 48, 16


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles and how many each text has. Fewer words than ``width`` are one shingle, no words none."""
    text, starts, ends, before = spaced_words(data, offsets)
    words = np.diff(before)
    counts = np.where(words == 0, 0, np.maximum(words - width + 1, 1))
    first = np.repeat(before[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    last = np.minimum(first + width - 1, np.repeat(before[1:], counts) - 1)
    return xxh64(word_loads(text), starts[first], ends[last] - starts[first], seed), counts


def long_shingles(data: np.ndarray, width: int = WIDTH, seed: int = 42, piece: int = CHUNK_BYTES) -> np.ndarray:
    """The different shingles of one long text, in pieces; each piece begins with the last width - 1 words before it."""
    found, at, carry = [], 0, data[:0]
    while at < len(data):
        end = min(at + piece, len(data))
        while end < len(data) and not (data[end] == 0x20 or 0x09 <= data[end] <= 0x0D):
            end += 1
        text, starts, ends, _ = spaced_words(part := np.concatenate([carry, np.array([0x20], np.uint8), data[at:end]]), np.array([0, len(part)]))
        n = len(starts) - width + 1
        if n > 0:
            found.append(np.unique(xxh64(word_loads(text), starts[:n], ends[width - 1 :] - starts[:n], seed)))
        carry = text[starts[-(width - 1) :][0] :] if len(starts) and width > 1 else data[:0]
        at = end
    return np.unique(np.concatenate(found)) if found else shingles(carry, np.array([0, len(carry)]), width, seed)[0]


def sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text in ascending order, text after text, and the n + 1 offsets of the texts' sets."""
    if len(offsets) == 2 and len(data) > 2 * CHUNK_BYTES:
        made = long_shingles(data, width)
        return made, np.array([0, len(made)])
    hashes, counts = shingles(data, offsets, width)
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(counts) + 1))


def _chunk_sets(column, width):
    data, offsets = flat(column)
    for i, j in chunks(offsets, CHUNK_BYTES >> 2):
        yield i, j, *sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def _names(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set: sums of mixed hashes, mixed with the size."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(hashes), dtype=np.uint64)])
        return _mixed(sums[at[1:]] - sums[at[:-1]] + _mixed(np.diff(at).astype(np.uint64)))


def _sketches(hashes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set of n shingles a power of two of bits, n at least and 64 at least: whether an odd number of its shingles falls on each."""
    n = np.diff(at)
    bits = 1 << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64)
    ends = np.cumsum(bits)
    place = np.repeat(ends - bits, n) + (hashes & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    cuts = [0, *(ends >> 3).tolist()]
    return [packed[a:b] for a, b in zip(cuts, cuts[1:])]


def _differing(x, y) -> int:
    """In how many shingles the sets of two sketches differ at least. The larger sketch is folded: an odd and an odd number make an even one."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), 0) ^ y).sum())


def often_met(df: DataFrame, text: str, key: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents of a sample have, ascending, and a rank for each, from 1: more documents, higher."""
    share = SAMPLE / max(1, df.count())
    sample = df if share >= 1 else df.where(F.shiftrightunsigned(F.xxhash64(key), 32) < int(share * 2**32))

    def run(batches):
        for batch in batches:
            for _, _, hashes, _ in _chunk_sets(batch.column(0), width):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["shingle"])

    counted = sample.select(text).mapInArrow(trimmed(run), "shingle long").groupBy("shingle").count().where(F.col("count") >= OFTEN)
    found = counted.orderBy(F.desc("count"), "shingle").limit(MOST_OFTEN).toArrow()
    names = found.column("shingle").to_numpy().view(np.uint64)
    counts = found.column("count").to_numpy()
    order = np.argsort(names)
    return names[order], 1 + np.searchsorted(np.unique(counts), counts[order])


def with_prefixes(df: DataFrame, often: tuple[np.ndarray, np.ndarray], similarity: Fraction, width: int, text: str, key: str) -> DataFrame:
    """(key, class, n, sketch, fingerprint, prefix): the name, size, sketch and SimHash fingerprint of every text's set, and its first shingles in the order of all."""
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL("class long, n int, sketch binary, fingerprint long, prefix array<long>").fields])
    up, down = similarity.numerator, similarity.denominator
    names, ranks = often

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for i, j, hashes, at in _chunk_sets(batch.column(1), width):
                n = np.diff(at)
                owner = np.repeat(np.arange(j - i), n)
                rank = np.zeros(len(hashes), np.int64)
                if len(names):
                    place = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
                    rank = np.where(names[place] == hashes, ranks[place], 0)
                ordered = hashes[np.argsort(owner * (int(ranks.max(initial=0)) + 1) + rank, kind="stable")]
                long = np.where(n > 0, n + (-up * n // down) + 1, 0)  # n - ceil(s * n) + 1
                ends = np.cumsum(long)
                taken = ordered[np.repeat(at[:-1] - (ends - long), long) + np.arange(int(long.sum()))]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(taken.view(np.int64)))
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.array(_names(hashes, at).view(np.int64)), pa.array(n, pa.int32()), pa.array(_sketches(hashes, at), pa.binary()), pa.array(majority(hashes, n).view(np.int64)), lists], names=schema.names)

    return df.select(key, text).mapInArrow(trimmed(run), schema)


BUCKET_SCHEMA = "shingle long, n long, class long, place long, before1 long, before2 long"


def buckets(marked: DataFrame, similarity: Fraction) -> DataFrame:
    """Prefix shingles that classes of like sizes share, of rows (class, n, prefix): (shingle, n, class, place), and the classes one and two rows before it, in order of
    size, that may be similar enough. Rows are sorted by ranges, so a shingle of many classes goes over many tasks, which keep two rows at a time;
    rows at a range's edges stay, whatever lies beyond."""
    up, down = similarity.numerator, similarity.denominator
    names = [x.split()[0] for x in BUCKET_SCHEMA.split(", ")]
    rows = marked.select("class", F.col("n").cast("long").alias("n"), F.posexplode("prefix").alias("place", "shingle"))
    placed = rows.select("shingle", "n", "class", F.col("place").cast("long").alias("place"))

    def like(x, k):
        """Whether a row and that k rows before it are of one shingle and of like sizes, and whether what follows that shingle allows the similarity."""
        ok, can = np.zeros(len(x[0]), bool), np.zeros(len(x[0]), bool)
        if len(x[0]) > k:
            n, place = x[1], x[3]
            ok[k:] = (x[0][k:] == x[0][:-k]) & (up * n[k:] <= down * n[:-k])
            most = np.minimum(n[k:] - place[k:], n[:-k] - place[:-k])
            can[k:] = ok[k:] & (most * (up + down) >= up * (n[k:] + n[:-k]))
        return ok, can

    def task(batches):
        held, done, begun = None, 0, False

        def kept(x, upto, last):
            one, can1 = like(x, 1)
            _, can2 = like(x, 2)
            keep = one.copy()
            keep[:-1] |= one[1:]
            keep[0] |= not begun
            keep[-1] |= last
            take = np.flatnonzero(keep[done:upto]) + done
            near = [pa.array(x[2][take - k], mask=~can[take]) for k, can in ((1, can1), (2, can2))]
            return pa.RecordBatch.from_arrays([*(pa.array(c[take]) for c in x), *near], names=names)

        for batch in batches:
            now = [batch.column(k).to_numpy() for k in range(4)]
            x = now if held is None else [np.concatenate(c) for c in zip(held, now)]
            if not len(x[0]):
                continue
            new = np.append(True, (x[0][1:] != x[0][:-1]) | (x[2][1:] != x[2][:-1]))  # rows of one class count once
            x = [c[new] for c in x]
            upto = len(x[0]) - 1  # the last row waits for the next
            yield kept(x, upto, False)
            begun = begun or upto > 0
            rest = max(0, upto - 2)
            held, done = [c[rest:] for c in x], upto - rest
        if held is not None:
            yield kept(held, len(held[0]), True)

    return placed.repartitionByRange("shingle", "n", "class").sortWithinPartitions("shingle", "n", "class").mapInArrow(trimmed(task), BUCKET_SCHEMA)


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def first_pairs(found: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs (a, b), a < b: each class with that class which comes one or two rows before it, and that which comes after it, under the most shingles, if under
    a third of the smaller prefix at least. These are likely copies; which pairs are left for the second round changes no result."""
    up, down = similarity.numerator, similarity.denominator
    each = found.select("class", "n", F.explode(F.array("before1", "before2")).alias("other")).where(F.col("other").isNotNull() & (F.col("other") != F.col("class")))
    counted = each.groupBy("class", "other").agg(F.count(F.lit(1)).alias("count"), F.min("n").alias("n")).where(3 * F.col("count") * down >= F.col("n") * (down - up))
    before = counted.groupBy("class").agg(F.max_by("other", F.struct("count", "other")).alias("other"))
    after = counted.groupBy("other").agg(F.max_by("class", F.struct("count", "class")).alias("class"))
    return before.unionByName(after).select(*_ordered(F.col("class"), F.col("other"))).distinct()


def simhash_pairs(marked: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, by SimHash, of rows (class, fingerprint): one class stands for each fingerprint, the others are paired with it, and it is paired with the first and
    the last of those whose fingerprints differ in at most ``RADIUS`` bits. So no more pairs than a few for each class, however many are alike."""
    prints = stored(marked.groupBy("fingerprint").agg(F.min("class").alias("node")), "fingerprints")
    same = marked.join(prints, "fingerprint").where("class <> node").select(*_ordered(F.col("class"), F.col("node")))
    each = links(prints, RADIUS).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    ends = each.groupBy("a").agg(F.array(F.min("b"), F.max("b")).alias("b")).select("a", F.explode("b").alias("b"))
    return same.union(ends.select(*_ordered(F.col("a"), F.col("b")))).distinct()


def _slices(df: DataFrame, name: str, count: int):
    """``df`` in ``count`` parts by the hash of a column."""
    return [df.where(F.pmod(F.xxhash64(name), F.lit(count)) == i) for i in range(count)] if count > 1 else [df]


def pairs_across(found: DataFrame, roots: DataFrame, sketches: DataFrame, similarity: Fraction, most_bytes: int, release: bool) -> DataFrame:
    """All other pairs that may be similar enough, of classes that aren't in one group yet. Under each shingle the classes outside of its largest group meet all; within a group nothing
    does, so copies of one text by the thousand are no pairs by the million. The join's skew handling splits a shingle of many classes."""
    up, down = similarity.numerator, similarity.denominator
    rows = found.select("shingle", "n", "class", "place").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("shingle", "n", "class", "place", F.coalesce("root", "class").alias("group"))
    rows = stored(rows, "grouped")
    sizes = rows.groupBy("shingle", "group").count().groupBy("shingle").agg(F.max_by("group", F.struct("count", "group")).alias("largest"), F.count(F.lit(1)).alias("groups"), F.sum("count").alias("all"), F.max("count").alias("most"))
    sizes = stored(sizes.where("groups > 1"), "sizes")
    meetings = sizes.agg(F.sum((F.col("all") - F.col("most")) * F.col("all"))).first()[0] or 0
    marked = rows.join(sizes.select("shingle", "largest"), "shingle").withColumn("outside", F.col("group") != F.col("largest"))
    of = lambda c: [F.col(k).alias(k + c) for k in ("n", "class", "place", "group", "outside")]
    most = F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2"))
    can = (F.greatest("n1", "n2") * up <= F.least("n1", "n2") * down) & (most * (up + down) >= (F.col("n1") + F.col("n2")) * up)
    parts = []
    for part in _slices(marked.where("outside"), "class", -(-int(meetings) * MEETING_BYTES // most_bytes)):
        met = part.select("shingle", *of("1")).join(marked.select("shingle", *of("2")), "shingle")
        pairs = stored(met.where((F.col("group1") != F.col("group2")) & (~F.col("outside2") | (F.col("class1") < F.col("class2"))) & can).select(*_ordered(F.col("class1"), F.col("class2"))).distinct(), "pairs")
        release_shuffles(found.sparkSession, release)
        parts.append(likely(pairs, sketches, similarity))
        discard_table(pairs)
        release_shuffles(found.sparkSession, release)
    discard_table(rows)
    discard_table(sizes)
    return reduce(DataFrame.union, parts).distinct()


def likely(pairs: DataFrame, sketches: DataFrame, similarity: Fraction) -> DataFrame:
    """(a, b, n): the pairs whose sketches differ in no more bits than similar sets do in shingles, and how many shingles their sets have."""
    up, down = similarity.numerator, similarity.denominator

    def run(batches):
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = np.array([_differing(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(4), batch.column(5))], np.int64)
            kept = (n - apart) // 2 * (up + down) >= up * n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["a", "b", "n"]).filter(pa.array(kept, pa.bool_()))

    of = lambda c: sketches.select(F.col("class").alias(c), F.col("n").cast("long").alias("n" + c), F.col("sketch").alias("s" + c))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return stored(both.mapInArrow(trimmed(run), "a long, b long, n long"), "likely")


def _places(column) -> Column:
    return F.xxhash64(column).bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))


def _filter_of(keys: DataFrame, key: str) -> np.ndarray:
    """A bit for the hash of every key, in a table of one size."""
    place = _places(key)
    found = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(xxhash64({key}) & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.view(np.uint64)


def similar(df: DataFrame, pairs: DataFrame, classes: DataFrame, similarity: Fraction, width: int, text: str, key: str, most_bytes: int, release: bool) -> DataFrame:
    """The pairs (a, b), of rows (a, b, n), whose whole sets are similar enough. Only texts that stand for a class of some pair are hashed again."""
    up, down = similarity.numerator, similarity.denominator

    def hashed(batches):
        for batch in batches:
            places = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((table[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for i, j, hashes, at in _chunk_sets(batch.column(0), width):
                raw = memoryview(hashes)
                cuts = at.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(_names(hashes, at).view(np.int64)), pa.array([bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["class", "shingles"])

    def decided(batches):
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, True))
                kept.append(both * down >= up * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    placed, parts = df.where(F.col(key).isNotNull()).select(text, _places(key).alias("place")), []
    heavy = pairs.agg(F.sum("n")).first()[0] or 0
    for part in _slices(pairs, "a", -(-int(heavy) * PAIR_BYTES // most_bytes)):
        wanted = part.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        table = _filter_of(classes.join(wanted, "class", "left_semi").select(F.col("node").alias(key)), key)
        found = stored(placed.mapInArrow(trimmed(hashed), "class long, shingles binary"), "shingle-sets")
        of = lambda c, out: found.select(F.col("class").alias(c), F.col("shingles").alias(out))  # noqa: B023, E731
        parts.append(stored(part.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(trimmed(decided), "a long, b long"), "alike"))
        discard_table(found)
        release_shuffles(df.sparkSession, release)
    return reduce(DataFrame.union, parts)


def keep_first(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: Fraction = SIMILARITY, width: int = WIDTH, release: bool = True) -> DataFrame:
    """The rows of ``df`` that stay when one document of each group of similar ones does: those with the group's smallest key.

    Two texts are linked whose sets of shingles (A-Z lower-cased, words split at ASCII blanks) have a Jaccard similarity of at least ``similarity``, and a
    group is what links reach. Texts without words are alike. Rows that repeat a key are in one group and stay or go together; rows without a key link nothing and stay. All columns pass.
    ``release``: have the driver collect garbage between rounds, so that shuffle files of finished ones don't add up on disk.
    """
    marked = stored(with_prefixes(df.where(F.col(key).isNotNull()), often_met(df, text, key, width), similarity, width, text, key), "prefixes")
    found = stored(buckets(marked, similarity), "buckets")
    release_shuffles(df.sparkSession, release)
    prefixes, marked = marked, stored(marked.select(key, "class", "n", "sketch", "fingerprint"), "named")
    discard_table(prefixes)
    classes = marked.groupBy("class").agg(F.min(key).alias("node"))
    sketches = marked.groupBy("class").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    most_bytes = max(LEAST_BYTES, SLICE_BYTES * int(marked.agg(F.sum("n")).first()[0] or 0))
    repeated = marked.groupBy(key).agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select(key, "a")
    repeated = marked.join(repeated, key).select("a", F.col("class").alias("b")).where("a <> b")
    hashed = stored(simhash_pairs(marked), "simhash-pairs")
    release_shuffles(df.sparkSession, release)
    first = stored(hashed.union(first_pairs(found, similarity)).distinct(), "pairs")
    alike = similar(df, likely(first, sketches, similarity), classes, similarity, width, text, key, most_bytes, release).union(repeated)
    roots = stored(components(alike, "links"), "roots")
    second = stored(pairs_across(found, roots, sketches, similarity, most_bytes, release).join(first, ["a", "b"], "left_anti"), "pairs")
    discard_table(found)
    release_shuffles(df.sparkSession, release)
    more = similar(df, second, classes, similarity, width, text, key, most_bytes, release)
    roots = components(more.union(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))), "links")
    rooted = stored(marked.select(key, "class").join(roots.withColumnRenamed("node", "class"), "class", "left").select(key, F.coalesce("root", "class").alias("group")), "groups")
    discard_table(marked)
    least = rooted.groupBy("group").agg(F.min(key).alias("least"))
    away = stored(rooted.join(least, "group").where(F.col(key) > F.col("least")).select(key).distinct(), "away")
    release_shuffles(df.sparkSession, release)
    return df.join(away, key, "left_anti").select(*df.columns)
