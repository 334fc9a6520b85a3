"""SimHash fingerprints of word shingles, and near duplicates by multi-index hashing.

Fingerprints are computed on arrays: XXH64 of all shingles of a batch at once, grouped by length, and
bit counts by unpacking. Equal fingerprints collapse to one class first. The 64 bits are cut into
segments; of two fingerprints at most r bits apart, one segment differs in at most r // segments bits.
Each class is stored once per segment, probes every member of that small Hamming ball, and complete
distances decide. Classes that are linked get their smallest doc_id by alternating large and small stars.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import CHUNK_BYTES, chunks, flat, trimmed, word_loads
from .shared import discard_table, stored

# ---------------------------------------------------------------- hashing

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_U = np.uint64


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(loads: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the slices of a byte array, given its 64-bit loads; slices of one length go side by side."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, cuts):
        out[rows] = _xxh64_equal(loads, starts[rows], int(lengths[rows[0]]), seed)
    return out


def _xxh64_equal(loads: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        s, left = _U(seed), n
        if n >= 32:
            accs = [np.full(len(at), x) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            while left >= 32:
                for k in range(4):
                    accs[k] = _round(accs[k], loads[at + 8 * k])
                at, left = at + 32, left - 32
            h = _rot(accs[0], 1) + _rot(accs[1], 7) + _rot(accs[2], 12) + _rot(accs[3], 18)
            for acc in accs:
                h = (h ^ _round(_U(0), acc)) * _P1 + _P4
        else:
            h = np.full(len(at), s + _P5)
        h = h + _U(n)
        while left >= 8:
            h = _rot(h ^ _round(_U(0), loads[at]), 27) * _P1 + _P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = _rot(h ^ ((loads[at] & _U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            at, left = at + 4, left - 4
        while left:
            h = _rot(h ^ ((loads[at] & _U(0xFF)) * _P5), 11) * _P1
            at, left = at + 1, left - 1
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        return h ^ (h >> _U(32))


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A-Z lower-cased and all words of all texts joined by one blank: the bytes, word starts, word ends, and
    per text the number of words before it (n + 1 entries)."""
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    low = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
    inside = ~white
    opens = inside.copy()
    if len(data):
        opens[1:] &= white[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        opens[firsts] = inside[firsts]  # a text's first byte begins a word though the text before it ends in one
    starts = np.flatnonzero(opens)
    before = np.searchsorted(starts, offsets)
    word = np.cumsum(opens) - 1
    kept = low[inside]
    where = np.flatnonzero(inside)
    target = np.arange(len(kept)) + word[where]  # one blank before each word but the first
    out = np.full(len(kept) + max(0, len(starts) - 1), 0x20, np.uint8)
    out[target] = kept
    counts = np.diff(np.append(np.searchsorted(where, starts), len(where)))
    new_starts = np.cumsum(counts + 1) - counts - 1
    return out, new_starts, new_starts + counts, before


_SPREAD = np.array([[(b >> k) & 1 for k in range(8)] for b in range(256)], np.uint8).view("<u8").ravel()


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of every text: a bit is 1 if set in over half of the hashes. Without words: 0."""
    text, starts, ends, before = spaced_words(data, offsets)
    words = np.diff(before)
    shingles = np.where(words == 0, 0, np.maximum(words - width + 1, 1))
    total = int(shingles.sum())
    first = np.repeat(before[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(total)
    last = np.minimum(first + width - 1, np.repeat(before[1:], shingles) - 1)
    return majority(xxh64(word_loads(text), starts[first], ends[last] - starts[first], seed), shingles)


def majority(hashes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Of each text's hashes, of which there are so many text after text, the bits that are set in over half; 0 for none."""
    out, total = np.zeros(len(shingles), np.uint64), len(hashes)
    if not total:
        return out
    some = np.flatnonzero(shingles)
    at = (np.cumsum(shingles) - shingles)[some]
    # Eight counters of a byte in one word: exact up to 255 rows, so rows are summed in blocks of at most 255.
    block_of = np.arange(total) - np.repeat(at, shingles[some])
    heads = np.flatnonzero(block_of % 255 == 0)
    texts = np.searchsorted(heads, at)
    bytes_ = hashes.view(np.uint8).reshape(total, 8) if hashes.dtype.byteorder in "<=" else hashes.astype("<u8").view(np.uint8).reshape(total, 8)
    for b in range(8):
        packed = np.add.reduceat(_SPREAD[bytes_[:, b]], heads)
        counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8), texts, 0, dtype=np.int64)
        bits = counts * 2 > shingles[some][:, None]
        out[some] |= np.packbits(bits, 1, "little").ravel().astype(np.uint64) << _U(8 * b)
    return out


def long_fingerprint(data: np.ndarray, width: int = 4, seed: int = 42, piece: int = CHUNK_BYTES) -> int:
    """The fingerprint of one long text in pieces: counts add up, and each piece begins with the last width - 1 words before it."""
    counts, total, at, carry = np.zeros(64, np.int64), 0, 0, data[:0]
    while at < len(data):
        end = min(at + piece, len(data))
        while end < len(data) and not (data[end] == 0x20 or 0x09 <= data[end] <= 0x0D):
            end += 1
        part = np.concatenate([carry, np.array([0x20], np.uint8), data[at:end]])
        text, starts, ends, _ = spaced_words(part, np.array([0, len(part)]))
        n = len(starts) - width + 1
        if n > 0:
            hashes = xxh64(word_loads(text), starts[:n], ends[width - 1 :] - starts[:n], seed)
            counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += n
        carry = text[starts[-(width - 1) :][0] :] if len(starts) and width > 1 else data[:0]
        at = end
    if not total:
        return int(fingerprints(carry, np.array([0, len(carry)]), width, seed)[0])
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def _chunk_prints(data, cuts, width, seed):
    if len(cuts) == 2 and len(data) > 2 * CHUNK_BYTES:
        return np.array([long_fingerprint(data, width, seed)], np.uint64)
    return fingerprints(data, cuts, width, seed)


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", width: int = 4, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and the fingerprint as a signed long. A null text counts as empty: fingerprint 0."""
    named = {f.name: f for f in df.schema.fields}
    schema = T.StructType([named[k] for k in keep] + [T.StructField(out, T.LongType())])

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(batch.schema.get_field_index(text)))
            parts = [_chunk_prints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, seed) for i, j in chunks(offsets)]
            made = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in keep] + [pa.array(made.view(np.int64))], names=schema.names)

    return df.select(*keep, text).mapInArrow(trimmed(run), schema)


# ---------------------------------------------------------------- links


def segments(parts: int) -> list[tuple[int, int]]:
    """(shift, bits) of nearly equal stretches of 64 bits."""
    cuts = [64 * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(classes: DataFrame, radius: int = 4, parts: int = 2, node: str = "node", fingerprint: str = "fingerprint") -> DataFrame:
    """All pairs (a, b), a < b, of classes whose fingerprints differ in at most ``radius`` bits, at most twice plus one as many as ``parts``.

    ``classes`` has one row per distinct fingerprint. Of two fingerprints, some segment differs in at most radius // parts bits. For balls
    of one bit each class probes its ball against a table of plain segments; for balls of two bits the table holds balls of one
    bit as well, so that the two meet halfway and rows stay a constant, some 130, per class however fingerprints are
    spread. Two segments of 32 bits keep buckets small at any number of classes; three of 21 bits make half the rows, but what meets in a bucket
    grows as the square of the classes. Each pair comes out once: from the first segment in which the two lie within the ball, in one of the
    ways to meet. A bucket that many classes share is split by the join's skew handling, and only verified pairs leave the join.
    """
    ball, cut = radius // parts, segments(parts)
    if ball > 2:
        raise ValueError("balls of more than two bits")
    fp = F.col(fingerprint)

    def part(x, i):
        shift, bits = cut[i]
        return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    def around(size):
        flips = [(i, sum(1 << b for b in chosen)) for i in range(parts) for k in range(size + 1) for chosen in itertools.combinations(range(cut[i][1]), k)]
        return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), part(fp, i).bitwiseXOR(F.lit(x).cast("long")).alias("key")) for i, x in flips]))

    table = classes.select(F.col(node).alias("b"), fp.alias("fb"), around(ball // 2).alias("at")).select("b", "fb", "at.i", "at.key")
    probe = classes.select(F.col(node).alias("a"), fp.alias("fa"), around((ball + 1) // 2).alias("at")).select("a", "fa", "at.i", "at.key")
    apart = F.col("fa").bitwiseXOR(F.col("fb"))
    earlier = F.lit(False)
    here, mine, theirs = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for i in range(parts):
        earlier = earlier | ((F.bit_count(part(apart, i)) <= ball) & (F.col("i") > i))
        of = F.col("i") == i
        mine = F.when(of, part(F.col("fa"), i).bitwiseXOR(F.col("key"))).otherwise(mine)
        theirs = F.when(of, part(F.col("fb"), i).bitwiseXOR(F.col("key"))).otherwise(theirs)
        here = F.when(of, F.bit_count(part(apart, i))).otherwise(here)
    one_way = F.lit(True) if ball < 2 else F.when(here <= 1, theirs == 0).otherwise(mine < theirs)
    # Spark reckons a table without the rows that explode makes: it would collect some million rows on the driver for a table of 200 kB, so the sides are shuffled and sorted.
    pairs = probe.hint("merge").join(table.hint("merge"), ["i", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(apart) <= radius) & ~earlier & one_way)
    return pairs.select("a", "b")


def components(nodes_edges: DataFrame, label: str = "edges", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that can be reached.

    Large and small stars in turn: each keeps connectivity and at most the number of edges, and they settle
    in a number of rounds that grows as the logarithm of the longest chain. Every round ends in a table in
    the shared folder. Stars hang on their smallest neighbour, which is found by an aggregate and a join,
    never by collecting a group.
    """
    edges = stored(nodes_edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), label)
    mark = _mark(edges)
    for _ in range(most_rounds):
        new = stored(_star(_star(edges, True), False), label)
        discard_table(edges)
        edges, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    else:
        raise RuntimeError("components have not settled")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """The number of edges and two 64-bit sums of their hashes: equal for equal edges."""
    one, two = F.xxhash64("a", "b"), F.xxhash64("b", "a")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(one), F.sum(two.cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a < b. Large: every neighbour above a node hangs on the least of the node and its
    neighbours. Small: every neighbour below, and the node itself, hang on the least."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        made = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        made = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return made.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 4, parts: int = 2, width: int = 4, seed: int = 42) -> DataFrame:
    """(key, fingerprint as a signed long, component_id) for every row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked, and component_id is the smallest key
    that can be reached. Null or empty texts have fingerprint 0 and are linked like any other. A row
    without a key links nothing: it gets the component of the rows that have its fingerprint, or null if there is none.
    Repeated rows come out as often as they came in; an empty table gives an empty table. Extra columns are ignored.
    """
    marked = stored(with_fingerprint(df, text, "fingerprint", width, seed, (key,)), "fingerprints")
    classes = stored(marked.groupBy("fingerprint").agg(F.min(key).alias("node")), "classes")
    roots = components(links(classes.where("node is not null"), radius, parts), "links")
    rooted = classes.join(roots, "node", "left").select("fingerprint", F.coalesce("root", "node").alias("component_id"))
    return marked.join(rooted, "fingerprint").select(key, "fingerprint", "component_id")


def hex_fingerprint(column: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_first(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that stay when one document of each group does: those with the group's smallest doc_id.

    Rows that repeat a doc_id stay or go together; rows without a doc_id stay. All columns pass.
    """
    groups = near_duplicates(df, **options)
    away = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return df.join(away, "doc_id", "left_anti").select(*df.columns)
