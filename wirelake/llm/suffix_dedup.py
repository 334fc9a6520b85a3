"""Removal of every long string that occurs more than once, by distributed prefix doubling on sampled positions.

Plain prefix doubling ranks every byte position in every round, many times the input in each shuffle. Here
positions are sampled so that no repeat is missed: a window of so many bytes (or words) is represented by its
anchor, the leftmost of its seeds with the least hash. Equal windows have equal anchors at equal distances, so
whatever differs from round to round can only be dropped, never lost:

1. Positions (anchors) are ranked by their seed and by the block of all windows that they represent. A rank that
   occurs once ends there; a block that occurs twice is a repeat as a whole.
2. Blocks that share the first rank only are cut by distance from the anchor into stretches of windows, shorter
   in each round. A stretch's rank is that of a pair: the rank which the stretch around it got in the round
   before, and the longer string that all of its own windows share. So the ranked strings grow (of bytes: 48,
   337, 393, 400) and ranks carry over. Unique ranks are dropped; a stretch that occurs twice as a whole is a
   repeat; at the threshold, stretches of one window, rank and repeat are the same.

Ranks are 64-bit names: polynomials in two prime fields, so texts such as Thue-Morse strings, whose
polynomials modulo a power of two agree, are told apart. Every grouping combines before it shuffles, so a
passage in a third of all documents is one row per task, and equal texts meet once. Distinct texts are
shuffled twice: to cut out the blocks that round 2 needs, and to remove the repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import CHUNK_BYTES, chunks, flat, spread, trimmed, word_loads
from .shared import discard_table, release_shuffles, stored
from .simhash import xxh64


@dataclass(frozen=True)
class Unit:
    """What windows are made of. ``stretches``: windows in a stretch, round by round; each divides the one before, the first is at most the window and the last is 1."""

    window: int
    seed: int
    stretches: tuple[int, ...]
    words: bool = False


BYTES = Unit(400, 48, (64, 8, 1))
#: Passages of over 50 words, whatever the blanks between them.
WORDS = Unit(51, 4, (16, 4, 1), True)
_PIECE = 1 << 20
_POSITION_BITS = 21
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15

# ---------------------------------------------------------------- hashes of substrings


def _powers(n: int, base: int, modulus: int = 1 << 64) -> np.ndarray:
    out = np.ones(n, np.uint64)
    step, k = base % modulus, 1  # base ** k
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * _U(step)
        if modulus < 1 << 64:
            out[k : k + m] %= _U(modulus)
        step, k = step * step % modulus, 2 * k
    return out


_SPAN = _PIECE + 1024
_POW, _INV = _powers(_SPAN, _BASE), _powers(_SPAN, pow(_BASE, -1, 1 << 64))
#: Primes under 2 ** 31 and a base for each; for strings of under 1,024 symbols two that differ agree in both once in 2 ** 42 at worst, by chance once in 2 ** 62.
_FIELDS = [(p, _powers(_SPAN, b, p), _powers(_SPAN, pow(b, -1, p), p)) for p, b in ((2147483647, 1203491357), (2147483629, 786433409))]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _summed(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def prefix_sums(symbols: np.ndarray) -> list[np.ndarray]:
    """Running sums of the polynomial of the symbols (uint8 or uint64) in each field."""
    wide = symbols.astype(np.uint64)
    out = []
    for k, (p, powers, _) in enumerate(_FIELDS):
        value = wide + _U(1) if symbols.dtype == np.uint8 else ((wide >> _U(33 * k)) & _U(0x7FFFFFFF)) + _U(1)
        out.append(_summed(value * powers[: len(wide)] % _U(p)))
    return out


def substring_hash(sums: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of the symbols from a to b, the same wherever they stand."""
    one, two = ((s[b] - s[a]) % _U(p) * inverse[a] % _U(p) for s, (p, _, inverse) in zip(sums, _FIELDS))
    return mix((one << _U(32)) | two)


# ---------------------------------------------------------------- symbols


def symbols_of(data: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts laid end to end and the n + 1 offsets of the texts' symbols: bytes, or XXH64 of words split at ASCII blanks."""
    if not unit.words:
        return data, offsets
    inside = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    opens, ends = inside.copy(), inside.copy()
    if len(data):
        opens[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        opens[inner] = inside[inner]  # a text's first byte begins a word though the text before it ends in one
        ends[inner - 1] = inside[inner - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(ends) + 1
    return xxh64(word_loads(data), starts, stops - starts), np.searchsorted(starts, offsets)


def blocks(symbols: np.ndarray, cuts: np.ndarray, unit: Unit = BYTES) -> dict[str, np.ndarray]:
    """The blocks of texts laid end to end (at most _SPAN symbols): text (its number), start (in the text, of the first window),
    windows, reach (from the first window to the anchor), rank (of the anchor's seed), block (name of all its symbols and reach)."""
    window, seed = unit.window, unit.seed
    sizes = np.diff(cuts)
    counts = np.maximum(sizes - window + 1, 0)
    starts = spread(cuts[:-1], counts)
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "windows", "reach", "rank", "block")}
    text = np.repeat(np.arange(len(sizes)), counts)
    rolling = _summed((symbols.astype(np.uint64) + _U(1)) * _POW[: len(symbols)])  # chooses anchors; what differs in it is told apart by the block
    hashes = mix((rolling[seed:] - rolling[:-seed]) * _INV[: len(symbols) - seed + 1])
    low = _U((1 << _POSITION_BITS) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span = window - seed + 1  # seeds in a window; their least by running minima over stretches of this length, from both ends
    padded = np.full(-(-len(keys) // span) * span, _U(2**64 - 1))
    padded[: len(keys)] = keys
    stretches = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(stretches, 1).ravel()
    behind = np.minimum.accumulate(stretches[:, ::-1], 1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[starts], ahead[starts + span - 1]) & low).astype(np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    s0, s1, at = starts[first], starts[last], anchor[first]
    reach = at - s0
    block = mix(substring_hash(prefix_sums(symbols), s0, s1 + window) ^ (reach.astype(np.uint64) * _U(_BASE)))
    return {"text": text[first], "start": s0 - cuts[text[first]], "windows": s1 - s0 + 1, "reach": reach, "rank": hashes[at], "block": block}


BLOCK_SCHEMA = "t1 long, t2 long, start long, windows int, reach int, rank long, block long"


def _pieces(offsets: np.ndarray, window: int):
    """(rows i to j, None) for rows that fit together in a piece, (row, first symbol) for the pieces of a longer one, which overlap by a window less a symbol."""
    n, i = len(offsets) - 1, 0
    while i < n:
        size = int(offsets[i + 1] - offsets[i])
        if size > _PIECE:
            for at in range(0, size - window + 1, _PIECE):
                yield i, i + 1, at
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _PIECE, "right")) - 1)
        yield i, j, None
        i = j


def _blocks_of(unit: Unit):
    def run(batches):
        for batch in batches:
            data, all_offsets = flat(batch.column(2))
            t1, t2 = (batch.column(k).to_numpy() for k in (0, 1))
            for lo, hi in chunks(all_offsets):
                symbols, offsets = symbols_of(data[all_offsets[lo] : all_offsets[hi]], all_offsets[lo : hi + 1] - all_offsets[lo], unit)
                for i, j, at in _pieces(offsets, unit.window):
                    if at is None:
                        made = blocks(symbols[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit)
                        at = 0
                    else:
                        part = symbols[offsets[i] + at : min(offsets[i] + at + _PIECE + unit.window - 1, offsets[i + 1])]
                        made = blocks(part, np.array([0, len(part)]), unit)
                    rows = lo + i + made["text"]
                    signed = [made[k].view(np.int64) if made[k].dtype == np.uint64 else made[k] for k in ("rank", "block")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t1[rows]), pa.array(t2[rows]), pa.array(made["start"] + at, pa.int64()), pa.array(made["windows"], pa.int32()), pa.array(made["reach"], pa.int32()), *map(pa.array, signed)],
                        names=["t1", "t2", "start", "windows", "reach", "rank", "block"],
                    )

    return run


# ---------------------------------------------------------------- round 2

#: copies: 1, or 2 for a block that is a repeat already and stands for all of its copies.
CONTEXT_SCHEMA = "t1 long, t2 long, start long, windows int, reach int, rank long, copies int, symbols binary"


def _contexts_of(unit: Unit):
    names = [x.split()[0] for x in CONTEXT_SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())

    def run(batches):
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in ("t1", "t2", "text", "wanted")}
            data, offsets = flat(batch.column(at["text"]))
            t1s, t2s = batch.column(at["t1"]).to_pylist(), batch.column(at["t2"]).to_pylist()
            for i, j in chunks(offsets):
                symbols, own = symbols_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit)
                raw, size, rows = memoryview(np.ascontiguousarray(symbols)).cast("B"), symbols.dtype.itemsize, []
                for r in range(i, j):
                    base = int(own[r - i])
                    for w in batch.column(at["wanted"])[r].as_py():
                        a = base + w["start"]
                        rows.append((t1s[r], t2s[r], w["start"], w["windows"], w["reach"], w["rank"], w["copies"], bytes(raw[a * size : (a + w["windows"] - 1 + unit.window) * size])))
                    if len(rows) >= 10_000 or r == j - 1 and rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []

    return run


STRETCH_SCHEMA = "t1 long, t2 long, start long, part int, low int, high int, reach int, copies int, old long, core long, whole long"


def _stretches_of(unit: Unit, length: int):
    """Cuts the windows of each context, or those in its parts of the round before, into stretches of ``length`` by their distance to the anchor.
    ``old`` is made of the rank of the part around a stretch, or of the seed's in the first round."""
    window, kind = unit.window, np.uint64 if unit.words else np.uint8

    def run(batches):
        for batch in batches:
            col = lambda n: batch.column(batch.schema.get_field_index(n))
            n = batch.num_rows
            if not n:
                continue
            raw = col("symbols")
            offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + n + 1].astype(np.int64)
            data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)
            offsets = (offsets - offsets[0]) // data.itemsize
            windows, reach = (col(k).to_numpy() for k in ("windows", "reach"))
            least = reach - windows + 1  # distances run from here to reach
            parts = col("parts")
            cut = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + n + 1].astype(np.int64)
            inner = parts.values.slice(cut[0], cut[-1] - cut[0])
            outer, rank = inner.field("part").to_numpy().astype(np.int64), inner.field("rank").to_numpy()
            row = np.repeat(np.arange(n), np.diff(cut))
            wide = col("wide").to_numpy().astype(np.int64)[row]  # of the parts
            a = np.maximum(outer * wide, least[row]) // length
            b = np.minimum(outer * wide + wide - 1, reach[row]) // length
            row, rank, part = np.repeat(row, b - a + 1), np.repeat(rank, b - a + 1), spread(a, b - a + 1)
            low, high = np.maximum(part * length, least[row]), np.minimum(part * length + length - 1, reach[row])
            for i in range(0, len(row), 1 << 18):
                s = slice(i, i + (1 << 18))
                yield named(data, offsets, row[s], rank[s], part[s], low[s], high[s], reach, col)

    def named(data, offsets, row, rank, part, low, high, reach, col):
        core, whole = np.empty(len(row), np.uint64), np.empty(len(row), np.uint64)
        anchor = offsets[row] + reach[row]
        i = 0
        while i < len(row):  # contexts are taken together as long as they fit the table of powers
            base = offsets[row[i]]
            j = int(np.searchsorted(offsets[row + 1], base + _SPAN, "right"))
            j = max(i + 1, min(j, len(row)))
            sums = prefix_sums(data[base : offsets[row[j - 1] + 1]])
            at = anchor[i:j] - base
            core[i:j] = substring_hash(sums, at - part[i:j] * length, at - (part[i:j] + 1) * length + 1 + window)
            whole[i:j] = substring_hash(sums, at - high[i:j], at - low[i:j] + window)
            i = j
        old = mix(rank.view(np.uint64) ^ mix((part * 1024 + length).astype(np.uint64)))
        whole = mix(whole ^ mix((low * 4096 + high).astype(np.uint64)))
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [col("t1").take(take), col("t2").take(take), col("start").take(take), pa.array(part, pa.int32()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), col("reach").take(take), col("copies").take(take), *(pa.array(x.view(np.int64)) for x in (old, core, whole))],
            names=[x.split()[0] for x in STRETCH_SCHEMA.split(", ")],
        )

    return run


def _with_hashes(df: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"t1": F.xxhash64(t), "t2": F.xxhash64(F.lit(7), t)})


def _distinct(df: DataFrame, text: str, unit: Unit) -> DataFrame:
    """(t1, t2, text), once for each text that is long enough for a window. Copies are dropped before the shuffle and after it."""
    long = F.octet_length(text) >= (2 * unit.window - 1 if unit.words else unit.window)
    return _with_hashes(df.where(long).select(F.col(text).alias("text")), "text").groupBy("t1", "t2").agg(F.first("text").alias("text"))


def repeats(df: DataFrame, text: str = "text", unit: Unit = BYTES, release: bool = True) -> DataFrame:
    """(t1, t2, low, high): stretches of symbols, of the texts with these hashes, that repeated windows cover. Stretches of one text may overlap.

    ``release``: have the driver collect garbage between rounds, so that shuffle files of finished ones don't add up on disk; a shared driver may rather not.
    """
    spark = df.sparkSession
    hashed = _with_hashes(df.select(F.col(text).alias("text")), "text").select("t1", "t2", "text")
    long = F.octet_length("text") >= (2 * unit.window - 1 if unit.words else unit.window)
    found = stored(hashed.where(long).mapInArrow(trimmed(_blocks_of(unit)), BLOCK_SCHEMA), "blocks")
    ranked = stored(found.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("t1", "t2", "start", "windows", "reach")).alias("at")), "ranked")
    release_shuffles(spark, release)
    twice = ranked.where("copies > 1").select("rank", "block")
    whole = found.join(twice, ["rank", "block"], "left_semi").select("t1", "t2", F.col("start").alias("low"), (F.col("start") + F.col("windows") - 1 + unit.window).alias("high"))
    covered = [stored(whole.distinct(), "covered")]
    release_shuffles(spark, release)
    discard_table(found)
    shared_ranks = ranked.groupBy("rank").count().where("count > 1").select("rank")
    unsettled = ranked.join(shared_ranks, "rank", "left_semi").select("at.*", "rank", F.least("copies", F.lit(2)).cast("int").alias("copies"))
    wanted = unsettled.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "windows", "reach", "rank", "copies")).alias("wanted"))  # no more than the text has blocks
    contexts = stored(_distinct(df, text, unit).join(wanted, ["t1", "t2"]).mapInArrow(trimmed(_contexts_of(unit)), CONTEXT_SCHEMA), "contexts")
    release_shuffles(spark, release)
    discard_table(ranked)
    todo = contexts.withColumns({"parts": F.array(F.struct(F.lit(0).alias("part"), "rank")), "wide": F.lit(2 * unit.window)})
    for length in unit.stretches:
        cut = stored(todo.mapInArrow(trimmed(_stretches_of(unit, length)), STRETCH_SCHEMA), "stretches")
        one = F.struct("t1", "t2", "start", "part")
        whole = cut.groupBy("old", "core", "whole").agg(F.sum("copies").alias("n"), F.min(one).alias("one"))
        alike = whole.groupBy("old", "core").agg(F.sum("n").alias("m"), F.min("n").alias("least")).where("m > 1")
        status = whole.join(alike, ["old", "core"]).select("old", "core", "whole", "n", "one", "least")
        # Unsettled stretches carry on, and one of each repeat whose windows they may hold; with them goes the rank of the pair.
        carry = (F.col("n") == 1) | ((F.col("least") == 1) & (F.col("one") == one))
        known = cut.join(status, ["old", "core", "whole"]).select("t1", "t2", "start", "part", "low", "high", "reach", (F.col("n") > 1).alias("done"), carry.alias("carry"), F.xxhash64("old", "core").alias("rank"))
        known = stored(known.where("done or carry"), "known")
        at = F.col("start") + F.col("reach")
        covered.append(known.where("done").select("t1", "t2", (at - F.col("high")).alias("low"), (at - F.col("low") + unit.window).alias("high")))
        discard_table(cut)
        release_shuffles(spark, release)
        if length == 1:
            break
        parts = known.where("carry").select("t1", "t2", "start", "part", "rank").distinct().groupBy("t1", "t2", "start").agg(F.collect_list(F.struct("part", "rank")).alias("parts"))  # no more than the context has
        todo = contexts.join(parts, ["t1", "t2", "start"]).withColumn("wide", F.lit(length))
    discard_table(contexts)
    out = covered[0]
    for c in covered[1:]:
        out = out.union(c)
    return out


def _merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans by their beginning, with those that touch or overlap in one."""
    order = np.argsort(low, kind="stable")
    low, reached = low[order], np.maximum.accumulate(high[order])
    fresh = np.ones(len(low), bool)
    fresh[1:] = low[1:] > reached[:-1]
    return low[fresh], reached[np.append(np.flatnonzero(fresh)[1:] - 1, len(low) - 1)]


def _row_spans(column: pa.ListArray):
    """The merged spans of every row."""
    cuts = np.asarray(column.offsets).astype(np.int64)
    low, high = (column.values.field(k).to_numpy() for k in ("low", "high"))
    for a, b in zip(cuts, cuts[1:]):
        yield _merged(low[a:b], high[a:b])


def _spans(df: DataFrame, text: str, unit: Unit, release: bool) -> DataFrame:
    """(t1, t2, found): the spans of every text that has some, as they were found."""
    return repeats(df, text, unit, release).distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("low", "high")).alias("found"))  # in proportion to the text


def _cut_out(batches):
    names = ["t1", "t2", "kept", "spans"]
    for batch in batches:
        col = lambda n: batch.column(batch.schema.get_field_index(n))
        data, offsets = flat(col("text"))
        kept, lows, highs, ends, rows, held = [], [], [], [0], 0, 0

        def made(upto):
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (lows, highs)], names=["low", "high"])
            return pa.RecordBatch.from_arrays([*(col(k).slice(upto - len(kept), len(kept)) for k in ("t1", "t2")), pa.array(kept, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], names=names)

        for r, (low, high) in enumerate(_row_spans(col("found"))):
            raw = memoryview(data)[offsets[r] : offsets[r + 1]]
            edges = [0, *np.stack([low, high], 1).ravel().tolist(), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            lows.append(low)
            highs.append(high)
            ends.append(ends[-1] + len(low))
            held += len(kept[-1])
            if held > CHUNK_BYTES:
                yield made(r + 1)
                kept, lows, highs, ends, held = [], [], [], [0], 0
        if kept:
            yield made(batch.num_rows)


def kept_texts(df: DataFrame, text: str = "text", release: bool = True) -> DataFrame:
    """(t1, t2, kept, spans) for every different text that loses bytes: what is left of it, as binary since cuts may fall within a character, and the
    removed runs of bytes, apart and in order. ``t1`` and ``t2`` are ``xxhash64(text)`` and ``xxhash64(7, text)``."""
    return _distinct(df, text, BYTES).join(_spans(df, text, BYTES, release), ["t1", "t2"]).mapInArrow(trimmed(_cut_out), "t1 long, t2 long, kept binary, spans array<struct<low:bigint,high:bigint>>")


def shared_passages(df: DataFrame, text: str = "text", unit: Unit = WORDS, release: bool = True) -> DataFrame:
    """(t1, t2, n_passage_words) for every different text that has some: words in passages of ``unit.window`` words that also start anywhere else, in this text or another."""

    def run(batches):
        for batch in batches:
            counts = [int((high - low).sum()) for low, high in _row_spans(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["t1", "t2", "n_passage_words"])

    return _spans(df, text, unit, release).mapInArrow(trimmed(run), "t1 long, t2 long, n_passage_words long")


def removed(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), passages: bool = False, release: bool = True) -> DataFrame:
    """The columns to keep, n_bytes, n_removed, n_spans and kept_sha256 for every row; with ``passages``, n_kept, n_passage_words and has_passage too.

    Every byte that lies in a string of 400 bytes that also starts anywhere else, in the same text or another, is removed; strings are
    judged on the input. Repeated rows and equal texts of 400 bytes or more remove each other whole. Null texts count as empty.
    Shorter texts stay as they are. An empty table gives an empty table. Extra columns are ignored. Passages are runs of over 50 words that
    occur twice, whatever the blanks between them and however few bytes they have; they are counted, not removed.
    """
    # What is kept travels in one struct, so none of it clashes with what is found.
    rows = _with_hashes(df.select(F.struct(*keep).alias("__row"), F.col(text).alias("__text")), "__text")
    rows = rows.select("__row", "t1", "t2", F.octet_length(F.coalesce("__text", F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce("__text", F.lit("")), 256).alias("whole"))
    sizes = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    found = stored(kept_texts(df, text, release).select("t1", "t2", sizes.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), "removed")
    release_shuffles(df.sparkSession, release)
    if passages:
        found = found.join(stored(shared_passages(df, text, WORDS, release), "passages"), ["t1", "t2"], "full")
        release_shuffles(df.sparkSession, release)
    joined = rows.join(found, ["t1", "t2"], "left")
    zero = F.lit(0).cast("long")
    n_removed = F.coalesce("n_removed", zero)
    out = [*(F.col("__row")[k].alias(k) for k in keep), "n_bytes", n_removed.alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")]
    if passages:
        words = F.coalesce("n_passage_words", zero)
        out += [(F.col("n_bytes") - n_removed).alias("n_kept"), words.alias("n_passage_words"), (words > 0).alias("has_passage")]
    return joined.select(*out)
