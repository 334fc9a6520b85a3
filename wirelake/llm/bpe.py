"""Byte-level BPE without regular expressions.

Pre-tokenisation runs on arrays. Every code point gets a class, every class with its look-ahead a
symbol, and every symbol is a function from automaton states to automaton states. Functions compose
associatively, so blocks are scanned side by side for all entry states, the block functions are
scanned in turn, and a last pass knows the state before each code point. Slices then go through a
cache of merged pieces; only pieces not seen before are merged, many of them at once.

The pattern is the usual one: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._text import CHUNK_BYTES, KEEP, chunks, flat, spread, trimmed, word_loads

# ---------------------------------------------------------------- classes

LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers that Unicode 16 added; Python's tables may be older.
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


@functools.cache
def code_point_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(cp))[0])
        if kind is not None:
            table[cp] = kind
    for ranges, kind in ((_NEW_LETTERS, LETTER), (_NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            table[a : b + 1] = kind
    table[list(_WHITE)] = SPACE
    table[0x20] = BLANK
    return table


# ---------------------------------------------------------------- the automaton

#: States: between tokens; in a run of letters, numbers, others, white space; after a blank that the
#: next run takes; with one or two characters of a contraction to come.
_FREE, _L, _N, _O, _W, _BLANK, _C1, _C2 = range(8)
#: Symbols: letter, number, other; the last white space before a token (a blank, another); white space
#: before white space or the end; an apostrophe before a contraction of one or two letters.
_S_LAST_BLANK, _S_LAST_WHITE, _S_WHITE, _S_Q1, _S_Q2 = 3, 4, 5, 6, 7
#: Added to the symbol of a text's first code point: the state before it is _FREE whatever came before.
_FIRST = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token begins here."""
    if symbol >= _FIRST:
        state, symbol = _FREE, symbol - _FIRST
    if state == _C1:
        return _FREE, False
    if state == _C2:
        return _C1, False
    if symbol <= OTHER:
        run = (_L, _N, _O)[symbol]
        return run, state not in (run, _BLANK)
    if symbol == _S_LAST_BLANK:
        return _BLANK, True
    if symbol == _S_LAST_WHITE:
        return _FREE, True
    if symbol == _S_WHITE:
        return _W, state != _W
    if state in (_O, _BLANK):
        return _O, False
    return (_C1 if symbol == _S_Q1 else _C2), True


_STEPS = [_step(i & 7, i >> 3) for i in range(128)]
_NEXT = bytes(s for s, _ in _STEPS) + bytes(128)
_BEGINS = bytes(int(b) for _, b in _STEPS) + bytes(128)
_BLOCK = 64


def _translate(a: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(a.tobytes().translate(table), np.uint8).reshape(a.shape)


def _entries(functions: np.ndarray) -> np.ndarray:
    """functions[s, b]: the state after block b when s was before it. The state before each block, from _FREE on."""
    m = functions.shape[1]
    if m <= _BLOCK:
        out, state = np.empty(m, np.uint8), _FREE
        for b in range(m):
            out[b] = state
            state = functions[state, b]
        return out
    groups = -(-m // _BLOCK)
    padded = np.repeat(np.arange(8, dtype=np.uint8)[:, None], groups * _BLOCK, 1)
    padded[:, :m] = functions
    cube = padded.reshape(8, groups, _BLOCK)
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], groups, 1)
    at = np.arange(groups)
    for j in range(_BLOCK):
        whole = cube[whole, at, j]
    state = _entries(whole)
    out = np.empty((groups, _BLOCK), np.uint8)
    for j in range(_BLOCK):
        out[:, j] = state
        state = cube[state, at, j]
    return out.ravel()[:m]


def token_begins(symbols: np.ndarray) -> np.ndarray:
    """A mask of the code points at which a token begins."""
    n = len(symbols)
    if not n:
        return np.zeros(0, bool)
    m = -(-n // _BLOCK)
    padded = np.zeros(m * _BLOCK, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(m, _BLOCK).T) << 3
    functions = np.repeat(np.arange(8, dtype=np.uint8)[:, None], m, 1)
    for j in range(_BLOCK):
        functions = _translate(columns[j] | functions, _NEXT)
    state = _entries(functions)
    before = np.empty((_BLOCK, m), np.uint8)
    for j in range(_BLOCK):
        np.bitwise_or(columns[j], state, out=before[j])
        state = _translate(before[j], _NEXT)
    return np.ascontiguousarray(_translate(before, _BEGINS).T).ravel()[:n].astype(bool)


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens of texts laid end to end, and per text the number of pre-tokens before it (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    where = np.flatnonzero((data & 0xC0) != 0x80)
    symbols = code_point_classes()[cps]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1][where]  # an empty text shares its start with the next one
    last = np.append(first[1:], True)
    white = symbols >= BLANK
    then = np.append(white[1:], True) | last
    symbols[white & then] = _S_WHITE
    quotes = np.flatnonzero((cps == 0x27) & ~last)
    if len(quotes):
        one = cps[quotes + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        symbols[quotes[short]] = _S_Q1
        rest = quotes[~short & ~last[quotes + 1]]
        one, two = cps[rest + 1], cps[rest + 2]
        pairs = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        symbols[rest[pairs]] = _S_Q2
    symbols[first] |= _FIRST
    begins = token_begins(symbols)
    starts = where[begins]
    return starts, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- vocabularies and merging


class Vocabulary:
    """Ranks of a byte-level BPE with the table of pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        words = [b""] * size
        for word, rank in ranks.items():
            words[rank] = word
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for word, rank in ranks.items():
            for k in range(1, len(word)):
                a, b = ranks.get(word[:k]), ranks.get(word[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    @staticmethod
    def from_file(path: str) -> "Vocabulary":
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    NEVER = np.iinfo(np.int64).max

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.pair_keys):
            return np.full(a.shape, self.NEVER)
        keys = a << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], self.NEVER)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece; pieces of one length are merged side by side."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.array([rank])
            elif len(piece) > 64:
                out[i] = np.array(self._merge_long(piece))
            else:
                by_length.setdefault(len(piece), []).append(i)
        for length, rows in by_length.items():
            for k in range(0, len(rows), 1 << 16):
                part = np.array(rows[k : k + (1 << 16)])
                ids = self.single[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8).reshape(-1, length)]
                for i, x in zip(part, self._merge_block(ids)):
                    out[i] = x
        return out

    def _merge_block(self, ids: np.ndarray) -> list[np.ndarray]:
        done: list[np.ndarray] = [None] * len(ids)  # type: ignore[list-item]
        rows = np.arange(len(ids))
        ranks = self.pair_rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            width = ids.shape[1]
            at = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            line = np.arange(len(rows))
            best = ranks[line, at] if width > 1 else np.full(len(rows), self.NEVER)
            over = best == self.NEVER
            if over.any():
                for i, x in zip(rows[over], ids[over]):
                    done[i] = x
                keep = ~over
                rows, ids, ranks, at, best = rows[keep], ids[keep], ranks[keep], at[keep], best[keep]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            ids[line, at] = best
            stay = np.ones(ids.shape, bool)
            stay[line, at + 1] = False
            ids = ids[stay].reshape(len(rows), width - 1)
            ranks = ranks[stay[:, 1:]].reshape(len(rows), width - 2)
            left, right = at > 0, at < width - 2
            if left.any():
                x, p = line[left], at[left]
                ranks[x, p - 1] = self.pair_rank(ids[x, p - 1], ids[x, p])
            if right.any():
                x, p = line[right], at[right]
                ranks[x, p] = self.pair_rank(ids[x, p], ids[x, p + 1])
        return done

    def _merge_long(self, piece: bytes) -> list[int]:
        """One long piece, by a heap over a linked list: n log n."""
        ids = [int(self.single[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        pairs = self.pairs
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                heap.append((rank, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b or ids[i] != a:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    new = pairs.get(ids[x] << 32 | ids[y])
                    if new is not None:
                        heapq.heappush(heap, (new, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        return self.bytes[spread(self.starts[ids], self.lengths[ids])]

    def token_offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset at which each token's bytes begin."""
        lengths = self.lengths[ids]
        return np.cumsum(lengths) - lengths


class PieceCache:
    """Ids of the pieces met so far. Pieces of up to 15 bytes are found by arrays: an exact key of two
    words in an open table with two places for each; longer ones by a dictionary. Both are emptied once
    they hold ``most`` pieces, so memory is bounded.
    """

    def __init__(self, merge: Callable[[list[bytes]], list[np.ndarray]], most: int = 1 << 19, bits: int = 20):
        self.merge, self.most, self.bits = merge, most, bits
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.key0, self.key1, self.piece = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.long: dict[bytes, int] = {}
        self.n = self.n_flat = 0
        self.offsets, self.counts, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32)

    def _slots(self, w0: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = (w0 ^ (w1 * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B185EBCA87)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x165667B19E3779F9)
        shift = np.uint64(64 - self.bits)
        return (mixed >> shift).astype(np.int64), ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        new = self.merge(pieces)
        counts = np.fromiter(map(len, new), np.int64, len(new))
        total, n = int(counts.sum()), len(new)
        while self.n + n > len(self.offsets):
            self.offsets, self.counts = np.concatenate([self.offsets, np.zeros_like(self.offsets)]), np.concatenate([self.counts, np.zeros_like(self.counts)])
        while self.n_flat + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        at = np.arange(self.n, self.n + n)
        self.counts[at] = counts
        self.offsets[at] = self.n_flat + np.cumsum(counts) - counts
        if n:
            self.ids[self.n_flat : self.n_flat + total] = np.concatenate(new)
        self.n, self.n_flat = self.n + n, self.n_flat + total
        return at

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece data[starts[i]:ends[i]]; good until the next call."""
        if self.n > self.most:
            self.clear()
        lengths = ends - starts
        found = np.full(len(starts), -1, np.int64)
        short = lengths <= 15
        if not short.all():
            raw = memoryview(data)
            rest = np.flatnonzero(~short)
            slices = [bytes(raw[a:b]) for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
            unseen = [x for x in dict.fromkeys(slices) if x not in self.long]
            self.long.update(zip(unseen, self._add(unseen).tolist()))
            found[rest] = np.fromiter(map(self.long.__getitem__, slices), np.int64, len(slices))
        loads = word_loads(data)
        starts, lengths = starts[short], lengths[short]
        head = np.minimum(lengths, 8)
        w0 = loads[starts] & KEEP[head]
        w1 = (loads[np.minimum(starts + 8, len(data))] & KEEP[lengths - head]) | (lengths.astype(np.uint64) << np.uint64(56))
        one, two = self._slots(w0, w1)
        got = self._look(w0, w1, one, two)
        missing = np.flatnonzero(got < 0)
        if len(missing):
            m0, m1 = w0[missing], w1[missing]
            order = np.lexsort((m0, m1))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (m0[order][1:] != m0[order][:-1]) | (m1[order][1:] != m1[order][:-1])
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(fresh) - 1
            chosen = missing[order[fresh]]
            raw = memoryview(data)
            at = self._add([bytes(raw[a : a + k]) for a, k in zip(starts[chosen].tolist(), lengths[chosen].tolist())])
            got[missing] = at[number]
            for places in (one, two):  # a place that is taken stays as it is
                slots = places[chosen]
                free = self.key1[slots] == 0
                left = slots[free]
                self.key0[left], self.key1[left], self.piece[left] = w0[chosen[free]], w1[chosen[free]], at[free]
                placed = (self.key0[slots] == w0[chosen]) & (self.key1[slots] == w1[chosen])
                chosen, at = chosen[~placed], at[~placed]
        found[short] = got
        return found

    def _look(self, w0, w1, one, two) -> np.ndarray:
        got = np.full(len(w0), -1, np.int64)
        hit = (self.key0[one] == w0) & (self.key1[one] == w1)
        got[hit] = self.piece[one[hit]]
        rest = np.flatnonzero(~hit)
        if len(rest):
            s = two[rest]
            hit = (self.key0[s] == w0[rest]) & (self.key1[s] == w1[rest])
            got[rest[hit]] = self.piece[s[hit]]
        return got


def encode_flat(data: np.ndarray, offsets: np.ndarray, cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts laid end to end, and the n + 1 offsets of each text's ids. A text that is long and alone goes in pieces."""
    if len(offsets) == 2 and len(data) > 2 * CHUNK_BYTES:
        cuts = safe_cuts(data, CHUNK_BYTES)
        ids = np.concatenate([_encode(data[a:b], np.array([0, b - a]), cache)[0] for a, b in zip(cuts, cuts[1:])])
        return ids, np.array([0, len(ids)])
    return _encode(data, offsets, cache)


def _encode(data, offsets, cache):
    starts, before = pretokens(data, offsets)
    pieces = cache.find(data, starts, np.append(starts[1:], len(data)))
    counts = cache.counts[pieces]
    ids = cache.ids[spread(cache.offsets[pieces], counts)]
    return ids, np.concatenate([[0], np.cumsum(counts)])[before]


def safe_cuts(data: np.ndarray, size: int = CHUNK_BYTES) -> list[int]:
    """0, places about so far apart at which a token begins whatever stands around, and the length. Such is a
    single blank or line break between two visible ASCII characters: what is before it ends there, and it looks no further back."""
    cuts, n = [0], len(data)
    while n - cuts[-1] > size:
        at = cuts[-1] + size
        while at < n:
            part = data[at - 1 : at + size + 2]
            shown = (part > 0x20) & (part < 0x7F)
            found = np.flatnonzero(shown[:-2] & shown[2:] & ((part[1:-1] == 0x20) | (part[1:-1] == 0x0A)))
            if len(found):
                cuts.append(at + int(found[0]))
                break
            at += size
        else:
            break
    return [*cuts, n]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.from_file(path)


@functools.lru_cache(maxsize=4)
def piece_cache(path: str) -> PieceCache:
    return PieceCache(vocabulary(path).merge)


def encoded_chunks(column: pa.Array, cache: PieceCache) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, ids, offsets) for pieces of a column of bounded bytes."""
    data, offsets = flat(column)
    for i, j in chunks(offsets):
        part = data[offsets[i] : offsets[j]]
        ids, at = encode_flat(part, offsets[i : j + 1] - offsets[i], cache)
        yield i, j, ids, at


# ---------------------------------------------------------------- DataFrame operators


def encode(df: DataFrame, vocab_path: str, text: str = "text", out: str = "tokens", offsets: bool = False) -> DataFrame:
    """Adds ``out`` (array<int>) and, if asked for, ``out``_offsets (array<long>: the byte at which each token begins).

    A null text counts as empty and gives an empty array. Other columns pass unchanged; a column that is
    already called ``out`` is replaced. Rows are independent: no shuffle.
    """
    extra = [(out, T.ArrayType(T.IntegerType()))] + [(f"{out}_offsets", T.ArrayType(T.LongType()))] * offsets
    kept = [f for f in df.schema.fields if f.name not in dict(extra)]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in extra])
    names = [f.name for f in kept]

    def run(batches):
        cache, vocab = piece_cache(vocab_path), vocabulary(vocab_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            others = batch.select(names)
            for i, j, ids, at in encoded_chunks(column, cache):
                arrays = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
                if offsets:
                    where = vocab.token_offsets(ids)
                    counts = np.diff(at)
                    firsts = np.append(where, 0)[np.minimum(at[:-1], len(where))]
                    arrays.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(where - np.repeat(firsts, counts), pa.int64())))
                yield pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in others.columns] + arrays, names=names + [n for n, _ in extra])

    return df.mapInArrow(trimmed(run), schema)


def decode(df: DataFrame, vocab_path: str, tokens: str = "tokens", out: str = "decoded") -> DataFrame:
    """Adds the bytes of a column of ids. Null or no ids: no bytes. An id outside the vocabulary is an error."""
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField(out, T.BinaryType())])

    def run(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(tokens)).to_pylist()
            made = [vocab.decode(np.array(r, np.int64)).tobytes() if r else b"" for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(made, pa.binary())], names=[*names, out])

    return df.mapInArrow(trimmed(run), schema)


DIGEST_SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(df: DataFrame, vocab_path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes each text, decodes the ids and returns the keys, n_tokens and the digests of ids (little-endian unsigned 32-bit) and decoded bytes."""
    named = {f.name: f for f in df.schema.fields}
    schema = T.StructType([named[k] for k in keys] + T.StructType.fromDDL(DIGEST_SCHEMA).fields)

    def run(batches):
        cache, vocab = piece_cache(vocab_path), vocabulary(vocab_path)
        for batch in batches:
            for i, j, ids, at in encoded_chunks(batch.column(batch.schema.get_field_index(text)), cache):
                lengths = vocab.lengths[ids]
                back = vocab.bytes[spread(vocab.starts[ids], lengths)]
                ends = np.concatenate([[0], np.cumsum(lengths)])[at].tolist()
                raw, decoded, cut = memoryview(ids.astype("<u4")), memoryview(back), at.tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(k)).slice(i, j - i) for k in keys]
                    + [
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut, cut[1:])], pa.string()),
                        pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
                    ],
                    names=schema.names,
                )

    return df.select(*keys, text).mapInArrow(trimmed(run), schema)
