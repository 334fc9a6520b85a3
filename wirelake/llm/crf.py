"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad, by features of its own and of the lines beside it and by its neighbours' states. Only
documents have labels, so states of lines are latent in training: a label says what most of a document's text is
like, and which lines differ follows from the lines. Forward and backward messages are products of 2 x 2 matrices, which are associative: all lines of all texts
at hand form one chain that restarts at each text, and it is scanned in blocks side by side. A document's
score is the mean marginal of its lines, weighted by their length.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import chunks, flat, spread, trimmed, word_loads
from .shared import stored
from .simhash import xxh64

FEATURES = ("log_bytes", "log_words", "word_bytes", "symbols", "digits", "capitals", "high_bytes", "ends_sentence", "same_as_last_word", "seen_words", "seen_pairs", "seen_line", "empty", "bars")
BAD, GOOD = 0, 1
_BLOCK = 32
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_END = np.isin(np.arange(256), list(b".!?:;"))

# ---------------------------------------------------------------- lines and their features


def _seen(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the same value came earlier for the same owner."""
    order = np.lexsort((np.arange(len(value)), value, owner))
    again = np.zeros(len(value), bool)
    if len(value) > 1:
        again[order[1:]] = (value[order[1:]] == value[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return again


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of texts laid end to end, and per text the number of lines before it (n + 1 entries). An empty text is one empty line."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    text = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], offsets[text + 1])
    return starts, ends, np.searchsorted(text, np.arange(n + 1))


def word_hashes(data: np.ndarray, word: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 of words; of those over 64 bytes, a sum over their pieces of 64 bytes and the places of these."""
    loads = word_loads(data)
    out = np.empty(len(word), np.uint64)
    long = length > 64
    out[~long] = xxh64(loads, word[~long], length[~long])
    if long.any():
        pieces = -(-length[long] // 64)
        place = spread(np.zeros(len(pieces), np.int64), pieces)
        at = np.repeat(word[long], pieces) + 64 * place
        each = xxh64(loads, at, np.minimum(64, np.repeat(word[long] + length[long], pieces) - at))
        each = (each ^ (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x165667B19E3779F9)
        out[long] = np.add.reduceat(each ^ (each >> np.uint64(29)), np.cumsum(pieces) - pieces) + length[long].astype(np.uint64)
    return out


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with those of the line before and after it in its text (zeros at the edges), its length, and the line offsets of the texts."""
    starts, ends, before = lines_of(data, offsets)
    n = len(starts)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    size = (ends - starts).astype(np.float64)

    def count(mask):
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[ends] - sums[starts]).astype(np.float64)

    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    opens = ~white
    if len(data):
        opens[1:] &= white[:-1]
        first = offsets[:-1][offsets[:-1] < len(data)]
        opens[first] = ~white[first]
    word = np.flatnonzero(opens)
    stop = np.flatnonzero(white)
    word_end = np.append(stop, len(data))[np.searchsorted(stop, word)]
    owner_text = np.searchsorted(offsets, word, "right") - 1
    word_end = np.minimum(word_end, offsets[1:][owner_text])
    line = np.searchsorted(starts, word, "right") - 1
    length = word_end - word
    hashes = word_hashes(data, word, length)
    words = np.bincount(line, minlength=n).astype(np.float64)
    same = np.zeros(len(word), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner_text[1:] == owner_text[:-1])
    pair = hashes.copy()
    pair[1:] += hashes[:-1] * np.uint64(0x9E3779B185EBCA87)
    place = np.arange(len(word)) - np.searchsorted(word, starts)[line]
    mixed = (hashes ^ (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    bounds = np.searchsorted(word, np.append(starts, len(data)))
    whole = sums[bounds[1:]] - sums[bounds[:-1]]
    share = lambda mask: np.bincount(line, mask, n) / np.maximum(words, 1)
    last = np.zeros(n, bool)
    full = ends > starts
    last[full] = _END[data[ends[full] - 1]]
    f = np.stack(
        [
            np.log1p(size), np.log1p(words), count(~white) / np.maximum(words, 1) / 10, count(_SYMBOLS[data]) / np.maximum(size, 1) * 5, count((data >= 0x30) & (data <= 0x39)) / np.maximum(size, 1) * 5,
            count((data >= 0x41) & (data <= 0x5A)) / np.maximum(size, 1) * 5, count(data >= 0x80) / np.maximum(size, 1), last.astype(float), share(same), share(_seen(owner_text, hashes)),
            share(_seen(owner_text, pair)), (_seen(text, whole) & (words > 0)).astype(float), (words == 0).astype(float), np.log1p(count(data == 0x7C)),
        ],
        1,
    )
    joined = np.zeros((n, 3 * f.shape[1] + 1))
    k = f.shape[1]
    joined[:, :k] = f
    inner = np.flatnonzero(text[1:] == text[:-1])
    joined[inner + 1, k : 2 * k] = f[inner]
    joined[inner, 2 * k : 3 * k] = f[inner + 1]
    joined[:, -1] = 1
    return joined, np.maximum(size, 1), before


# ---------------------------------------------------------------- the chain


def _entries(matrices: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The normalised row vector before each of the 2 x 2 matrices (n, 2, 2), from ``start`` on: a scan in blocks."""
    n = len(matrices)
    if n <= 2 * _BLOCK:
        out, v = np.empty((n, 2)), start
        for t in range(n):
            out[t] = v
            v = v @ matrices[t]
            v = v / v.sum()
        return out
    m = -(-n // _BLOCK)
    padded = np.broadcast_to(np.eye(2), (m * _BLOCK, 2, 2)).copy()
    padded[:n] = matrices
    cube = padded.reshape(m, _BLOCK, 2, 2)
    whole = np.broadcast_to(np.eye(2), (m, 2, 2))
    for j in range(_BLOCK):
        whole = _product(whole, cube[:, j])
        whole = whole / whole.sum((1, 2), keepdims=True)
    v = _entries(whole, start)
    out = np.empty((m, _BLOCK, 2))
    for j in range(_BLOCK):
        out[:, j] = v
        a = cube[:, j]
        v = np.stack([v[:, 0] * a[:, 0, 0] + v[:, 1] * a[:, 1, 0], v[:, 0] * a[:, 0, 1] + v[:, 1] * a[:, 1, 1]], 1)
        v = v / v.sum(1, keepdims=True)
    return out.reshape(-1, 2)[:n]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(np.broadcast_shapes(a.shape, b.shape))
    for i in range(2):
        for j in range(2):
            out[:, i, j] = a[:, i, 0] * b[:, 0, j] + a[:, i, 1] * b[:, 1, j]
    return out


@dataclass
class Model:
    """weights: of the features for good; steps: log scores of a state after a state; begin: of the first line's state."""

    weights: np.ndarray
    steps: np.ndarray
    begin: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def marginals(self, features: np.ndarray, before: np.ndarray, pairs: np.ndarray | None = None, shift: np.ndarray | float = 0.0):
        """P(good) of every line, with ``shift`` added to the scores for good; with ``pairs``, weights of lines, also the expected steps between states by the weight of the later line."""
        n = len(features)
        score = np.clip((features - self.mean) / self.spread @ self.weights + shift, -30, 30)
        local = np.stack([np.ones(n), np.exp(score)], 1)
        local /= local.max(1, keepdims=True)
        fresh = np.zeros(n, bool)
        fresh[before[:-1]] = True
        steps = np.exp(self.steps - self.steps.max())
        begin = np.exp(self.begin - self.begin.max())
        into = np.where(fresh[:, None, None], np.broadcast_to(begin, (2, 2)), steps) * local[:, None, :]
        ahead = _entries(into, np.full(2, 0.5))
        alpha = np.stack([ahead[:, 0] * into[:, 0, 0] + ahead[:, 1] * into[:, 1, 0], ahead[:, 0] * into[:, 0, 1] + ahead[:, 1] * into[:, 1, 1]], 1)
        alpha /= alpha.sum(1, keepdims=True)
        # The message from behind: through the next line's matrix, or nothing after a text's last line.
        out_of = np.ones((n, 2, 2))
        out_of[:-1] = np.where(fresh[1:, None, None], 1.0, into[1:])
        beta = _entries(np.swapaxes(out_of[::-1], 1, 2)[:n], np.full(2, 0.5))[::-1]
        beta = np.stack([out_of[:, 0, 0] * beta[:, 0] + out_of[:, 0, 1] * beta[:, 1], out_of[:, 1, 0] * beta[:, 0] + out_of[:, 1, 1] * beta[:, 1]], 1)
        beta /= beta.sum(1, keepdims=True)
        both = alpha * beta
        good = both[:, 1] / both.sum(1)
        if pairs is None:
            return good
        inner = np.flatnonzero(~fresh)
        joint = alpha[inner - 1][:, :, None] * into[inner] * beta[inner][:, None, :]
        return good, (joint / joint.sum((1, 2), keepdims=True) * pairs[inner, None, None]).sum(0)

    def score(self, features: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Per text: its lines' marginals weighted by length."""
        if len(before) < 2:
            return np.zeros(0)
        good = self.marginals(features, before)
        return np.add.reduceat(good * size, before[:-1]) / np.add.reduceat(size, before[:-1])


def blank_model(k: int) -> Model:
    """Knows nothing: every score is a half."""
    return Model(np.zeros(k), np.zeros((2, 2)), np.zeros(2), np.zeros(k), np.ones(k))


#: A document labelled good holds good lines in at least that share of its length, one labelled bad in at most the rest.
MOSTLY = 0.6


def _constrained(model: Model, x: np.ndarray, before: np.ndarray, labels: np.ndarray, part: np.ndarray, weight: np.ndarray, steps: int = 10):
    """Marginals (and expected steps) of the nearest distribution to the model's in which every document is mostly of its label. The lines' scores shift by one
    number per document, in proportion to their share of the length, found by halving."""
    counts, firsts = np.diff(before), before[:-1]
    sign = np.where(labels == 1, 1.0, -1.0)
    # Shares of the length, against those of an even split, so that a shift means the same in short and long documents.
    pull = part * np.repeat(counts, counts)
    mean = lambda good: np.add.reduceat(good * part, firsts)
    holds = lambda good: np.where(labels == 1, mean(good) >= MOSTLY, mean(good) <= 1 - MOSTLY)
    low, high = np.zeros(len(counts)), np.full(len(counts), 30.0)
    high[holds(model.marginals(x, before))] = 0
    for _ in range(steps):
        middle = (low + high) / 2
        enough = holds(model.marginals(x, before, shift=np.repeat(sign * middle, counts) * pull))
        high, low = np.where(enough, middle, high), np.where(enough, low, middle)
    return model.marginals(x, before, weight, np.repeat(sign * high, counts) * pull)


def fit(features: np.ndarray, size: np.ndarray, before: np.ndarray, labels: np.ndarray, passes: int = 5, rounds: int = 40, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Expectation-maximisation with documents' labels as constraints on latent lines (posterior regularisation).

    It starts from each line's own features alone, with all lines labelled as their document, and without steps between states, so that lines of one document may
    differ from the beginning. Every pass takes the lines' distribution under the constraints and moves the field towards it, by Adam with
    squares of all weights added. Each document weighs the same whatever its length. Without documents, the model that knows nothing.
    """
    k = features.shape[1]
    if len(before) < 2:
        return blank_model(k)
    mean, spread_ = features.mean(0), features.std(0) + 1e-6
    mean[-1], spread_[-1] = 0, 1
    model = Model(np.zeros(k), np.zeros((2, 2)), np.zeros(2), mean, spread_)
    counts, firsts = np.diff(before), before[:-1]
    docs = len(counts)
    part = size / np.repeat(np.add.reduceat(size, firsts), counts)
    weight = np.repeat(1 / counts, counts)  # of a line in its document
    x = (features - mean) / spread_
    own = np.zeros(k, bool)
    own[: (k - 1) // 3] = own[-1] = True
    for n in range(passes + 1):
        if n:
            target, target_steps = _constrained(model, features, before, labels, part, weight)
        else:
            target = np.repeat(labels, counts).astype(np.float64)
        m = v = np.zeros(k + 6)
        for t in range(1, rounds + 1):
            good, expected = model.marginals(features, before, weight)
            begin = (weight[firsts] * (good[firsts] - target[firsts])).sum()
            grad = np.concatenate([x.T @ (weight * (target - good)), (target_steps - expected).ravel() if n else np.zeros(4), [begin, -begin] if n else np.zeros(2)]) / docs
            if not n:
                grad[:k][~own] = 0
            grad -= decay * np.concatenate([model.weights, model.steps.ravel(), model.begin])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            model.weights = model.weights + step[:k]
            model.steps = model.steps + step[k : k + 4].reshape(2, 2)
            model.begin = model.begin + step[k + 4 :]
    return model


# ---------------------------------------------------------------- DataFrame operators


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", most_documents: int = 4000, most_lines: int = 400_000) -> Model:
    """Fits on a bounded sample of labelled rows that aren't held out.

    The ``most_documents`` labels with the least hashes of their keys are taken, and of their documents, in that order, those that come to no more than
    ``most_lines`` lines together. Only features reach the driver, 344 bytes a line at most. Null labels and keys are left out; documents that repeat a key all count.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~F.coalesce(held_out(key), F.lit(True)))
    sample = usable.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).orderBy(F.xxhash64("__key"), "__key", "__label").limit(most_documents)
    chosen = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(sample), "__key").select("__key", "__label", "__text")

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for i, j in chunks(offsets):
                features, size, before = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                packed = [pickle.dumps((features[a:b].astype(np.float32), size[a:b])) if b - a <= most_lines else None for a, b in zip(before, before[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(before)), pa.array(packed, pa.binary())], names=["key", "label", "n", "lines"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, label int, n long, lines binary"
    made = stored(chosen.mapInArrow(trimmed(run), schema).where("lines is not null"), "line-features")
    order = F.xxhash64("key"), "key", "label", "n", F.xxhash64("lines")
    listed = made.orderBy(*order).limit(most_documents)
    total = taken = 0
    for r in listed.select("n").collect():
        total += r.n
        if total > most_lines:
            break
        taken += 1
    rows = made.orderBy(*order).limit(taken).collect()
    width = 3 * len(FEATURES) + 1
    parts = [pickle.loads(r.lines) for r in rows]
    before = np.concatenate([[0], np.cumsum([len(p[1]) for p in parts])]).astype(np.int64)
    features = np.concatenate([p[0] for p in parts]).astype(np.float64) if parts else np.zeros((0, width))
    return fit(features, np.concatenate([p[1] for p in parts]) if parts else np.zeros(0), before, np.array([r.label for r in rows], np.float64))


def scored(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """(key, held_out, score, predicted) for every row. A null or empty text is one empty line. Extra columns are ignored; no rows give no rows."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for i, j in chunks(offsets):
                made = model.score(*line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.clip(made, 0, 1))], names=["key", "held_out", "score"])

    out = docs.select(F.col(key).alias("key"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), F.col(text)).mapInArrow(trimmed(run), f"key {kind}, held_out boolean, score double")
    return out.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def line_quality(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, line, good): the marginal of every line, as an array per row would hold it in order.

    A null or empty text is one empty line; rows that repeat give their lines as often. Extra columns are ignored; no rows give no rows."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in chunks(offsets):
                features, _, before = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                good = model.marginals(features, before)
                row = np.repeat(np.arange(i, j), np.diff(before))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.arange(len(good)) - np.repeat(before[:-1], np.diff(before))), pa.array(good)], names=["key", "line", "good"])

    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(trimmed(run), f"key {kind}, line long, good double").withColumnRenamed("key", key)
