"""Repeats, encoding, near duplicates and the pipeline: against brute force, and on odd tables."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from wirelake.llm import bpe, simhash, suffix_dedup
from wirelake.llm.queries import MULTI

PATH = public_tokenizers.path(MULTI)
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
PATTERN = regex.compile(public_tokenizers.PATTERN)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---------------------------------------------------------------- 8: repeats


def without_repeats(texts, window=400):
    seen = collections.Counter()
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        seen.update(raw[i : i + window] for i in range(len(raw) - window + 1))
    out = []
    for raw in raws:
        change = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - window + 1):
            if seen[raw[i : i + window]] > 1:
                change[i] += 1
                change[i + window] -= 1
        gone = np.cumsum(change[:-1]) > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return out


def repeated_texts(seed):
    r = random.Random(seed)
    prose = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = [prose(r.choice([380, 400, 401, 450, 700, 1500])) for _ in range(6)]
    texts = [None, "", "x" * 399, "x" * 401, "ab" * 500, prose(5000), "x" * 1200]
    for _ in range(40):
        parts = []
        for _ in range(r.randint(1, 5)):
            s = r.choice(shared)
            if r.random() < 0.5:
                k = r.randrange(len(s))
                s = s[:k] + r.choice(["", "Z", "QQ"]) + s[k + r.randint(0, 2) :]
            if r.random() < 0.4:
                a = r.randrange(len(s))
                s = s[a : a + r.randint(1, len(s))]
            parts += [s, prose(r.randint(0, 60))]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    texts = repeated_texts(seed)
    texts += [texts[9], texts[9]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = by_id(suffix_dedup.removed(df))
    for i, want in enumerate(without_repeats(texts)):
        x = got[i]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want, i


def test_long_texts_go_in_pieces(spark):
    """A text of more than a piece (1 MiB) meets its own passage and that of another text."""
    r = random.Random(5)
    prose = lambda n: "".join(r.choices("abcdefghijklmnop ", k=n))
    passage = prose(900)
    size = suffix_dedup._PIECE
    long = prose(size - 450) + "W" + passage + "X" + prose(300_000) + "Y" + passage[:500] + "Z" + prose(1000)
    df = spark.createDataFrame([(1, long), (2, "Q" + passage[200:] + "R"), (3, prose(2000))], "doc_id long, text string")
    got = by_id(suffix_dedup.removed(df))
    assert (got[1].n_removed, got[1].n_spans) == (900 + 500, 2) and (got[2].n_removed, got[3].n_removed) == (700, 0)


def test_repeats_on_odd_tables(docs, rows, empty):
    got = suffix_dedup.removed(docs).collect()
    want = collections.Counter((i, *w) for (i, *_), w in zip(rows, without_repeats([t for _, t, *_ in rows])))
    assert collections.Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want
    assert suffix_dedup.removed(empty).count() == 0


def test_copies_meet_once(spark):
    """A thousand equal texts and a variant: contexts are cut from distinct texts, and all copies go."""
    r = random.Random(7)
    prose = "".join(r.choices("abcdefgh ", k=1500))
    texts = [prose] * 1000 + [prose[:900] + "XYZ" + prose[900:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert suffix_dedup._distinct(df, "text", suffix_dedup.BYTES).count() == 2
    got = by_id(suffix_dedup.removed(df))
    assert got[0].n_removed == got[999].n_removed == 1500 and got[1000].n_removed == 1500 and got[1000].n_spans == 2


def test_short_passages_are_counted(spark):
    """Passages of over 50 words with few bytes lose nothing, but are told; 50 words aren't."""
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words[:51])), (1, "x " + "\n".join(words[:51]) + " y"), (2, " ".join(words[100:150])), (3, "z " + " ".join(words[100:150])), (4, None), (5, " ".join(words[200:320]))]
    got = by_id(suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string"), passages=True))
    assert [(got[i].n_passage_words, got[i].has_passage, got[i].n_removed) for i in range(6)] == [(51, True, 0), (51, True, 0)] + [(0, False, 0)] * 4


def test_names_tell_thue_morse_strings_apart():
    t = np.array([bin(i).count("1") & 1 for i in range(1024)], np.uint8)
    both = np.concatenate([97 + t, 98 - t]).astype(np.uint8)
    names = suffix_dedup.substring_hash(suffix_dedup.prefix_sums(both), np.array([0, 1024]), np.array([1024, 2048]))
    assert names[0] != names[1]


# ---------------------------------------------------------------- 9: encoding


def encoded(texts):
    out = []
    for _, _, ids, at in bpe.encoded_chunks(pa.array(texts, pa.string()), bpe.piece_cache(PATH)):
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab'sretvlmd  \n\t\r0९é中😀!?.-ſ  　Ω"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_encoding_is_tiktokens(texts):
    assert encoded(texts) == [ENCODING.encode_ordinary(t) for t in texts]


def test_pretokens_are_the_patterns():
    texts = ["I'm here, isn't   it?\n\n  ok  ", "'s's'll''re 'x", "a  b", "", "   ", "x'"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0] + [len(x) for x in raw])
    starts, before = bpe.pretokens(data, offsets)
    ends = np.append(starts[1:], len(data))
    for k, t in enumerate(texts):
        assert [bytes(data[a:b]).decode() for a, b in zip(starts[before[k] : before[k + 1]], ends[before[k] : before[k + 1]])] == PATTERN.findall(t)


def test_small_blocks_and_full_caches():
    texts = ["".join(random.Random(i).choices("abcdefgh 'st", k=300)) for i in range(50)]
    want = [ENCODING.encode_ordinary(t) for t in texts]
    cache = bpe.PieceCache(bpe.vocabulary(PATH).merge, most=50, bits=4)
    for _ in range(2):
        for t, w in zip(texts, want):
            data, offsets = np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])
            assert bpe.encode_flat(data, offsets, cache)[0].tolist() == w
    long = "z" * 70 + " " + "ab" * 2000
    assert encoded([long])[0] == ENCODING.encode_ordinary(long)


def test_long_texts_are_cut_where_it_is_safe(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 50)
    for seed in range(30):
        r = random.Random(seed)
        text = "".join(r.choices(["word", " ", "  ", "\n", "'s", "é", "中", "12", "!?", " don't", "\t"], k=400)) + "x" * 300
        data = np.frombuffer(text.encode(), np.uint8)
        cuts = bpe.safe_cuts(data, 50)
        assert cuts[0] == 0 and cuts[-1] == len(data) and len(cuts) > 5
        assert bpe.encode_flat(data, np.array([0, len(data)]), bpe.piece_cache(PATH))[0].tolist() == ENCODING.encode_ordinary(text)


def test_encode_decode_columns(docs, rows, empty):
    df = bpe.decode(bpe.encode(docs, PATH, offsets=True), PATH)
    got = by_id(df)
    assert set(docs.columns) <= set(df.columns)
    for i, text, *_ in rows:
        x, raw = got[i], (text or "").encode()
        assert x.tokens == ENCODING.encode_ordinary(text or "") and bytes(x.decoded) == raw
        lengths = [len(ENCODING.decode_single_token_bytes(t)) for t in x.tokens]
        assert x.tokens_offsets == np.cumsum([0, *lengths])[:-1].tolist()
    digests = by_id(bpe.round_trip(docs, PATH))
    for i, text, *_ in rows:
        ids = np.array(ENCODING.encode_ordinary(text or ""), "<u4").tobytes()
        assert digests[i][1:] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.encode(empty, PATH).count() == 0 and bpe.round_trip(empty, PATH).count() == 0


# ---------------------------------------------------------------- 10: near duplicates


def fingerprint(text, width=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(keys, prints, radius=4):
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        r = root(i)
        least[r] = min(k, least.get(r, k))
    return [least[root(i)] for i in range(len(keys))]


def test_long_fingerprints():
    for seed in range(20):
        r = random.Random(seed)
        text = "".join(r.choices(["word", " ", "  ", "\n", "Éa", "b", "CC "], k=r.choice([0, 3, 8, 500])))
        for piece in (1, 7, 100):
            assert simhash.long_fingerprint(np.frombuffer(text.encode(), np.uint8), piece=piece) == fingerprint(text)


@pytest.mark.parametrize("size", [0, 1, 3, 7, 8, 31, 32, 33, 64, 100])
def test_xxh64(size):
    from wirelake.llm._text import word_loads

    raw = np.random.default_rng(size).integers(0, 256, 200, np.uint8)
    starts = np.array([0, 5, 99])
    got = simhash.xxh64(word_loads(raw), starts, np.full(3, size))
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[a : a + size].tobytes(), 42) for a in starts]


def test_near_duplicates(docs, rows, empty):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id").collect()
    prints = [fingerprint(t) for _, t, *_ in rows]
    want = collections.Counter((i, f"{p:016x}", c) for (i, *_), p, c in zip(rows, prints, components([i for i, *_ in rows], prints)))
    assert collections.Counter((x.doc_id, x.f, x.component_id) for x in got) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {c for _, _, c in want}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_all_links_within_the_radius(spark):
    """Random fingerprints around a few centres, and a long chain: every pair of at most 4 bits, and what they reach."""
    r = random.Random(6)
    centres = [r.getrandbits(64) for _ in range(5)]
    prints = {0, 2**64 - 1, 15, 31}
    for _ in range(300):
        x = r.choice(centres)
        for b in r.sample(range(64), r.randint(0, 7)):
            x ^= 1 << b
        prints.add(x)
    x = r.getrandbits(64)
    for i in range(40):
        prints.add(x)
        for b in r.sample(range(64), 3):
            x ^= 1 << b
    prints = sorted(prints)
    r.shuffle(prints)
    signed = [(i, p - 2**64 if p >> 63 else p) for i, p in enumerate(prints)]
    df = spark.createDataFrame(signed, "node long, fingerprint long")
    want = {(i, j) for j in range(len(prints)) for i in range(j) if bin(prints[i] ^ prints[j]).count("1") <= 4}
    for parts in (2, 3, 5):
        found = [(p.a, p.b) for p in simhash.links(df, 4, parts).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    roots = {p.node: p.root for p in simhash.components(simhash.links(df)).collect()}
    assert [roots.get(i, i) for i in range(len(prints))] == components(list(range(len(prints))), prints)


def test_null_keys(spark):
    df = spark.createDataFrame([(None, "one two three four five"), (7, "one two three four five"), (None, "quite another text than that")], "doc_id long, text string")
    assert sorted(((x.doc_id, x.component_id) for x in simhash.near_duplicates(df).collect()), key=repr) == [(7, 7), (None, 7), (None, None)]
    assert simhash.keep_first(df).count() == 3


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stages(spark, tmp_path, docs, empty):
    from tests.llm.test_near_sets import staying
    from tests.llm.test_text_operators import base_spans, kept_by_hand
    from wirelake.llm import mixing

    now = docs
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, "").write.parquet(f"{tmp_path}/{k}")
        new = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert new.columns == docs.columns, name
        sizes.append(new)
        if k == 0:
            texts = [(x.doc_id, x.text) for x in now.collect()]
            assert {x.doc_id for x in new.collect()} == {i for (i, _), good in zip(texts, kept_by_hand([t for _, t in texts])) if good}
        elif k == 1:
            # Five-word shingles and a similarity of 0.8, by brute force; op10's four bits are the contract of its query alone.
            assert {x.doc_id for x in new.collect()} == staying([(x.doc_id, x.text) for x in now.collect()])
        elif k == 2:
            assert new.count() == now.count() and not any(base_spans(x.text) for x in new.collect())
            before = {x.doc_id: x.text for x in now.collect()}
            assert all(x.text == before[x.doc_id] for x in new.collect() if not base_spans(before[x.doc_id]))
        elif k == 3:
            want = collections.Counter()
            for x in mixing.mix(now).collect():
                want[x.doc_id] += x.taken // x.size if x.size else 0
            want = {k: n for k, n in want.items() if n}
            assert want and {x.doc_id: x["count"] for x in new.groupBy("doc_id").count().collect()} == want
        else:
            texts = {x.doc_id: x.text for x in now.collect()}
            assert new.count() == now.count() and all(x.tokens == ENCODING.encode_ordinary(texts[x.doc_id]) and x.n_tokens == len(x.tokens) for x in new.collect())
        now = new
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_of_nothing(spark, tmp_path, empty):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_library_doesnt_need_this(spark):
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent / "wirelake"
    users = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and re.search(r"\bllm\b", p.read_text())]
    assert users == [] and F is not None
