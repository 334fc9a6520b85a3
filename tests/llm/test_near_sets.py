"""The near-dedup stage: against brute-force Jaccard similarity, and on odd tables."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from wirelake.llm import near_sets


def shingle_set(text, width=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def staying(rows):
    """The doc_ids that stay; rows of one doc_id are linked."""
    made, parent = [(k, shingle_set(t)) for k, t in rows if k is not None], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (k, a) in enumerate(made):
        for j, b in made[:i]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(k), root(j)))
                parent[y] = x
    return {k for k, _ in made if root(k) == k}


def near_texts(seed):
    """Copies with so many words changed that similarities lie around 0.8, with passages that many share."""
    r = random.Random(seed)
    prose = lambda n: [f"Word{r.randrange(2000)}" for _ in range(n)]
    shared, texts = prose(60), [None, "", " \n", "a b", "A  b", "a b c", "one two three four five", "one two three four five six"]
    for _ in range(25):
        base = prose(r.choice([7, 30, 120, 400]))
        base = base + shared * (r.random() < 0.5)
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            new = list(base)
            for _ in range(r.randrange(1, 2 + len(base) // 35)):
                new[r.randrange(len(new))] = "other"
            texts.append(r.choice([" ", "\n"]).join(new[r.randrange(3) :]))
    return texts


@pytest.mark.parametrize("seed, sample", [(1, 1 << 14), (2, 60), (3, 1)])
def test_the_stage_is_jaccard(spark, monkeypatch, seed, sample):
    monkeypatch.setattr(near_sets, "SAMPLE", sample)
    rows = [(3 * i, t) for i, t in enumerate(near_texts(seed))]
    rows += [(None, rows[9][1]), (None, "no key"), (27, "quite another text of one doc_id that comes with two of them"), (900, "Quite another text of one doc_id that comes with two of  them")]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = corpus_pipeline.near_dedup_stage(spark, df, "").collect()
    want = staying(rows)
    assert sorted(map(repr, ((x.doc_id, x.text) for x in got))) == sorted(map(repr, ((k, t) for k, t in rows if k is None or k in want)))
    assert len(want) < len({k for k, _ in rows}) - 8


def test_no_documents(spark, docs, empty):
    assert near_sets.keep_first(empty).count() == 0 and near_sets.keep_first(docs).columns == docs.columns


def test_long_texts_have_the_same_shingles():
    for seed in range(20):
        r = random.Random(seed)
        text = "".join(r.choices(["word", " ", "  ", "\n", "Éa", "b", "CC "], k=r.choice([0, 3, 8, 500])))
        data = np.frombuffer(text.encode(), np.uint8)
        want = near_sets.sets(data, np.array([0, len(data)]))[0]
        assert len(want) == len(shingle_set(text))
        assert all(near_sets.long_shingles(data, piece=p).tolist() == want.tolist() for p in (1, 7, 100))


def test_slices_and_sketches_lose_no_pair(spark, monkeypatch):
    """Unrelated texts that meet under a passage are told apart before whole sets are, and pairs go in slices where they would take more disk than the texts."""
    r = random.Random(5)
    shared = [f"s{i}" for i in range(12)]
    rows = [(i, " ".join(shared + [f"w{r.randrange(5000)}" for _ in range(40)])) for i in range(60)]
    rows += [(100 + k, " ".join(t.split(" ")[:-1])) for k, t in rows[::6]] + [(200 + k, t + " more and more") for k, t in rows[::9]]
    seen, whole = [], near_sets.similar
    monkeypatch.setattr(near_sets, "similar", lambda df, pairs, *a: seen.append(pairs.count()) or whole(df, pairs, *a))
    monkeypatch.setattr(near_sets, "SAMPLE", 1)
    monkeypatch.setattr(near_sets, "LEAST_BYTES", 1 << 10)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in near_sets.keep_first(df).collect()} == staying(rows)
    assert sum(seen) < 60


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    r = np.random.default_rng(1)
    for n, m in [(0, 0), (0, 3), (64, 65), (500, 520), (900, 300)]:
        both = r.integers(0, 2**63, 1000).astype(np.uint64)
        a, b = np.sort(r.choice(both, n, False)), np.sort(r.choice(both, m, False))
        x, y = near_sets._sketches(np.concatenate([a, b]), np.array([0, n, n + m]))
        assert (near_sets._differing(x, x), near_sets._differing(y, y)) == (0, 0)
        assert near_sets._differing(x, y) <= n + m - 2 * len(np.intersect1d(a, b))


def test_simhash_is_a_step_of_its_own(spark, monkeypatch):
    """Fingerprints few bits apart link copies without the other rounds, and make a few pairs for each class only."""
    r = random.Random(8)
    base = [f"w{r.randrange(3000)}" for _ in range(4000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1])), (3, " ".join(reversed(base)))]
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_sets, "first_pairs", lambda *a: none)
    monkeypatch.setattr(near_sets, "pairs_across", lambda *a: none.selectExpr("a", "b", "a as n"))
    kept = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(x.doc_id for x in kept) == [1, 3]
    many = spark.createDataFrame([(k, 1 << (k % 40)) for k in range(80)] + [(900, -1)], "class long, fingerprint long")
    pairs = {(x.a, x.b) for x in near_sets.simhash_pairs(many).collect()}
    assert all(a < b for a, b in pairs) and {x for p in pairs for x in p} == set(range(80)) and {(k, k + 40) for k in range(40)} <= pairs and len(pairs) <= 120
