"""Packed ids of texts with added tokens: as the tokenizers library encodes whole texts."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wirelake.llm import _text, bpe, packing
from wirelake.llm.queries import JSON
from wirelake.llm.shared import new_path

PATH = public_tokenizers.path(JSON)
END = "<|endoftext|>"
TEXTS = [END, f"{END} begins", f"ends {END}", f"a {END} b", f"a{END}b", f" {END}  {END} ", END * 3, f"x\n\n{END}\n y", None, "", "none <|endoftext", "|> of two texts", f"é{END}中 <|endoftext|", f"<{END}>", "plain text"]


def ids_of(texts):
    out = []
    for _, _, ids, at in packing.encoded_with_added(pa.array(texts, pa.string()), packing.library_cache(PATH), PATH):
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


@pytest.mark.parametrize("size", [None, 40])
def test_added_tokens_are_the_librarys(monkeypatch, size):
    if size:
        for module in (_text, bpe):
            monkeypatch.setattr(module, "CHUNK_BYTES", size)
        monkeypatch.setattr(packing, "chunks", lambda offsets: _text.chunks(offsets, size))
    tokenizer = Tokenizer.from_file(PATH)
    texts = list(TEXTS)
    for seed in range(60):
        texts.append("".join(random.Random(seed).choices(["word", " ", "  ", "\n", "é", "'s", END, "<|", "|>", "endoftext"], k=30)))
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids_of(texts) == want and sum(w.count(50256) for w in want) > 60
    assert ids_of(["plain", " text"]) == [tokenizer.encode(t, add_special_tokens=False).ids for t in ("plain", " text")]


def test_added_tokens_in_files(spark):
    tokenizer = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {x.doc_id: x for x in packing.read_files(spark, packing.write_files(df, new_path(spark, "test-packed"), PATH, 50257, 2)).collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        assert (got[i].start, got[i].n_tokens) == (start, n)
        start += n
