"""Token counts and BPE against the tokenizers library, row by row."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabrecover.llm import bpe
from tabrecover.llm.token_counts import token_counts
from tabrecover.llm.vocab import pre_tokens, vocabulary

from .cases import SCHEMA, documents, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


TRICKY = [
    "a" * 900,
    "ab1" * 400,
    "é" * 500 + "'s" * 200,
    "'" * 600,
    " " * 700 + "x",
    "\n\t " * 300,
    "<|endoftext|>" * 80,
    "日本語" * 300,
    "!!<|endoftext|>!ab<|endoftext|>ab" * 60,
    "🙂" * 300 + "👩‍👩‍👧" * 50,
    "!?" * 500,
    "x " * 400,
]


@given(st.text(alphabet="ab 's\né日1!<|endoftext>", max_size=200))
@settings(max_examples=200, deadline=None)
def test_ids_of_pre_tokens_are_those_of_the_text(text):
    assert vocabulary(PATH).ids([text])[0].tolist() == ids_of(text)
    assert "".join(pre_tokens(text)) == text


@given(st.text(alphabet="ab 's\né日1!<|endoftext>", min_size=1, max_size=300), st.integers(4, 40))
@settings(max_examples=200, deadline=None)
def test_halves_grow_together(text, limit):
    vocab = vocabulary(PATH)
    found = bpe.leaves(vocab, text, limit)
    assert "".join(part for *_, part in found) == text
    sides = [bpe.Side.of(vocab, part) for *_, part in found]
    assert bpe.grown_together(vocab, sides, [f[1] for f in found], [f[2] for f in found]) == ids_of(text)


@pytest.mark.parametrize("text", TRICKY)
@pytest.mark.parametrize("limit", [7, 50, 301])
def test_unsplit_texts(text, limit):
    vocab = vocabulary(PATH)
    found = bpe.leaves(vocab, text, limit)
    sides = [bpe.Side.of(vocab, part) for *_, part in found]
    assert bpe.grown_together(vocab, sides, [f[1] for f in found], [f[2] for f in found]) == ids_of(text)


@pytest.mark.parametrize("long_bytes", [200, 1 << 15])
def test_encode_and_decode(spark, long_bytes):
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(TRICKY)]
    docs = documents(spark, rows)
    found = bpe.encode(docs, PATH, long_bytes=long_bytes, leaf_chars=64)
    got = [(r["doc_id"], tuple(r["ids"])) for r in found.collect()]
    assert Counter(got) == Counter((i, tuple(ids_of(t))) for i, t in rows)
    back = Counter((r["doc_id"], r["text"]) for r in bpe.decode(found, PATH).collect())
    assert back == Counter((i, LIBRARY.decode(ids_of(t), skip_special_tokens=False)) for i, t in rows)
    digest = bpe.encode(docs, PATH, outputs="digest", long_bytes=long_bytes, leaf_chars=64)
    want = Counter()
    for i, t in rows:
        ids = ids_of(t)
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        want[i, len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), text))] += 1
    assert Counter(tuple(r) for r in digest.collect()) == want


@pytest.mark.parametrize("block_bytes", [1, 500, 1 << 25])
def test_token_counts(spark, block_bytes):
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(TRICKY)]
    found = token_counts(documents(spark, rows), PATH, block_bytes=block_bytes)
    want = Counter((i, len((t or "").encode()), len(ids_of(t))) for i, t in rows)
    assert Counter(tuple(r) for r in found.collect()) == want


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_counts(none, PATH).collect() == []
    assert bpe.encode(none, PATH).collect() == []
