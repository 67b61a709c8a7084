import hashlib
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skillgrid.llm import bpe

from .data import empty_documents, odd_documents

tokenizers = pytest.importorskip("tokenizers")
ODD = ["", " ", "it's we'll I'M", "a  b \n\n c\t", "123 ½²३", "漢字かな\U0001f642‍\U0001f642", "<|endoftext|>x<|endoftext|><|endof", "aaaa" * 300, "\x1c\x1d\x85\xa0 x", "é", "".join(map(chr, range(1, 3000)))]


@pytest.fixture(scope="module")
def theirs():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def ours(texts):
    ids, n = bpe.coder(bpe.default_vocabulary()).encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_odd_texts(theirs):
    want = [e.ids for e in theirs.encode_batch(ODD, add_special_tokens=False)]
    assert ours(ODD) == want
    c = bpe.coder(bpe.default_vocabulary())
    assert [c.decode(np.array(x, np.int32)) for x in want] == [theirs.decode(x, skip_special_tokens=False) for x in want]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=60), min_size=1, max_size=4))
def test_any_text(theirs, texts):
    assert ours(texts) == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]


def test_partial_ids_decode_alike(theirs):
    ids = theirs.encode("漢字 \U0001f642 é", add_special_tokens=False).ids
    c = bpe.coder(bpe.default_vocabulary())
    for i in range(len(ids)):
        assert c.decode(np.array(ids[i:], np.int32)) == theirs.decode(ids[i:], skip_special_tokens=False)


def test_memory_starts_anew(monkeypatch, theirs):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 3)
    c = bpe.Coder(bpe.default_vocabulary())
    for t in ("one two three four five", "six seven one", "two <|endoftext|>"):
        assert c.encode([t])[0].tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_columns(spark, theirs):
    df = odd_documents(spark)
    ids = bpe.encode(df)
    assert all(r["exact"] for r in bpe.encode(df, exact_col="exact").collect())
    assert ids.columns == [c for c in df.columns if c != "ids"] + ["ids"]
    back = bpe.decode(ids).collect()
    assert all((r["text"] or "") == r["decoded"] and list(r["ids"]) == theirs.encode(r["text"] or "", add_special_tokens=False).ids for r in back)
    want = sorted((str(r["doc_id"]), len(r["ids"]), hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in back)
    assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(df).collect()) == want


def test_no_rows(spark):
    assert bpe.round_trip(empty_documents(spark)).count() == 0 and bpe.decode(bpe.encode(empty_documents(spark))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdeinorst"), min_size=1, max_size=400), min_size=1, max_size=4))
def test_long_words_by_rank(theirs, texts):
    c = bpe.coder(bpe.default_vocabulary())
    a, n = c.merge_long([t.encode() for t in texts])
    b, m = c.merge([t.encode() for t in texts])
    assert a.tolist() == b.tolist() and n.tolist() == m.tolist()


def test_one_very_long_word(theirs):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("etaoinshrdlu"), 1_000_000)), "a" * 1_000_000, "é" * 300_000]
    for t in texts:
        began = time.perf_counter()
        got = ours([t])[0]
        assert time.perf_counter() - began < 10
        assert got == theirs.encode(t, add_special_tokens=False).ids
    bpe.coder(bpe.default_vocabulary()).forget()
