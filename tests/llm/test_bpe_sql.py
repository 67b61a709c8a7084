import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skillgrid.llm import bpe, bpe_sql

from .data import empty_documents, odd_documents, words

tiktoken = pytest.importorskip("tiktoken")
ODD = ["", " ", "it's we'll I'M", "a  b \n\n c\t", "123 ½²३", "漢字かな\U0001f642‍\U0001f642", "<|endoftext|>x<|endof", "aaaa" * 300, "\x1c\x1d\x85\xa0 x", "é", "".join(map(chr, range(1, 3000))), "x" * 256, "x" * 257, "\0a\0"]


@pytest.fixture(scope="module")
def theirs():
    ranks = bpe_sql.read_ranks(bpe_sql.default_vocabulary())
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(texts):
    ids, n = bpe_sql.coder(bpe_sql.default_vocabulary()).encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_odd_texts(theirs):
    want = [theirs.encode_ordinary(t) for t in ODD]
    assert ours(ODD) == want
    c = bpe_sql.coder(bpe_sql.default_vocabulary())
    assert [raw for _, raw in c.code(ODD)] == [t.encode() for t in ODD]
    assert [c.decode(np.array(x, np.int32)) for x in want] == ODD


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=60), min_size=1, max_size=4))
def test_any_text(theirs, texts):
    assert ours(texts) == [theirs.encode_ordinary(t) for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdeinorst"), min_size=1, max_size=400), min_size=1, max_size=4))
def test_words_around_the_bound(theirs, texts):
    c = bpe_sql.coder(bpe_sql.default_vocabulary())
    c.forget()
    assert ours(texts) == [theirs.encode_ordinary(t) for t in texts]


def test_every_character_splits_alike(theirs):
    every = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    texts = [" ".join(every[i : i + 4000]) for i in range(0, len(every), 4000)]
    assert ours(texts) == [theirs.encode_ordinary(t) for t in texts]


def test_memory_starts_anew(monkeypatch, theirs):
    monkeypatch.setattr(bpe_sql, "MEMORY_WORDS", 3)
    for t in ("one two three four five", "six seven one", "two three"):
        assert ours([t]) == [theirs.encode_ordinary(t)]


def test_one_very_long_word(theirs):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("etaoinshrdlu"), 100_000)) + " " + "a" * 100_000
    assert ours([text]) == [theirs.encode_ordinary(text)]


def test_columns(spark, theirs, monkeypatch):
    monkeypatch.setattr(bpe_sql, "BLOCK_CHARS", 1000)
    df = odd_documents(spark)
    ids = bpe_sql.encode(df)
    assert ids.columns == [c for c in df.columns if c != "ids"] + ["ids"]
    back = bpe_sql.decode(ids).collect()
    assert all((r["text"] or "").encode() == bytes(r["decoded"]) and list(r["ids"]) == theirs.encode_ordinary(r["text"] or "") for r in back)
    want = sorted((str(r["doc_id"]), len(r["ids"]), hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest(), hashlib.sha256(bytes(r["decoded"])).hexdigest()) for r in back)
    assert sorted((str(r[0]), *r[1:]) for r in bpe_sql.round_trip(df).collect()) == want


def test_ids_of_all_kinds_decode(spark, theirs):
    ids = theirs.encode_ordinary("漢字 \U0001f642 é")
    rows = [(1, ids), (2, ids[1:]), (3, []), (4, None), (5, [None, ids[0], 10**6])]
    got = {r["k"]: r["decoded"] for r in bpe_sql.decode(spark.createDataFrame(rows, "k int, ids array<int>")).collect()}
    assert bytes(got[1]).decode() == "漢字 \U0001f642 é" and bytes(got[2]) == b"".join(theirs.decode_single_token_bytes(i) for i in ids[1:])
    assert bytes(got[3]) == b"" and got[4] is None and bytes(got[5]) == theirs.decode_single_token_bytes(ids[0])


def test_no_rows(spark):
    assert bpe_sql.round_trip(empty_documents(spark)).count() == 0 and bpe_sql.decode(bpe_sql.encode(empty_documents(spark))).count() == 0


def test_whole_table(spark, sf_dir, theirs):
    got = {r["doc_id"]: r for r in bpe_sql.op12_bpe_by_queries(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids, g = theirs.encode_ordinary(r["text"] or ""), got.pop(r["doc_id"])
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert not got


def test_words_are_merged_by_the_query(monkeypatch):
    c = bpe_sql.SqlCoder(bpe_sql.default_vocabulary())
    asked = []
    query = c._query
    monkeypatch.setattr(c, "_query", lambda text, *a, **b: asked.append(text) or query(text, *a, **b))
    c.encode([words(random.Random(2), 50)])
    assert asked == [bpe_sql.ENCODE, bpe_sql.DECODE]
