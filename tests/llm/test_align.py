import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skillgrid.llm import align

from .data import empty_documents, odd_documents, words

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def theirs():
    a_path, b_path = align.default_vocabularies()
    a = tokenizers.Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path)


def byte_letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


LETTERS = byte_letters()


def plain(theirs, text):
    """Groups, and all pairs of overlapping tokens by comparing each with each."""
    a, b = theirs
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(LETTERS[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    raw_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode() for p in pieces]
    want = (" " + text).encode()
    if b"".join(raw_a) != want or b"".join(raw_b) != want:
        return None

    def ranges(raw):
        at, out = 0, []
        for r in raw:
            out.append((at, at + len(r)))
            at += len(r)
        return out

    ra, rb = ranges(raw_a), ranges(raw_b)
    links = [(i, j) for i, x in zip(ids_a, ra) for j, y in zip(ids_b, rb) if max(x[0], y[0]) < min(x[1], y[1])]
    cuts, low, groups = sorted({e for _, e in ra} & {e for _, e in rb}), 0, []
    for c in cuts:
        groups.append(",".join(str(i) for i, (_, e) in zip(ids_a, ra) if low < e <= c) + "|" + ",".join(str(i) for i, (_, e) in zip(ids_b, rb) if low < e <= c))
        low = c
    return len(ids_a), len(ids_b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def brute(theirs, rows):
    found = [(k, plain(theirs, t)) for k, t in rows]
    counts = Counter(x for _, f in found if f for x in f[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for k, f in found:
        if f is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((k, *f[:3], len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]))
    return sorted(out, key=str)


def collected(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_all_pairs(spark, theirs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents(spark).where("length(text) < 5000 or text is null").collect()]
    rows += [(100, "<|endoftext|> and <s> </s> <unk>"), (101, "▁x"), (102, "a  b \n\n c\t"), (103, "漢字かな \U0001f642 é ﬁ"), (104, " "), (105, "\0a\x1c"), (106, "ab" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as block", "'c' as pair", "'c' as n", "'c' as id")
    want = brute(theirs, rows)
    assert any(r[1] == 0 and r[0] == 101 for r in want) and any(r[1] for r in want)
    assert collected(align.aligned(df)) == want
    # however the texts are cut into runs, blocks and tasks
    monkeypatch.setattr(align, "SLICE", 300)
    monkeypatch.setattr(align, "BLOCK_PAIRS", 50)
    assert collected(align.aligned(df.repartition(3))) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=40), min_size=1, max_size=4))
def test_any_text(theirs, texts):
    made = align.align(align._pair(*align.default_vocabularies()), texts)
    at = 0
    for i, t in enumerate(texts):
        f = plain(theirs, t)
        n = int(made["n_links"][i])
        links = sorted(zip(made["a"][at : at + n].tolist(), made["b"][at : at + n].tolist()))
        at += n
        assert (int(made["n_a"][i]), int(made["n_b"][i]), int(made["n_groups"][i]), links, made["groups_sha256"][i]) == ((*f[:3], sorted(f[3]), f[4]) if f else (0, 0, 0, [], ""))


def test_one_very_long_text(spark, theirs):
    import random

    text = words(random.Random(1), 20000)
    got = collected(align.aligned(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")))
    assert got[0][1] == len(theirs[0].encode(" " + text, add_special_tokens=False).ids) and got[0][2] == len(theirs[1].encode(text))
    assert got[0][4] == got[0][1] + got[0][2] - got[0][3] and got[1] == (2, 0, 0, 0, 0, 0, 0, "")


def test_no_rows(spark):
    assert align.aligned(empty_documents(spark)).count() == 0
    assert collected(align.aligned(spark.createDataFrame([("x", None), (None, "")], "doc_id string, text string"))) == sorted([(None, *[0] * 6, ""), ("x", *[0] * 6, "")], key=str)


def test_whole_table(spark, sf_dir, theirs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in align.op11_token_alignment(spark, sf_dir).collect()}
    for r in docs.collect():
        g = got.pop(r["doc_id"])
        n_b = len(theirs[1].encode(r["text"]))
        assert g["n_b"] in (0, n_b) and (g["n_links"] == g["n_a"] + g["n_b"] - g["n_groups"]) and g["n_best"] <= g["n_links"] <= g["count_sum"]
    assert not got
