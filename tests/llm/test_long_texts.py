"""Texts of a megabyte through every operator."""

import hashlib
import random

import pytest

from skillgrid.llm import bpe, fingerprints, html, language, lines, media, minhash, mixing, quality, substrings

from .data import DOC, words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    prose = words(rng, 200_000)
    return [
        (1, prose, "en", "s0"), (2, prose[300_000:700_000], "en", "s0"), (3, prose + " a tail of words", "fr", "s1"), (4, "abcdefgh" * 130_000, "en", "s1"),
        (5, "\n".join(words(rng, 8) for _ in range(20_000)), "fr", "s0"), (6, "\U0001f642" * 250_000, "en", "s0"), (7, "short text", "en", "s1"), (8, None, "fr", "s0"),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOC)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_fingerprints(docs, rows):
    got = by_id(fingerprints.successive_edits(docs))
    texts = {r[0]: r[1] or "" for r in rows}
    for k, t in texts.items():
        n, after = len(t) // 2, texts[k - 1 if k > 1 else 8]
        edited = t[: len(t) - n] + after[:n]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[2]["near_next"] > 0.99  # all of it is in the next one


def test_near_duplicates(docs, rows):
    got = by_id(minhash.near_duplicates(docs, size=5))
    for k, t, *_ in rows:
        w = (t or "").split()
        assert got[k]["n_shingles"] == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else min(1, len(w)))
    assert {k: r["component_id"] for k, r in got.items()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}


def test_quality_and_language(spark, docs):
    out = quality.score(docs, spark.createDataFrame([(7, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int"))
    assert out.where("quality between 0 and 1").count() == 8
    got = by_id(language.identify(docs, language.learn(docs)))
    assert {k: r["lang_pred"] == language.UNKNOWN for k, r in got.items()} == {k: k in (6, 8) for k in range(1, 9)}


def test_lines_and_mixing(docs, rows):
    texts = {r[0]: r[1] for r in rows}
    assert {k: r["text"] for k, r in by_id(lines.drop_boilerplate(docs)).items()} == texts
    got = by_id(mixing.mix(mixing.with_domain(docs), share=1.0, epochs=1))
    assert {k: r["n_tokens"] for k, r in got.items()} == {k: len(t.split()) for k, t in texts.items() if t}


def test_media_and_codes(docs, rows):
    got, coded = by_id(media.stored_digests(docs)), by_id(bpe.round_trip(docs))
    for k, t, *_ in rows:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert got[k]["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert coded[k]["decoded_sha256"] == hashlib.sha256(raw).hexdigest()


def test_substrings(docs, rows):
    got = by_id(substrings.dedup(docs))
    n = {r[0]: len((r[1] or "").encode()) for r in rows}
    assert {k: r["n_bytes"] for k, r in got.items()} == n
    assert {k: r["n_removed"] for k, r in got.items()} == {1: 0, 2: n[2], 3: n[1], 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}
    assert bytes(got[3]["kept"]) == b" a tail of words"


def test_pages(spark, rows):
    pages = [(k, "http://h/", None if t is None else f"<nav>menu</nav><article><p>{t}</p></article>") for k, t, *_ in rows]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {r[0]: " ".join((r[1] or "").split()) for r in rows}
