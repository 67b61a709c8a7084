"""Each stage against a plain version on its own input."""

import zlib

import pytest

import corpus_pipeline as P
from skillgrid.llm import language, mixing

from .data import empty_documents, odd_documents
from .test_minhash import brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{at}/{i}")
        out.append(spark.read.parquet(f"{at}/{i}"))
    return [[r.asDict() for r in d.collect()] for d in out]


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_order_and_columns(spark, sf_dir, stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "source_mixing", "bpe"]
    for rows in stages[:-1]:
        assert tuple(rows[0]) == P.COLUMNS
    assert {(r["doc_id"], tuple(r["ids"])) for r in P.run(spark, sf_dir).collect()} == {(r["doc_id"], tuple(r["ids"])) for r in stages[-1]}


def test_language_stage(spark, stages):
    model = language.learn(spark.createDataFrame(stages[0]))
    c = language.Classifier(model)
    want = {}
    for r in stages[0]:
        name, score = c(r["text"])
        if name != language.UNKNOWN and score >= language.MARGIN:
            want[r["doc_id"]] = name
    assert {k: r["lang"] for k, r in by_id(stages[1]).items()} == want
    assert len(stages[1]) > 0.97 * len(stages[0])


def test_line_stage(stages):
    hosts = {}
    for r in stages[1]:
        hosts.setdefault(r["source"] or "", set()).add(r["text"])
    for r in stages[1]:
        pages = hosts[r["source"] or ""]
        strip = lambda x: x.strip(" \t\r")
        often = lambda x: strip(x) and (n := sum(strip(x) in {strip(y) for y in p.split("\n")} for p in pages)) >= P.LINE_PAGES and n > 0.08 * len(pages)
        all_ = r["text"].split("\n")
        kept = [x for x in all_ if not often(x)]
        if kept and "\n".join(kept).strip():
            assert by_id(stages[2])[r["doc_id"]]["text"] == "\n".join(kept)


def test_near_stage(stages):
    found = brute([(r["doc_id"], r["text"]) for r in stages[2]], 5)
    assert set(by_id(stages[3])) == {k for k, _, c in found if k == c}


def test_mixing_stage(stages):
    ids = by_id(stages[3])
    assert stages[4] and all(r == ids[r["doc_id"]] for r in stages[4])
    n = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert 0.7 * P.MIX_SHARE * n(stages[3]) < n(stages[4]) <= P.MIX_SHARE * n(stages[3])
    assert zlib.crc32(b"x") and mixing.EPOCHS == 2


def test_coding_stage(stages):
    import tokenizers

    from skillgrid.llm.bpe import default_vocabulary

    theirs = tokenizers.Tokenizer.from_file(default_vocabulary())
    texts = by_id(stages[4])
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        assert r["exact"] and r["n_tokens"] == len(r["ids"]) and list(r["ids"]) == theirs.encode(texts[r["doc_id"]]["text"], add_special_tokens=False).ids


LAST = ["doc_id", "lang", "source", "n_tokens", "ids", "exact"]


def test_no_rows(spark, sf_dir):
    for name, stage in P.STAGES:
        out = stage(spark, empty_documents(spark), sf_dir)
        assert out.columns == (LAST if name == "bpe" else list(P.COLUMNS)) and out.collect() == [], name


def rows_of(df):
    return sorted(map(tuple, df.select(*P.COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows, an id with two texts, columns
    of names that stages use."""
    return odd_documents(spark)


def test_odd_rows_language(spark, sf_dir, odd):
    docs = rows_of(odd)
    c = language.Classifier(language.learn(odd))
    want = []
    for k, text, lang, source, n in docs:
        name, score = c(text)
        if name != language.UNKNOWN and score >= language.MARGIN:
            want.append((k, text, name, source, n))
    got = P.identify_language(spark, odd, sf_dir)
    assert got.columns == list(P.COLUMNS) and rows_of(got) == sorted(want, key=str)


def test_odd_rows_lines(spark, sf_dir, odd):
    docs = rows_of(odd)
    line = "the same line of several hosts"
    docs += [(200 + i, f"{line}\nown {i}\n\n {line}\t", "en", "s1", 9) for i in range(4)] + [(300, line, None, None, None), (301, line, "en", "s1", 1)]
    strip, hosts = lambda x: x.strip(" \t\r"), {}
    for _, text, _, source, _ in docs:
        if text is not None:
            hosts.setdefault(source or "", set()).add(text)
    want = []
    for k, text, lang, source, _ in docs:
        if text is not None:
            pages = hosts[source or ""]
            on = lambda x: sum(strip(x) in {strip(y) for y in p.split("\n")} for p in pages)  # noqa: B023, E731
            kept = [x for x in text.split("\n") if not (strip(x) and on(x) >= P.LINE_PAGES and on(x) > 0.08 * len(pages))]
            if len(kept) < len(text.split("\n")):
                text = "\n".join(kept)
                if not text.strip(" "):
                    continue
        want.append((k, text, lang, source, None if text is None else len(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as host", "'x' as n_dropped")
    got = P.drop_boilerplate_lines(spark, df, sf_dir)
    assert got.columns == list(P.COLUMNS)
    assert rows_of(got) == sorted(want, key=str)
    assert not any(line in (r[1] or "") for r in rows_of(got) if r[3] == "s1") and (300, line, None, None, len(line)) in rows_of(got)


def test_odd_rows_near(spark, sf_dir, odd):
    docs = rows_of(odd)
    found = brute([(k, t) for k, t, *_ in docs if k is not None], 5)
    gone = {k for k, _, c in found if k != c} - {k for k, _, c in found if k == c}
    got = P.drop_near_duplicates(spark, odd, sf_dir)
    assert got.columns == list(P.COLUMNS) and rows_of(got) == sorted((r for r in docs if r[0] not in gone), key=str)
    assert {41, 42, 43} <= gone


def test_odd_rows_mixing(spark, sf_dir, odd):
    docs, got = rows_of(odd), P.mix_sources(spark, odd, sf_dir)
    assert got.columns == list(P.COLUMNS)
    taken = rows_of(got)
    n = lambda rows: sum(len((r[1] or "").split()) for r in rows)
    assert taken and set(taken) <= set(docs) and n(taken) <= P.MIX_SHARE * n(docs) and all(n([r]) for r in taken)
    assert all(taken.count(r) <= P.MIX_EPOCHS * docs.count(r) for r in taken)
    assert rows_of(P.mix_sources(spark, odd.repartition(5), sf_dir)) == taken


def test_odd_rows_coding(spark, sf_dir, odd):
    import tokenizers

    from skillgrid.llm.bpe import default_vocabulary

    theirs = tokenizers.Tokenizer.from_file(default_vocabulary())
    want = []
    for k, text, lang, source, _ in rows_of(odd):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        want.append((k, lang, source, len(ids), ids, True))
    got = P.encode_bytes(spark, odd, sf_dir)
    assert got.columns == LAST and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
