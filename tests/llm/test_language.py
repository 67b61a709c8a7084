import random
import unicodedata
import zlib

import regex
import xxhash
import zstandard
from pyspark.sql import functions as F

from skillgrid.llm import language as L

from .data import empty_documents, odd_documents, words


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows = L.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert {r["held_out"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1} == {True}
    assert {r["held_out"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1} == {False}
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) / len(rows) < 0.02


def test_labels_and_ids_are_no_inputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.learn(docs)
    a = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs, model).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")), model).collect()}
    assert a == b and set(a.values()) <= {r["lang"] for r in docs.select("lang").distinct().collect()} | {L.UNKNOWN}


def test_odd_rows(spark, sf_dir):
    model = L.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    df = odd_documents(spark)
    out = L.identify(df, model, keep=("doc_id", "text"))
    assert out.count() == df.count()
    for r in out.collect():
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == L.UNKNOWN) == (not letters)
        if not letters:
            assert r["score"] == 0 and r["rejected"]


def test_few_labels(spark):
    df = odd_documents(spark)
    for rows in ([], [(1, "hello there general words", "en")], [(1, None, "en"), (2, "text words here", None)]):
        model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert set(model) == {r[2] for r in rows if r[1] and r[2]}
        assert L.identify(df, model).count() == df.count()
    assert L.learn(empty_documents(spark)) == {} and L.identify(empty_documents(spark), {}).count() == 0


def test_narrow_margins_are_rejected():
    c = L.Classifier({"a": b"alpha beta gamma delta words " * 40, "b": b"alpha beta gamma delta words " * 40})
    name, score = c("alpha beta gamma")
    assert name == "a" and score == 0.0


def test_all_labels_are_learned(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 40), f"l{i:03}") for i in range(L.LANGUAGES + 5)] + [(900, "ab", "short"), (901, "12 34", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(df)
    assert set(model) == {r[2] for r in rows} - {"none"}
    c = L.Classifier(model)
    assert all(c(text)[0] == lang for _, text, lang in rows if lang.startswith("l"))


def test_thousands_of_labels(spark):
    df = spark.range(5000 * 60).selectExpr("id as doc_id", "concat('l', id % 5000) as lang")
    df = df.withColumn("text", F.translate(F.concat_ws(" ", F.md5("lang"), F.sha2(F.col("doc_id").cast("string"), 256)), "0123456789", "ghijklmnop"))
    model = L.learn(df)
    most = int(L.SAMPLE_ROWS * L.LANGUAGES / 5000)
    assert len(model) == 5000 and list(model) == sorted(model)
    # a sample is the rows with the least hashes of their label
    mine = df.where("lang = 'l77'").select("text", F.xxhash64("doc_id", "text").alias("h")).orderBy("h").limit(most).collect()
    want = b" ".join(L.normal_form(r["text"]) for r in mine)
    assert model["l77"] == want[-int(L.DICTIONARY_BYTES * L.LANGUAGES / 5000) :]


def plain_predictions(rows, learned):
    """The whole method again, in plain steps: hashes, samples, dictionaries, sizes."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    letter = lambda c: unicodedata.category(c)[0] == "L"

    def form(text):
        if not any(map(letter, text)):
            return b""
        return " ".join(regex.findall(r"[\p{L}\p{M}]+", text.lower())).encode()

    sample, count = {}, {}
    for i, text, lang in learned:
        if text is None or lang is None or not any(map(letter, text)):
            continue
        h = xxhash.xxh64_intdigest(text.encode(), 42 if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42))
        sample.setdefault(lang, {})[signed(h)] = text[next(j for j, c in enumerate(text) if letter(c)) :][: L.ROW_CHARS]
        count[lang] = count.get(lang, 0) + 1
    packs = []
    for lang in sorted(sample, key=lambda g: (-count[g], g)):
        best = sorted(sample[lang].items())[: L.SAMPLE_ROWS]
        raw = b" ".join(f for f in (form(t) for _, t in best) if f)[-L.DICTIONARY_BYTES :]
        raw = raw if len(raw) >= 8 else (raw + b" ") * 8
        book = zstandard.ZstdCompressionDict(raw[L.LEAD :] if len(raw) > 2 * L.LEAD else raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packs.append((lang, book, raw[: L.LEAD] + b" "))

    def size(book, lead, text):
        book.precompute_compress(compression_params=L.PARAMETERS)
        of = lambda x: len(zstandard.ZstdCompressor(dict_data=book, compression_params=L.PARAMETERS).compress(x))
        return max(1, sum(of(lead + text[j : j + L.BLOCK]) - of(lead) for j in range(0, len(text), L.BLOCK)))

    out = {}
    for i, text, _ in rows:
        raw = form(text or "")
        if not raw:
            out[i] = ("und", 0.0)
            continue
        sizes = sorted((size(book, lead, raw), n) for n, (_, book, lead) in enumerate(packs))
        out[i] = (packs[sizes[0][1]][0], 1 - sizes[0][0] / sizes[1][0])
    return out


def test_query_equals_plain_steps(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    want = plain_predictions(rows, [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.op9_language_id(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-12 for i in want)


def test_equal_ids_short_samples_and_marks(spark):
    rng = random.Random(8)
    rows = [(7, words(rng, 30) if i % 100 else "same text", g) for g in ("a", "b", "c") for i in range(900)] + [(8, "漢", "zh"), (9, "ja", "de"), (10, "\u0301\u0301", "none")]
    rows += [(11, "1 2 3 " * 1000 + "late", "late")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(df)
    assert set(model) == {"a", "b", "c", "zh", "de", "late"}
    odd = spark.createDataFrame([(1, "\u0301\u0301"), (2, "\u0301a"), (3, "12")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.identify(odd, model).collect()}
    assert got[1]["lang_pred"] == got[3]["lang_pred"] == L.UNKNOWN and got[2]["lang_pred"] != L.UNKNOWN
    assert got[1]["score"] == 0 and got[1]["rejected"]


def test_clashing_names(spark):
    rows = [(i, f"{w} " * 20, w) for i, w in enumerate(["hello", "bonjour", "gruss"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as score", "'x' as lang_pred", "'x' as rejected", "'x' as _text")
    out = L.identify(df, L.learn(df), keep=("doc_id", "score", "lang_pred", "rejected", "_text"))
    assert out.columns == ["doc_id", "_text", "lang_pred", "score", "rejected"] and out.where("_text = 'x' and lang_pred <> 'x'").count() == 3
