"""Small tables with nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_documents(spark, seed=1, extra=True):
    """Documents with every awkward case; `extra` adds columns whose names operators use."""
    rng = random.Random(seed)
    base = words(rng, 120)
    rows = [(i, words(rng, rng.randint(1, 60)), rng.choice(["en", "fr"]), f"s{i % 3}") for i in range(30)]
    rows += [(40, base, "en", "s0"), (41, base, "en", "s1"), (42, base + " tail", "en", None), (43, "x " + base, None, "s0")]
    rows += [(50, None, "en", "s0"), (51, "", "fr", "s1"), (52, "   \n\t ", None, None), (53, "a", "en", "s2"), (None, base, "en", "s0"), (None, None, None, None)]
    rows += [(60, words(rng, 6000), "fr", "s1"), (61, "\U0001f642é" * 40, "fr", "s0"), (62, "A" * 300, "en", "s2")]
    rows += [(40, base, "en", "s0"), (7, "again " * 20, "en", "s0")]  # a repeated row, and an id with two texts
    rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOC)
    if extra:
        for c in ("k", "t", "h", "n", "key", "component_id", "budget", "epoch", "fingerprint", "ids", "n_lines", "host", "bucket"):
            df = df.selectExpr("*", f"'clash' as `{c}`")
    return df


def empty_documents(spark):
    return spark.createDataFrame([], DOC)
