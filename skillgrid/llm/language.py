"""Language identification by compression.

Each language has a zstandard dictionary of raw content: lower-cased words of a sample
of its labelled texts. A text, brought to the same form, is compressed in blocks with
each dictionary in turn, each block after a lead of LEAD bytes of the language's sample,
whose own cost does not count: it brings the coder's letter statistics to the language,
so that even a few words tell. The language with the smallest total wins. The score is the
share that the winner saves against the runner-up; a narrow margin rejects the text.

Texts that are null or have no letter (marks alone are none) get `und` with score 0 and
count as rejected. With one learned language the runner-up is compression without a
dictionary. Ties go to the more frequent language. With no labelled rows at all every
text gets `und`. Very long texts are compressed whole, block by block. Repeated rows are
kept; an empty table gives no rows. Columns to keep that are called like a result give way.

Every label of which a sampled text has a letter is learned, short samples repeated up to
what a dictionary needs. The sample is bounded, whatever the size of the table:
SAMPLE_ROWS rows of each language, those with the smallest hash of id and text (equal rows
count once), ROW_CHARS of each, DICTIONARY_BYTES in all. With more than LANGUAGES
languages each one's rows and bytes shrink in proportion.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, load, map_batches

SAMPLE_ROWS, ROW_CHARS, DICTIONARY_BYTES, LANGUAGES = 400, 1200, 96 << 10, 128
BLOCK, LEAD = 8 << 10, 4 << 10
#: Matches of four bytes are found, as stems and endings are short.
PARAMETERS = zstandard.ZstdCompressionParameters(
    strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=4, window_log=18, hash_log=17, chain_log=17, write_content_size=False, write_dict_id=False
)
#: Least share of bytes by which the winner must beat the runner-up.
MARGIN = 0.01
UNKNOWN = "und"
_LETTERS, _LETTER = regex.compile(r"[\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def normal_form(text: str) -> bytes:
    """Lower-cased runs of letters and their marks; nothing if there is no letter."""
    if not _LETTER.search(text):
        return b""
    return " ".join(_LETTERS.findall(text.lower())).encode()


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language, the most frequent first, from the labelled rows.

    Only texts with a letter take part. A first pass counts the distinct hashes of each
    language (approximately, in bounded sketches) and sets a threshold which about twice the
    rows of a sample pass; of what passes, the smallest hashes are taken exactly. Thresholds
    meet the rows in a join, and the driver sees only the samples, a language at a time."""
    rows = df.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("g"), F.col(f"`{id_col}`").alias("k"))
    rows = rows.where("g is not null and t is not null").where(F.col("t").rlike(r"\p{L}")).select("g", "t", F.xxhash64("k", "t").alias("h"))
    scratch = Scratch(df.sparkSession, "languages")
    counts = scratch.table(rows.groupBy("g").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("d")))
    part = min(1.0, LANGUAGES / max(1, counts.count()))
    most, room = max(1, int(SAMPLE_ROWS * part)), max(8, int(DICTIONARY_BYTES * part))
    # hashes are uniform: the `most` smallest of d lie below this share, nearly surely
    share = F.lit(2.0 * most + 40) / F.col("d")
    below = F.when(share < 1, ((share * 2 - 1) * 2.0**63).cast("long")).otherwise(F.lit((1 << 63) - 1))
    limits = scratch.hint(scratch.table(counts.select("g", "n", below.alias("below"))))
    lead = F.substring(F.regexp_extract("t", r"(?s)\p{L}.*", 0), 1, ROW_CHARS)  # from the first letter on
    picked = rows.join(limits, "g").where("h <= below").groupBy("g", "h").agg(F.max("n").alias("n"), F.min(lead).alias("t"))
    picked = picked.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where(F.col("i") <= most)
    picked = scratch.table(picked.select("g", "n", "i", "t")).orderBy(F.desc("n"), "g", "i")
    out = {}
    for g, found in itertools.groupby(picked.toLocalIterator(), lambda r: r["g"]):
        parts = [normal_form(r["t"]) for r in found]
        sample = b" ".join(p for p in parts if p)[-room:]
        if sample:  # a dictionary takes 8 bytes at least
            out[g] = sample if len(sample) >= 8 else (sample + b" ") * 8
    scratch.drop()
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names = list(dictionaries)
        self.coders = []
        for sample in dictionaries.values():
            d = zstandard.ZstdCompressionDict(sample[LEAD:] if len(sample) > 2 * LEAD else sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=PARAMETERS)
            self.coders.append(self._coder(zstandard.ZstdCompressor(dict_data=d, compression_params=PARAMETERS), sample[:LEAD] + b" "))
        self.plain = self._coder(zstandard.ZstdCompressor(compression_params=PARAMETERS), b"")

    @staticmethod
    def _coder(coder: zstandard.ZstdCompressor, lead: bytes) -> Callable[[list[bytes]], int]:
        own = len(coder.compress(lead))
        return lambda blocks: max(1, sum(len(coder.compress(lead + b)) - own for b in blocks))

    def __call__(self, text: str | None) -> tuple[str, float]:
        raw = normal_form(text or "")
        if not raw or not self.names:
            return UNKNOWN, 0.0
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [(size(blocks), i) for i, size in enumerate(self.coders)]
        if len(sizes) == 1:
            return self.names[0], max(0.0, 1 - sizes[0][0] / self.plain(blocks))
        best, second = sorted(sizes)[:2]
        return self.names[best[1]], 1 - best[0] / second[0]


@functools.lru_cache(1)
def _classifier(model: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(dict(model))


def identify(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), margin: float = MARGIN) -> DataFrame:
    """The columns `keep` with lang_pred, score and rejected."""
    sent = df.sparkSession.sparkContext.broadcast(tuple(dictionaries.items()))
    kinds = dict(df.dtypes)
    keep = tuple(c for c in keep if c not in ("lang_pred", "score", "rejected"))
    held = "_".join(["_text", *keep])  # a name that no kept column has

    def work(rows: dict[str, list]) -> dict[str, list]:
        found = list(map(_classifier(sent.value), rows[held]))
        return {c: rows[c] for c in keep} | {"lang_pred": [g for g, _ in found], "score": [s for _, s in found], "rejected": [g == UNKNOWN or s < margin for g, s in found]}

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["lang_pred string", "score double", "rejected boolean"])
    return map_batches(df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(held)), schema, work, held)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
