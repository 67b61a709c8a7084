"""A corpus pipeline: language ID, line dedup, near-dedup, mixing, byte-pair coding.

Each stage takes (spark, docs, sf_dir), where docs has the columns of the documents table
(doc_id, text, lang, source, n_chars), works on all of it, and returns a DataFrame; all but
the last return the same columns. run() applies them in order, writing each result to the
shared scratch folder, so a lost executor costs no more than the stage at hand.

Awkward rows, stage by stage: null, empty and letterless texts have no language and go in the
first stage; given to later ones, null texts pass the line stage and near-dedup as they are, are not
chosen by mixing, and have no ids. A null source is a host and a leaf of its own (""), a
null language is a label of none. Repeated rows stay repeated rows, in near-dedup too: of
equal texts the least id stays, with all of its rows, and rows without an id always stay;
of ids with several texts each text counts. Ties at a margin or ratio keep the document.
Texts are read whole however long, an empty table stays empty, and columns other than those
of documents are not read and not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.llm import bpe, language, lines, minhash, mixing
from skillgrid.llm.common import Scratch, load, owned

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Distinct pages of a source on which a line must be, however small the source is.
LINE_PAGES = 3
#: Tokens that mixing selects, as a share of those it is given, and epochs of small leaves.
MIX_SHARE, MIX_EPOCHS = 0.9, 2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, with the predicted language; those that the
    classifier rejects (no letters, or a narrow margin) go. It learns from the labelled
    rows of its input."""
    model = language.learn(docs)
    known = language.identify(docs, model, keep=COLUMNS).where("not rejected")
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are boilerplate on their source; n_chars follows.
    Texts of which nothing is left go. Copies of a text are left to the next stage: they
    count as one page, and a line must be on LINE_PAGES distinct pages of a source."""
    clean = lines.drop_boilerplate(docs.select(*COLUMNS), least_pages=LINE_PAGES, copies_once=True)
    clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.where("n_dropped = 0 or trim(text) <> ''").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near duplicates (five-word
    shingles, similarity 0.8). Rows without an id stay."""
    scratch = Scratch(spark, "dropped")
    gone = scratch.table(minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct())
    return docs.select(*COLUMNS).join(scratch.hint(gone), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights; one of a small leaf may come once an epoch."""
    chosen = mixing.mix(mixing.with_domain(docs.select(*COLUMNS)), share=MIX_SHARE, epochs=MIX_EPOCHS, keep=COLUMNS)
    return chosen.select(*COLUMNS)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding them gives the text."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), exact_col="exact")
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("bpe", encode_bytes),
]
#: Compression and byte-pair coding are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        with owned():  # what a stage wrote for itself goes once its result is written
            docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
