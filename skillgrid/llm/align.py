"""Alignment of two tokenizers' ids over the same bytes, and how often ids meet.

Tokenizer A (byte-level byte pairs) codes a space and the text, tokenizer B (sentence
pieces, which put that space there themselves) the text; special tokens' strings are plain
text to both. Each Arrow batch is taken as one run of bytes, a document after the other at
its byte offset. The ends of A's and of B's tokens are counted once each (bincount); where
both end, a group ends. Between two ends of any kind lies one link, of the A token and the
B token that cover it. Prefix sums over the run, cut at the documents' offsets, give each
document's counts, and the places of its ids in the written form of the groups.

How often two ids are linked in the whole corpus is a sum by pair. Each block (what a task
reads, up to BLOCK_PAIRS distinct pairs) tells its distinct pairs once, with their numbers;
Spark sums them by pair, takes the highest of each B id, and returns both to the blocks by
joins. Documents keep their links as numbers of their block's pairs meanwhile, so that nothing is
coded twice, and no more than a block's distinct pairs comes back to one group.

Null or empty texts, and texts whose tokens' bytes are not a space and the text (B may
change or drop characters), have no tokens: zeros and ''. They add no links to the corpus.
Repeated rows count once each, ties for the highest count all count as best, very long
texts are coded whole, and an empty table gives no rows. Only id and text are read, whatever
other columns are called.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .bpe import _Table, ragged
from .common import Scratch, hand_back, load, reach, slices

#: Characters that are aligned at once, and distinct pairs after which a block ends.
SLICE, BLOCK_PAIRS = 2 << 20, 1_000_000


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class _Plain(bpe.Coder):
    """Byte pairs in which special tokens' strings are text like any other."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.special, self.mark = {}, None
        self.forget()


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Pair:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.a, self.b = _Plain(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_size = self.b.get_piece_size()
        self.a_bytes, self.b_bytes = self.a.tokens, _Table([_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b_size)])
        self.decimals = _Table([b"%d," % i for i in range(max(len(self.a_bytes.size), self.b_size))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and their numbers by text, and the same of B. Texts that either changes have none."""
        want = [b" " + t.encode() if t else b"" for t in texts]
        a, n_a = self.a.encode([" " + t if t else "" for t in texts])
        lists = self.b.encode(texts, num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter((i for x in lists for i in x), np.int64, int(n_b.sum()))
        size = np.fromiter(map(len, want), np.int64, len(want))
        # byte pairs spell the bytes that they were made of
        good = (size > 0) & (np.diff(_ends(self.a_bytes.size[a], n_a)) == size)
        raw, ends = self.b_bytes.gather(b).tobytes(), _ends(self.b_bytes.size[b], n_b)
        good &= np.array([raw[i:j] == w for w, i, j in zip(want, ends, ends[1:])], bool)
        return a[np.repeat(good, n_a)], n_a * good, b[np.repeat(good, n_b)], n_b * good


def _ends(size: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where each text begins, and the last ends, if its n items have these sizes."""
    return np.cumsum(np.concatenate(([0], size)), dtype=np.int64)[np.cumsum(np.concatenate(([0], n)))]


def align(pair: Pair, texts: list[str]) -> dict[str, np.ndarray | list[str]]:
    """n_a, n_b, n_groups, n_links, groups_sha256 of each text, and the ids a and b of all links."""
    a, n_a, b, n_b = pair.encode(texts)
    end_a, end_b = (np.cumsum(t.size[x], dtype=np.int64) - 1 for t, x in ((pair.a_bytes, a), (pair.b_bytes, b)))
    total = int(end_a[-1]) + 1 if len(end_a) else 0
    at_a, at_b = (np.bincount(e, minlength=total).astype(bool) for e in (end_a, end_b))
    cut, any_end = at_a & at_b, np.flatnonzero(at_a | at_b)
    document = _ends(pair.a_bytes.size[a], n_a)
    # tokens that end before a place: the number of the token that covers it
    upto_a, upto_b, upto_cut = (np.cumsum(x, dtype=np.int32) for x in (at_a, at_b, cut))
    link_a, link_b = a[(upto_a - at_a)[any_end]], b[(upto_b - at_b)[any_end]]
    groups = np.flatnonzero(cut)
    # the written form has a group's A ids before its B ids, group after group
    all_a, all_b = upto_a[groups], upto_b[groups]
    group_of_a, group_of_b = ((upto_cut - cut)[e] for e in (end_a, end_b))
    place_a = np.arange(len(a)) + np.concatenate(([0], all_b))[group_of_a]
    place_b = np.arange(len(b)) + all_a[group_of_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a], mark[place_b] = np.where(cut[end_a], ord("|"), ord(",")), np.where(cut[end_b], ord(";"), ord(","))
    written = pair.decimals.gather(ids)
    size = pair.decimals.size[ids]
    written[np.cumsum(size, dtype=np.int64) - 1] = mark
    raw, at = written.tobytes(), _ends(size, n_a + n_b)
    digests = [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at, at[1:])]
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.diff(np.searchsorted(groups, document)), "n_links": np.diff(np.searchsorted(any_end, document)),
        "groups_sha256": digests, "a": link_a, "b": link_b,
    }


@functools.lru_cache(1)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _packed(x: np.ndarray) -> bytes:
    """Small numbers as planes of bytes, which pack better."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


#: A row of documents (with their links as numbers into `own`, which are places among the block's pairs),
#: or the block's pairs with how many links it has of each.
SHAPE = (
    "block string, ids array<{id}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, links binary, pairs array<bigint>, counts array<bigint>"
)


def _blocks(paths: tuple[str, str], kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = _pair(*paths)
    big = pa.int64()
    shape = pa.schema([
        ("block", pa.string()), ("ids", pa.list_(kind)), *((c, pa.list_(big)) for c in ("n_a", "n_b", "n_groups", "n_links")),
        ("groups_sha256", pa.list_(pa.string())), ("links", pa.binary()), ("pairs", pa.list_(big)), ("counts", pa.list_(big)),
    ])

    def row(**made: object) -> pa.RecordBatch:
        columns = [pa.array([None], f.type) if made.get(f.name) is None else _single(made[f.name], f.type) for f in shape]
        return pa.RecordBatch.from_arrays(columns, schema=shape)

    def told() -> pa.RecordBatch:
        place = np.argsort(number)  # pairs by their number, which is the order in which they were met
        return row(block=block, pairs=keys[place], counts=counts[place])

    block, keys, counts, number = uuid.uuid4().hex, *(np.empty(0, np.int64) for _ in range(3))
    for batch in batches:
        for i, j in slices(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist(), SLICE):
            part = batch.slice(i, j - i)
            made = align(pair, [t or "" for t in part.column(1).to_pylist()])
            found, place, n = np.unique(made.pop("a").astype(np.int64) * pair.b_size + made.pop("b"), return_inverse=True, return_counts=True)
            # keys stay sorted; a pair keeps the number that it got when it was first met
            at = np.searchsorted(keys, found)
            old = np.zeros(len(found), bool)
            old[at < len(keys)] = keys[at[at < len(keys)]] == found[at < len(keys)]
            counts[at[old]] += n[old]
            fresh = np.flatnonzero(~old)
            fresh_number = len(keys) + np.argsort(np.argsort(-n[fresh], kind="stable"))
            numbers = np.empty(len(found), np.int64)
            numbers[old], numbers[fresh] = number[at[old]], fresh_number
            keys, counts, number = (np.insert(x, at[fresh], y) for x, y in ((keys, found[fresh]), (counts, n[fresh]), (number, fresh_number)))
            yield row(block=block, ids=part.column(0), links=_packed(numbers[place]), **made)
            if len(keys) > BLOCK_PAIRS:
                yield told()
                block, keys, counts, number = uuid.uuid4().hex, *(np.empty(0, np.int64) for _ in range(3))
    if len(keys):
        yield told()
    pair.a.forget()
    hand_back()


def _single(value: object, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array([value], kind)
    values = value if isinstance(value, pa.Array) else pa.array(value, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind.value_type))


def pair_counts(blocks: DataFrame, b_size: int) -> DataFrame:
    """pair, n (links in the corpus) and best (whether no pair of its B id has more)."""
    each = blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    summed = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    return summed.withColumn("b", F.col("pair") % b_size)


def _scores(block: tuple, left: pa.Table, right: pa.Table, kind: pa.DataType) -> pa.Table:
    """Of one block: its documents with the sums over their links."""
    place, n, best = (right.column(c).to_numpy() for c in ("place", "n", "best"))
    value, top = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    value[place], top[place] = n, best
    parts = []
    for i in range(left.num_rows):
        at = lambda name: left.column(name)[i].values  # noqa: B023, E731
        ends = np.concatenate(([0], np.cumsum(at("n_links").to_numpy())))
        links = _unpacked(left.column("links")[i].as_py())
        sums = [np.diff(np.concatenate(([0], np.cumsum(x[links], dtype=np.int64)))[ends]) for x in (top, value)]
        parts.append([at("ids"), *map(at, ("n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), at("groups_sha256")])
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kinds = [kind, *[pa.int64()] * 6, pa.string()]
    return pa.table({c: pa.chunked_array([p[k] for p in parts], t) for k, (c, t) in enumerate(zip(names, kinds))})


def aligned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """`id_col`, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, paths = df.sparkSession, paths or default_vocabularies()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = to_arrow_type(rows.schema["id"].dataType)
    reach(spark)
    scratch = Scratch(spark, "links")
    blocks = scratch.table(rows.mapInArrow(lambda batches: _blocks(paths, kind, batches), SHAPE.format(id=dict(rows.dtypes)["id"])))
    b_size = _pair(*paths).b_size
    counts = scratch.table(pair_counts(blocks, b_size))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most
    counts = counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    each = blocks.where("pairs is not null").select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    back = each.join(counts, "pair").select("of", "place", "n", "best")
    documents = blocks.where("ids is not null").drop("pairs", "counts")
    out = f"id {dict(rows.dtypes)['id']}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _scores(key, left, right, kind)

    made = documents.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(score, out)
    return made.withColumnRenamed("id", id_col)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned(load(spark, sf_dir, "documents"))
