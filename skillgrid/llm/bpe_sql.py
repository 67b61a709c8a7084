"""Byte-level byte-pair encoding and decoding by recursive queries in DuckDB, for each partition.

The vocabulary is a list of byte strings with ranks, which are the ids. Its merge table has
a row for each way to cut an entry into two others. The words of a partition that have not
been met yet (pieces of the split pattern) become rows of a token and its position. A
recursive query joins neighbouring rows with the merge table, finds each word's
lowest-ranked pair (of equal ones the leftmost) and contracts it, until no word has a pair
left. A word that is an entry is that entry. Decoding joins rows of ids with the
vocabulary and puts the byte strings together in order of their positions.

Words are remembered with their ids and decoded bytes by each Python worker, up to bounds,
after which the memory starts anew; documents are gathered from them. Words of over LONG bytes would
take a round for each merge: they go by rank in numpy, as in bpe.Coder.merge_long.

Null text counts as empty (no ids, no bytes), null ids decode to null, ids that are no entry
decode to nothing; repeated rows are kept, very long texts are coded whole, an empty table
gives no rows. Other columns follow, but those that give way to the results.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .bpe import ragged
from .common import hand_back, load, reach, slices

MEMORY_WORDS, MEMORY_BYTES = 800_000, 16_000_000
#: Characters whose new words go into one query.
BLOCK_CHARS = 4 << 20
#: Bytes of a word that goes through the query. A place is word * 512 + position.
LONG = 256

#: Rows of all rounds; a word's last round is its result. A candidate is the number
#: (rank * 512 + position) * 512 + size, so the least is the leftmost lowest-ranked pair.
ENCODE = """
WITH RECURSIVE work(round, place, size, id) AS (
    SELECT 0, place, 1, id FROM symbols
    UNION ALL
    SELECT w.round + 1, w.place, CASE WHEN w.place = b.place THEN b.size ELSE w.size END, CASE WHEN w.place = b.place THEN b.made ELSE w.id END
    FROM work w JOIN (
        SELECT word, (word << 9) + ((least >> 9) & 511) AS place, (least & 511)::INTEGER AS size, (least >> 18)::INTEGER AS made
        FROM (SELECT l.place >> 9 AS word, min((m.made << 18) + ((l.place & 511) << 9) + m.size) AS least
            FROM work l JOIN work r ON r.place = l.place + l.size JOIN merges m ON m.pair = (l.id::BIGINT << 32) + r.id GROUP BY 1)
    ) b ON b.word = w.place >> 9
    WHERE w.place <= b.place OR w.place >= b.place + b.size
),
done AS (SELECT place >> 9 AS word, max(round) AS round FROM work GROUP BY 1)
SELECT w.place >> 9 AS word, w.id FROM work w JOIN done d ON d.word = w.place >> 9 AND d.round = w.round ORDER BY w.place
"""
DECODE = "SELECT r.word, string_agg(v.hex, '' ORDER BY r.place) AS hex FROM rows r JOIN vocabulary v USING (id) GROUP BY r.word ORDER BY r.word"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class SqlCoder(bpe.Coder):
    """Codes words by queries; what it takes from its parent is the numpy way for long
    words, which the parent's tables drive."""

    def __init__(self, path: str) -> None:
        ranks = read_ranks(path)
        self.ranks_of, self.special, self.mark = ranks, {}, None
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        cuts = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], made) for t, made in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.keys, self.ranks = np.array([k for k, _ in cuts], np.int64), np.array([r for _, r in cuts], np.int32)
        self.made = np.arange(max(ranks.values()) + 1, dtype=np.int32)
        self.split = regex.compile(bpe.PATTERN.replace(r"[^\s", f"[^{bpe.SPACES}").replace(r"\s", f"[{bpe.SPACES}]").replace(r"\S", f"[^{bpe.SPACES}]"))
        size = np.zeros(len(self.made), np.int32)
        size[list(ranks.values())] = list(map(len, ranks))
        # one thread a task; memory in bounds that a block's words stay far under
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "preserve_insertion_order": False})
        self._table("merges", pair=self.keys, made=self.ranks.astype(np.int64), size=size[self.ranks])
        self._table("vocabulary", id=np.fromiter(ranks.values(), np.int32, len(ranks)), hex=[t.hex() for t in ranks])
        self.forget()

    def _table(self, name: str, **columns: object) -> None:
        self.db.register("given", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS FROM given")
        self.db.unregister("given")

    def _query(self, text: str, name: str, **columns: object) -> pa.Table:
        self.db.register(name, pa.table({k: pa.array(v) for k, v in columns.items()}))
        try:
            return self.db.sql(text).to_arrow_table()
        finally:
            self.db.unregister(name)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = (np.empty(0, np.int32) for _ in range(3))
        self.raw, self.raw_start, self.raw_size = np.empty(0, np.uint8), np.empty(0, np.int32), np.empty(0, np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has, by the recursive query."""
        whole = np.fromiter((self.ranks_of.get(w, -1) for w in words), np.int32, len(words))
        open_ = np.flatnonzero(whole < 0)
        n = (whole >= 0).astype(np.int32)
        if not len(open_):
            return whole, n
        size = np.fromiter((len(words[i]) for i in open_), np.int64, len(open_))
        symbols = self.first[np.frombuffer(b"".join([words[i] for i in open_]), np.uint8)]
        place = np.repeat(open_ * 512 - (np.cumsum(size) - size), size) + np.arange(len(symbols))
        found = self._query(ENCODE, "symbols", place=place, id=symbols)
        word, ids = (found.column(c).to_numpy() for c in ("word", "id"))
        n += np.bincount(word, minlength=len(words)).astype(np.int32)
        out = np.empty(int(n.sum()), np.int32)
        entry = np.zeros(len(out), bool)
        entry[(np.cumsum(n) - n)[whole >= 0]] = True
        out[entry], out[~entry] = whole[whole >= 0], ids
        return out, n

    def join(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of rows of ids in one array, and how many each row has, by the ordered aggregate."""
        word = np.repeat(np.arange(len(n), dtype=np.int32), n)
        found = self._query(DECODE, "rows", word=word, place=np.arange(len(ids), dtype=np.int32), id=ids.astype(np.int32))
        size = np.zeros(len(n), np.int32)
        size[found.column("word").to_numpy()] = pc.binary_length(found.column("hex")).to_numpy() // 2
        return np.frombuffer(bytes.fromhex("".join(found.column("hex").to_pylist())), np.uint8), size

    def learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        for long in (False, True):
            some = [i for i, w in enumerate(raw) if (len(w) > LONG) == long]
            if not some:
                continue
            flat, size = (self.merge_long if long else self.merge)([raw[i] for i in some])
            raw_flat, raw_size = self.join(flat, size)
            self.raw_start = np.concatenate((self.raw_start, (len(self.raw) + np.cumsum(raw_size) - raw_size).astype(np.int32)))
            self.raw_size, self.raw = np.concatenate((self.raw_size, raw_size)), np.concatenate((self.raw, raw_flat))
            self._add([words[i] for i in some], flat, size)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The remembered numbers of the words of all texts in one array, and how many words each has."""
        if len(self.known) > MEMORY_WORDS or len(self.raw) > MEMORY_BYTES:
            self.forget()
        pieces = [self.split.findall(t) for t in texts]
        fresh = list(set().union(*pieces) - self.known.keys())
        if fresh:
            self.learn(fresh)
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return np.fromiter(map(self.known.__getitem__, (w for p in pieces for w in p)), np.int32, int(n.sum())), n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers, n = self.numbers(texts)
        size = self.size[numbers]
        return ragged(self.flat, self.start[numbers], size), _per_text(size, n)

    def code(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """The ids of each text, and the bytes that they decode to."""
        numbers, n = self.numbers(texts)
        for part in np.split(numbers, np.cumsum(n)[:-1]):
            yield ragged(self.flat, self.start[part], self.size[part]), ragged(self.raw, self.raw_start[part], self.raw_size[part]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.join(ids, np.array([len(ids)]))[0].tobytes().decode("utf-8", "replace")


def _per_text(size: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.diff(np.cumsum(np.concatenate(([0], size)), dtype=np.int64)[np.cumsum(np.concatenate(([0], n)))])


@functools.lru_cache(1)
def coder(path: str) -> SqlCoder:
    return SqlCoder(path)


def _map(df: DataFrame, path: str, schema: str, sizes: Callable[[pa.RecordBatch], list[int]], work: Callable[[SqlCoder, pa.RecordBatch], dict[str, object]]) -> DataFrame:
    """Slices of Arrow batches of about BLOCK_CHARS by `sizes` through `work`, which makes
    some columns; the others of the schema follow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for a, b in slices(sizes(batch), BLOCK_CHARS):
                part = batch.slice(a, b - a)
                made = work(c, part)
                columns = [pa.array(made[f.name], f.type) if f.name in made else part.column(part.schema.names.index(f.name)).cast(f.type) for f in out]
                yield pa.RecordBatch.from_arrays(columns, schema=out)
        hand_back()

    reach(df.sparkSession)
    return df.mapInArrow(run, schema)


def _lengths(name: str) -> Callable[[pa.RecordBatch], list[int]]:
    return lambda batch: pc.fill_null(pc.utf8_length(batch.column(batch.schema.names.index(name))), 0).to_pylist()


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.names.index(name)).to_pylist()]


def _shape(df: DataFrame, rest: list[str], *made: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), *made])


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, out_col: str = "ids") -> DataFrame:
    """All columns of df with `out_col`, an array of ids."""
    rest = [c for c in df.columns if c != out_col]

    def work(c: SqlCoder, part: pa.RecordBatch) -> dict[str, object]:
        ids, n = c.encode(_texts(part, text_col))
        return {out_col: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32()))}

    rows = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*rest, text_col])])
    return _map(rows, path or default_vocabulary(), _shape(df, rest, f"`{out_col}` array<int>"), _lengths(text_col), work)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, out_col: str = "decoded") -> DataFrame:
    """All columns of df with `out_col`, the bytes of the ids."""
    rest = [c for c in df.columns if c != out_col]

    def work(c: SqlCoder, part: pa.RecordBatch) -> dict[str, object]:
        lists = part.column(part.schema.names.index(ids_col)).to_pylist()
        n = np.array([len(x or ()) for x in lists], np.int64)
        ids = np.array([i for x in lists for i in x or () if i is not None], np.int64)
        n -= np.array([sum(i is None for i in x or ()) for x in lists], np.int64)
        raw, size = c.join(ids, n)
        ends = np.cumsum(size)
        return {out_col: [None if x is None else raw[b - k : b].tobytes() for x, b, k in zip(lists, ends, size)]}

    sizes = lambda batch: pc.fill_null(pc.list_value_length(batch.column(batch.schema.names.index(ids_col))), 0).to_pylist()
    return _map(df, path or default_vocabulary(), _shape(df, rest, f"`{out_col}` binary"), sizes, work)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encodes and decodes each text; the number of ids, and digests of the ids (unsigned
    32-bit integers, little-endian) and of the decoded bytes."""

    def work(c: SqlCoder, part: pa.RecordBatch) -> dict[str, object]:
        n, ids_digest, raw_digest = [], [], []
        for ids, raw in c.code(_texts(part, "_text")):
            n.append(len(ids))
            ids_digest.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            raw_digest.append(hashlib.sha256(raw).hexdigest())
        return {"n_tokens": n, "ids_sha256": ids_digest, "decoded_sha256": raw_digest}

    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text"))
    return _map(rows, path or default_vocabulary(), _shape(df, [id_col], "n_tokens long", "ids_sha256 string", "decoded_sha256 string"), _lengths("_text"), work)


def op12_bpe_by_queries(spark, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "documents"))
