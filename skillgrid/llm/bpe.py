"""Byte-pair encoding and decoding by batched numpy merge rounds.

The words of a batch (pieces of the tokenizer's own split pattern) that have not been
met yet lie in one flat array of byte symbols. In each round all neighbouring pairs are
looked up by binary search in the sorted pair keys; each word merges all occurrences of
its lowest-ranked pair, left to right; words without a known pair are done. A symbol
made by a merge only takes part in later merges, so merging all occurrences of the
lowest pair at once gives the same symbols as one merge at a time. Words are remembered
with their ids within a partition, up to bounds, after which the memory starts anew.

Words of over LONG bytes, which would take many rounds, go by rank instead: each round
merges the lowest-ranked pair of all of them, and only pairs next to a merge are looked up
again, so the work of a word is near its length, however long it is.

Ids become text by gathering each id's bytes. A special token's own string in a text is
that token. Null text counts as empty (no ids, text ""); repeated rows are kept, very long
texts are coded whole, and an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, map_batches

#: The pattern of byte-level tokenizers (a fixed value of the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of Unicode's White_Space property, which \s has to mean.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MEMORY_WORDS, MEMORY_IDS = 200_000, 4_000_000
LONG = 192
NONE = np.int32(2**31 - 1)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, and the
    others as the letters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + size[i]] for all i, one after the other."""
    total = int(size.sum())
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return flat[shift + np.arange(total, dtype=shift.dtype)]


class _Table:
    """Byte strings by number, for gathering."""

    def __init__(self, items: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(items), np.uint8)
        self.size = np.fromiter(map(len, items), np.int32, len(items))
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)

    def gather(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.flat, self.start[ids], self.size[ids])


class Coder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            tokens[i] = token.encode() if token in self.special else raw(token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.tokens, self.decimals = _Table(tokens), _Table([b"%d," % i for i in range(len(tokens))])
        self.first = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.split = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))
        self.mark = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = (np.empty(0, np.int32) for _ in range(3))
        if self.special:
            self._add(list(self.special), np.array(list(self.special.values()), np.int32), np.ones(len(self.special), np.int32))

    def _add(self, words: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.start = np.concatenate((self.start, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)))
        self.size, self.flat = np.concatenate((self.size, size)), np.concatenate((self.flat, flat))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, NONE where there is no such merge."""
        want = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def merge_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What merge() gives, by rank: places wait under the rank of the pair that begins
        there, and symbols are linked, so that a merge costs what lies next to it."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids, word = self.first[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), size)
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(size)
        after[ends - 1] = n  # no pair reaches into the next word
        before[ends - size] = -1
        alive, rank = np.ones(n, bool), np.full(n, NONE, np.int32)
        ranks: list[int] = []
        waiting: dict[int, list[np.ndarray]] = {}

        def look_up(at: np.ndarray) -> None:
            rank[at] = NONE
            at = at[after[at] < n]
            rank[at] = self._ranks(ids[at], ids[after[at]])
            at = at[rank[at] != NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            found = rank[at]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for r, part in zip(found[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

        look_up(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            parts = waiting.pop(r)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            # in a run of overlapping pairs every other one merges, from the left
            new = np.concatenate(([True], after[at[:-1]] != at[1:]))
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0]
            gone = after[at]
            ids[at], alive[gone], rank[gone] = self.made[r], False, NONE
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at[inside]]] = at[inside]
            left = before[at]
            look_up(np.unique(np.concatenate((at, left[left >= 0]))))
        return ids[alive], np.bincount(word[alive], minlength=len(words)).astype(np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids, word = self.first[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), size)
        done_ids, done_word = [], []
        while len(ids):
            rank = np.full(len(ids), NONE, np.int32)
            if len(ids) > 1:
                rank[:-1] = np.where(word[1:] == word[:-1], self._ranks(ids[:-1], ids[1:]), NONE)
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(ids))))
            over = least == NONE
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
            pick = np.flatnonzero((rank == least) & ~over)
            if len(pick):
                # in a run of overlapping pairs every other one merges, from the left
                run = np.concatenate(([True], np.diff(pick) != 1))
                head = np.maximum.accumulate(np.where(run, pick, 0))
                pick = pick[(pick - head) % 2 == 0]
                ids = ids.copy()
                ids[pick] = self.made[rank[pick]]
            keep = ~over
            keep[pick + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate(done_ids or [np.empty(0, np.int32)]), np.concatenate(done_word or [np.empty(0, np.int64)])
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words)).astype(np.int32)

    def pieces(self, text: str) -> list[str]:
        if self.mark is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        out: list[str] = []
        for part in self.mark.split(text):
            if part in self.special:
                out.append(part)
            else:
                out += self.split.findall(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has."""
        if len(self.known) > MEMORY_WORDS or len(self.flat) > MEMORY_IDS:
            self.forget()
        pieces = [self.pieces(t) for t in texts]
        fresh = list(set().union(*pieces) - self.known.keys())
        raw = [w.encode() for w in fresh]
        for long in (False, True):
            some = [i for i, w in enumerate(raw) if (len(w) > LONG) == long]
            if some:
                self._add([fresh[i] for i in some], *(self.merge_long if long else self.merge)([raw[i] for i in some]))
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        get = self.known.__getitem__
        numbers = np.fromiter((i for p in pieces for i in map(get, p)), np.int32, int(n.sum()))
        size = self.size[numbers]
        ends = np.cumsum(np.concatenate(([0], size)), dtype=np.int64)[np.cumsum(np.concatenate(([0], n)))]
        return ragged(self.flat, self.start[numbers], size), np.diff(ends)

    def decode(self, ids: np.ndarray) -> str:
        return self.tokens.gather(ids).tobytes().decode("utf-8", "replace")


@functools.lru_cache(1)
def coder(path: str) -> Coder:
    return Coder(path)


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, out_col: str = "ids", exact_col: str | None = None) -> DataFrame:
    """All columns of df with `out_col`, an array of ids, and on demand `exact_col`, whether
    decoding them gives the text; columns of these names give way."""
    path = path or default_vocabulary()
    made = [c for c in (out_col, exact_col) if c]
    rest = [c for c in df.columns if c not in made]

    def work(rows: dict[str, list]) -> dict[str, list]:
        c, texts = coder(path), [t or "" for t in rows[text_col]]
        flat, n = c.encode(texts)
        ids = np.split(flat, np.cumsum(n)[:-1])
        exact = {exact_col: [c.decode(x) == t for x, t in zip(ids, texts)]} if exact_col else {}
        return {c: rows[c] for c in rest} | {out_col: ids} | exact

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"`{out_col}` array<int>", *([f"`{exact_col}` boolean"] if exact_col else [])])
    return map_batches(df.select(*[F.col(f"`{c}`") for c in {*rest, text_col}]), schema, work, text_col, lambda: coder(path).forget())


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, out_col: str = "decoded") -> DataFrame:
    """All columns of df with `out_col`, the text of the ids (null ids: null text)."""
    path = path or default_vocabulary()
    rest = [c for c in df.columns if c != out_col]

    def work(rows: dict[str, list]) -> dict[str, list]:
        c = coder(path)
        return {n: rows[n] for n in rest} | {out_col: [None if x is None else c.decode(np.array(x, np.int32)) for x in rows[ids_col]]}

    kinds = dict(df.dtypes)
    return map_batches(df, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + f", `{out_col}` string", work)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encodes and decodes each text; the number of ids and digests of ids and text."""
    path = path or default_vocabulary()

    def work(rows: dict[str, list]) -> dict[str, list]:
        c = coder(path)
        ids, n = c.encode([t or "" for t in rows["t"]])
        at = np.cumsum(np.concatenate(([0], n)))
        edges = lambda table: np.cumsum(np.concatenate(([0], table.size[ids])), dtype=np.int64)[at].tolist()
        text, ends = c.tokens.gather(ids).tobytes(), edges(c.tokens)
        comma, stops = c.decimals.gather(ids).tobytes(), edges(c.decimals)
        lossy = lambda raw: raw.decode("utf-8", "replace").encode()
        return {
            id_col: rows["k"], "n_tokens": n,
            "ids_sha256": [hashlib.sha256(comma[a : max(a, b - 1)]).hexdigest() for a, b in zip(stops, stops[1:])],
            "decoded_sha256": [hashlib.sha256(lossy(text[a:b])).hexdigest() for a, b in zip(ends, ends[1:])],
        }

    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    return map_batches(rows, f"`{id_col}` {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string", work, "t", lambda: coder(path).forget())


def op6_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "documents"))
