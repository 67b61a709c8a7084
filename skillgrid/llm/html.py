"""Main text of web pages from page structure and a host suffix array.

A page becomes blocks of text in page order. Each block has a kind from the elements
around it: `main` (inside article or main), `furniture` (menus, page headers, footers,
sidebars, notices, adverts, forms, comments, by element or by class name) or `open`.
The article stays as it is and furniture goes. On what is open, on pages with an article
or without, the host's suffix array decides: what is covered by long substrings repeated
across distinct pages goes, unique runs stay, and link lists go.

The token streams of a host's pages are concatenated and their suffixes sorted by prefix
doubling. Neighbours in that order with a common prefix of RUN tokens or more form an
interval; its strings are marked if they start on enough distinct pages of the host
(copies of a page count once). Sorting stops at RUN tokens, as that decides everything:
each window of RUN tokens of a longer repeated substring is on all pages which that is on,
so the tokens covered by all repeated substrings of RUN tokens or more are those covered
by the repeated windows. A block of under RUN tokens counts as a whole.

Pages are parsed once, into a table of their blocks. A host's distinct contents are dealt by
hash into shards of about SHARD_CHARS characters and SHARD_PAGES contents at least, each with
its own suffix array. A shard reports runs on half of SHARE of its contents, with their
numbers, as rows. A run that no more than half of SHARE of some shards' contents hold can reach
SHARE of the host only if the shards that report it make up for these: fewer than
20 times a page's runs can, however large the host. These are counted exactly where they were
not reported, so the result does not depend on how a host is dealt. All go between shards as
rows of host, shard and run; no row holds more than one page's blocks.

Null or empty html gives "". Null urls share one host. Truncated pages, unclosed elements
and repeated rows are read as they are; a tag that never ends takes the rest of its page.
Elements may be nested to any depth. Very long pages are read whole, in time linear in
their length. Runs at a threshold exactly are marked. An empty
table gives no rows. Only id, url and html are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, load, map_batches, shuffle_partitions

RUN = 8
SHARD_CHARS, SHARD_PAGES, TASK_SHARDS = 1_000_000, 64, 8
#: A run is boilerplate on so many distinct pages and this share of them.
LEAST_PAGES, SHARE = 3, 0.1
#: Share of its contents from which on a shard reports a run, and room for roundings.
REPORT, ROOM = SHARE / 2, 1e-6

# Element and class names of HTML practice.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
        "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
        "tfoot th thead title tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"html", "head", "body", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
SILENT = frozenset("script style noscript template svg math iframe object audio video canvas select option button input textarea "
        "label datalist head title map applet frameset noframes".split())
FURNITURE = frozenset("nav footer aside form menu dialog header fieldset search".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion promoted "
        "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottom sidebar side rail aside "
        "widget widgets notice notices cookie cookies consent gdpr alert popup modal overlay form newsletter subscribe "
        "subscription signup login search comment comments reply replies respond disqus discussion share sharing social related "
        "recommended recommendations pagination pager skip".split())
SAME_LEVEL = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}

#: Inside an article only names like these tell, and only if nothing else is in the name.
INNER = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr "
        "newsletter subscribe subscription comment comments reply replies respond disqus share sharing social related recommended "
        "recommendations pagination pager nav navbar navigation menu breadcrumb breadcrumbs sidebar footer popup modal overlay widget".split())
PARTS = frozenset("area bar block box buttons container content form inner item links list notice panel section slot thread unit wrap wrapper".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr table figure figcaption span a b i em strong small code "
        "q cite u s sub sup mark time abbr font".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsored".split())

_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_CLOSE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "noframes")}
_NOT_NAME = re.compile(r"[^a-z0-9]+")

#: End tags do not reach past these, unless they are of an element in ANCHORS.
BARRIERS, ANCHORS = frozenset({"article", "main", "table"}), frozenset("body html article main div section".split())

MAIN, OPEN, OFF = 2, 1, 0


def _named_furniture(tag: str, names: str, inside_main: bool) -> bool:
    if tag in ("main", "body", "html"):
        return False
    if tag == "article":
        return not {"comment", "comments", "reply"}.isdisjoint(_NOT_NAME.split(names))
    if not inside_main:
        return not MARKS.isdisjoint(_NOT_NAME.split(names))
    for one in names.split():
        words = set(_NOT_NAME.split(one)) - PARTS - {""}
        if words and words <= (ADVERTS if tag in TEXTUAL else INNER):
            return True
    return False


def _furniture(tag: str, attrs: str, inside_main: bool) -> bool:
    if tag in FURNITURE and not (tag == "header" and inside_main):
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name in ("class", "id") and _named_furniture(tag, value.lower(), inside_main):
            return True
        if name == "role" and value.lower() in ("complementary", "contentinfo", "navigation", "banner", "search", "dialog", "alert"):
            return True
    return False


def blocks_of(page: str) -> list[tuple[int, str, float]]:
    """Kind, text, and share of text inside links, of each non-empty block in order."""
    out: list[tuple[int, str, float]] = []
    stack: list[tuple[str, int, int]] = []  # tag, kind, and whether it is silent
    held: list[str] = []
    linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append((stack[-1][1] if stack else OPEN, text, min(1.0, linked / len(text))))
        held.clear()
        linked = 0

    def close_to(i: int) -> None:
        if any(t in BLOCKS for t, _, _ in stack[i:]):
            flush()
        for t, _, _ in stack[i:]:
            opened[t].pop()
        del stack[i:]

    def close_one(tags: Iterable[str], limits: frozenset[str] | set[str]) -> None:
        """Closes the innermost open element of `tags`, unless one of `limits` is further in."""
        at = max((opened[t][-1] for t in tags if opened.get(t)), default=-1)
        if at >= 0 and not any(opened[t][-1] > at for t in limits if opened.get(t)):
            close_to(at)

    opened: dict[str, list[int]] = {}  # places on the stack by tag
    quoted = True  # until a tag's quotes do not end: then tags end at the first bracket
    while at < len(page):
        m = _OPEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not (stack and stack[-1][2]):
            text = html.unescape(text)
            held.append(text)
            if opened.get("a"):
                linked += len(text.strip())
        if not m:
            break
        tag = (m[2] or "").lower()
        if not tag:
            end = page.find("-->" if m[0] == "<!--" else ">", m.end())
            at = len(page) if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        stop = _CLOSE.match(page, m.end()) if quoted else None
        if stop:
            at = stop.end()
        else:
            quoted = False
            end = page.find(">", m.end())
            if end < 0:
                break
            at = end + 1
        attrs = page[m.end() : at - 1]
        if m[1]:
            close_one((tag,), set() if tag in ANCHORS else BARRIERS)
            continue
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                held.append(" ")
            continue
        if tag in CLOSES_P:
            close_one(("p",), CLOSES_P)
        if tag in SAME_LEVEL:
            close_one(SAME_LEVEL[tag], LIMITS[tag])
        if tag in BLOCKS:
            flush()
        kind, silent = stack[-1][1:] if stack else (OPEN, 0)
        if kind != OFF:
            if _furniture(tag, attrs, kind == MAIN):
                kind = OFF
            elif tag in ("article", "main"):
                kind = MAIN
        if tag in _RAW and (tag in ("script", "style") or not attrs.endswith("/")):
            last = _RAW[tag].search(page, at)
            at = last.end() if last else len(page)
            continue
        if attrs.endswith("/") and tag not in BLOCKS:
            continue
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, kind, 1 if silent or tag in SILENT else 0))
    flush()
    return out


Block = tuple[int, str, float]
CODES = {"m": (MAIN, 0.0), "o": (OPEN, 0.0), "l": (OPEN, 1.0), "f": (OFF, 0.0)}


def coded(blocks: list[Block]) -> list[str]:
    """Each block as one line, which starts with a letter of CODES."""
    return [("m" if kind == MAIN else "f" if kind == OFF else "o" if linked < 0.5 else "l") + text for kind, text, linked in blocks]


def decoded(lines: Iterable[str]) -> list[Block]:
    return [(CODES[x[0]][0], x[1:], CODES[x[0]][1]) for x in lines]


def number_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def packed(lines: list[str]) -> bytes:
    return zstandard.compress("\n".join(lines).encode("utf-8", "surrogatepass"))


def unpacked(page: bytes) -> list[str]:
    text = zstandard.decompress(page).decode("utf-8", "surrogatepass")
    return text.split("\n") if text else []


def content_of(lines: list[str]) -> int:
    """Pages with one content, whatever their furniture, are copies."""
    return number_of("\n".join(x[1:] for x in lines if x[0] != "f"))


class Stream:
    """The words of all blocks, the places at which runs start, and the runs' hashes,
    which are the same in every shard. A block of under RUN words is a run of its own."""

    def __init__(self, pages: list[list[Block]]) -> None:
        ids: dict[str, int] = {}
        stream: list[int] = []
        sizes, page_of, kind_of = [], [], []
        for i, blocks in enumerate(pages):
            for kind, text, _ in blocks:
                words = text.split()
                stream += [ids.setdefault(w, len(ids) + 1) for w in words]
                stream += [0] * (RUN - 1)
                sizes.append(len(words))
                page_of.append(i)
                kind_of.append(kind)
        self.size, self.page_of, self.kind_of = np.array(sizes, np.int64), np.array(page_of, np.int64), np.array(kind_of, np.int64)
        self.begin = np.cumsum(self.size + RUN - 1) - (self.size + RUN - 1)
        self.ids, self.length = np.array([*stream, *[0] * RUN], np.int64), len(stream)
        block = np.repeat(np.arange(len(sizes)), self.size + RUN - 1)
        inner = np.arange(self.length) - self.begin[block]
        self.starts = np.flatnonzero((inner + RUN <= self.size[block]) | (inner == 0))
        self.block = block[self.starts]
        words = np.array([0, *map(number_of, ids)], np.int64).view(np.uint64)[self.ids]
        run = np.zeros(len(self.starts), np.uint64)
        for i in range(RUN):
            run = run * np.uint64(0x9E3779B97F4A7C15) + words[self.starts + i]
        self.run = run.view(np.int64)


def found(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run, that is each interval of the suffix array with a common prefix of RUN
    tokens: its hash, on how many of the pages it starts, and whether it does in an open
    block there. No two pages may be copies."""
    s = Stream(pages)
    rank = s.ids.copy()
    for step in (1, 2, 4):  # prefix doubling: suffixes by their first 2, 4 and 8 tokens
        rank[:-step] = np.unique(rank[:-step] << 32 | rank[step:], return_inverse=True)[1]
    rank, page, is_open = rank[s.starts], s.page_of[s.block], s.kind_of[s.block] == OPEN
    order = np.lexsort((page, rank))
    r, p = rank[order], page[order]
    first = np.ones(len(r), bool)  # where the common prefix with the suffix before is shorter
    first[1:] = r[1:] != r[:-1]
    fresh = first.copy()
    fresh[1:] |= p[1:] != p[:-1]
    group, n = np.cumsum(first) - 1, int(first.sum())
    return s.run[order][first], np.bincount(group, fresh, n).astype(np.int64), np.bincount(group, is_open[order], n) > 0


def cleaned(pages: list[list[Block]], runs: np.ndarray, n: np.ndarray, total: int) -> list[str]:
    """Main texts, given runs of the host (ascending hashes), on how many of its distinct
    pages each is, and the number of these."""
    if not len(runs):
        return ["\n\n".join(text for kind, text, linked in blocks if kind == MAIN or kind == OPEN and linked < 0.5) for blocks in pages]
    s = Stream(pages)
    at = np.minimum(np.searchsorted(runs, s.run), len(runs) - 1)
    seen = np.where(runs[at] == s.run, n[at], 0)
    cover = np.zeros(s.length + RUN + 1, np.int64)
    hits = s.starts[seen >= max(LEAST_PAGES, SHARE * total)]
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + RUN, -1)
    covered = np.cumsum(cover)[: s.length] > 0
    out, k = [], 0
    for blocks in pages:
        kept = []
        for kind, text, linked in blocks:
            if kind == MAIN:
                kept.append(text)
            elif kind == OPEN and linked < 0.5:
                own = covered[s.begin[k] : s.begin[k] + s.size[k]]
                text = text if not own.any() else " ".join(w for w, c in zip(text.split(), own) if not c)
                if text:
                    kept.append(text)
            k += 1
        out.append("\n\n".join(kept))
    return out


def distinct(pages: Iterable[tuple[int, list[str]]]) -> list[list[str]]:
    """The blocks of each content; copies add the furniture that is theirs alone."""
    held: dict[int, dict[str, None]] = {}
    for content, lines in pages:
        held.setdefault(content, {}).update(dict.fromkeys(lines))
    return [list(x) for x in held.values()]


def texts_of(pages: list[str | None]) -> list[str]:
    """Main texts of all pages of one host."""
    parsed = [blocks_of(p or "") for p in pages]
    lines = list(map(coded, parsed))
    each = distinct(zip(map(content_of, lines), lines))
    runs, n, _ = found(list(map(decoded, each)))
    order = np.argsort(runs)
    return cleaned(parsed, runs[order], n[order], len(each))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _shard_runs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one shard: a row with the number of its contents and whether any has an open block,
    and a row for each run that it reports."""
    whole, lines = True, []
    for x in batches:
        whole = x.column("shards")[0].as_py() == 1
        lines += zip(x.column("content").to_pylist(), map(unpacked, x.column("blocks").to_pylist()))
    each = distinct(lines)
    runs, n, is_open = found(list(map(decoded, each)))
    # the only shard of a host knows what decides
    keep = (n + ROOM >= max(LEAST_PAGES, SHARE * len(each))) & is_open if whole else n + ROOM >= REPORT * len(each)
    m, any_open = int(keep.sum()), bool(is_open.any())
    columns = {
        "host": pa.array([key[0].as_py()] * (m + 1), pa.string()), "shard": pa.array([key[1].as_py()] * (m + 1), pa.int64()),
        "pages": pa.array([len(each)] * (m + 1), pa.int64()), "run": pa.array([None, *runs[keep].tolist()], pa.int64()),
        "n": pa.array([None, *n[keep].tolist()], pa.int64()), "is_open": pa.array([any_open, *is_open[keep].tolist()], pa.bool_()),
    }
    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _recount(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one shard: on how many of its contents the runs on the right are."""
    shape = pa.schema([("host", pa.string()), ("run", pa.int64()), ("n", pa.int64()), ("is_open", pa.bool_())])
    wanted = np.unique(right.column("run").to_numpy())
    if not left.num_rows or not len(wanted):
        return shape.empty_table()
    each = distinct(zip(left.column("content").to_pylist(), map(unpacked, left.column("blocks").to_pylist())))
    run, n, is_open = found(list(map(decoded, each)))
    keep = np.isin(run, wanted)
    return pa.table([[key[0].as_py()] * int(keep.sum()), run[keep], n[keep], is_open[keep]], schema=shape)


def _without(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one shard: the texts of its pages without the runs on the right."""
    runs = np.unique(right.column("run").to_numpy())
    texts: list[str] = []
    for i in range(0, left.num_rows, SHARD_PAGES):
        pages = [decoded(unpacked(b)) for b in left.column("blocks").slice(i, SHARD_PAGES).to_pylist()]
        texts += cleaned(pages, runs, np.full(len(runs), 2**31), 0)
    return pa.table({"k": left.column("k"), "u": left.column("u"), "text": pa.array(texts, pa.string())})


def host_runs(parsed: DataFrame, shards: DataFrame, scratch: Scratch) -> DataFrame:
    """host and run: all runs that are on enough of the distinct contents of a host and in an
    open block of one. `parsed` has host, shard, shards, content and blocks, and `shards` host
    and shards."""
    spark = parsed.sparkSession
    many = shards.agg(F.sum("shards")).first()[0] or 1
    tasks = max(shuffle_partitions(spark), int(many) // TASK_SHARDS)  # tasks of a few shards each, however large the table
    dealt = parsed.select("host", "shard", "shards", "content", "blocks").repartition(tasks, "host", "shard")
    shape = "host string, shard long, pages long, run long, n long, is_open boolean"
    told = scratch.table(dealt.groupBy("host", "shard").applyInArrow(_shard_runs, shape))
    totals = told.where("run is null").groupBy("host").agg(F.sum("pages").alias("total"), F.max("is_open").alias("any_open"), F.count("*").alias("shards"))
    totals = scratch.table(totals.where("any_open"))
    summed = told.where("run is not null").groupBy("host", "run")
    summed = summed.agg(F.sum("n").alias("n"), F.sum("pages").alias("of"), F.max("is_open").alias("is_open")).join(scratch.hint(totals), "host")
    least = F.greatest(F.lit(float(LEAST_PAGES)), F.lit(SHARE) * F.col("total"))
    summed = scratch.table(summed.where(F.col("n") + F.lit(REPORT) * (F.col("total") - F.col("of")) + ROOM >= least))
    enough = F.col("is_open") & (F.col("n") + ROOM >= least)
    sure = summed.where((F.col("of") == F.col("total")) & enough).select("host", "run")
    unsure = summed.where("of < total").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "run")
    again = parsed.join(scratch.hint(summed.where("of < total").select("host").distinct().transform(scratch.table)), "host", "left_semi")
    again = again.select("host", "shard", "content", "blocks").groupBy("host", "shard").cogroup(unsure.groupBy("host", "shard"))
    again = again.applyInArrow(_recount, "host string, run long, n long, is_open boolean").groupBy("host", "run")
    again = again.agg(F.sum("n").alias("n"), F.max("is_open").alias("is_open")).join(scratch.hint(totals), "host")
    return scratch.table(sure.unionByName(again.where(enough).select("host", "run")))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`id_col`, url, text and n_chars of every row."""
    scratch, kind = Scratch(df.sparkSession, "hosts"), dict(df.dtypes)[id_col]
    rows = df.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{url_col}`").alias("u"), F.col(f"`{html_col}`").alias("h"), host_of(F.col(f"`{url_col}`")).alias("host"))

    def parse(x: dict[str, list]) -> dict[str, list]:
        lines = [coded(blocks_of(h or "")) for h in x["h"]]
        return {
            "k": x["k"], "u": x["u"], "host": x["host"], "content": list(map(content_of, lines)),
            "size": [sum(map(len, x)) for x in lines], "blocks": list(map(packed, lines)),
        }

    parsed = scratch.table(map_batches(rows, f"k {kind}, u string, host string, content long, size long, blocks binary", parse, "h"))
    contents = parsed.groupBy("host", "content").agg(F.max("size").alias("size")).groupBy("host").agg(F.count("*").alias("pages"), F.sum("size").alias("chars"))
    by_pages, by_chars = F.floor(F.col("pages") / SHARD_PAGES), F.ceil(F.col("chars") / SHARD_CHARS)
    shards = scratch.table(contents.select("host", F.greatest(F.lit(1), F.least(by_pages, by_chars)).cast("long").alias("shards")))
    parsed = parsed.join(scratch.hint(shards), "host").withColumn("shard", F.pmod("content", "shards"))
    often = host_runs(parsed, shards, scratch)
    hosts = scratch.hint(scratch.table(often.select("host").distinct()))

    def plain(x: dict[str, list]) -> dict[str, list]:
        none = np.empty(0, np.int64)
        return {"k": x["k"], "u": x["u"], "text": cleaned([decoded(unpacked(b)) for b in x["blocks"]], none, none, 0)}

    shape = f"k {kind}, u string, text string"
    others = map_batches(parsed.join(hosts, "host", "left_anti").select("k", "u", "blocks"), shape, plain, "blocks")
    # the runs of a host go to each of its shards
    of_shard = often.join(scratch.hint(shards), "host").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "run")
    pages = parsed.join(hosts, "host", "left_semi").select("host", "shard", "k", "u", "blocks").groupBy("host", "shard")
    made = others.unionByName(pages.cogroup(of_shard.groupBy("host", "shard")).applyInArrow(_without, shape))
    return made.select(F.col("k").alias(id_col), F.col("u").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
