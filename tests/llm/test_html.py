import html as stdlib
import random
import re
import time

from skillgrid.llm import html as H

from .data import words

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body class="home page">
<header><a href=/>Site name</a></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><div id="cookie-notice">We use cookies</div>
<aside>side words</aside><article><header><h1>Head &amp; tail</h1></header><p><b>One&nbsp;two</b> three<br>four<p>five <i>six</i>se<b>ven</b> &lt;eight&gt;</p>
<form><input value=x>Sign up</form><div class="ad">buy</div><ul><li>a<li>b &#233;&euro;</ul><pre>x   y</pre></article><div class="comments"><p>nice</p></div>
<!-- <p>hidden</p> --><footer>(c) all</footer>{end}"""


def test_main_text():
    want = "Head & tail\n\nOne two three four\n\nfive six" + "seven <eight>\n\na\n\nb é€\n\nx y"
    assert H.texts_of([PAGE.format(end="</body></html>")]) == [want]
    assert H.texts_of([PAGE.format(end="")]) == [want]


def test_broken_pages():
    assert H.texts_of([None, "", "   ", "plain words", "<article><p>open <b>bold", "<p>a<script>b", "<p>a<!-- b", "a < b & c", "<article><div hidden>x</div>y</article>"]) == [
        "", "", "", "plain words", "open bold", "a", "a", "a < b & c", "y",
    ]


def test_repeated_runs_go_and_unique_ones_stay():
    rng = random.Random(1)
    notice = "this site is run by people who like long and plain notices on all pages"
    own = [words(rng, 40) for _ in range(30)]
    pages = [f"<html><body><div><p>{notice}</p><p>{o}</p><p>{notice} {o[:20]}</p></div></body></html>" for o in own]
    for text, o in zip(H.texts_of(pages), own):
        assert notice not in text and text.startswith(o)
    # copies of one page are one page
    assert H.texts_of([pages[0]] * 30)[0].startswith(notice)


def test_articles_survive_repeats():
    rng = random.Random(2)
    body = words(rng, 50)
    pages = [f"<article><h1>t{i}</h1><p>{body}</p><p>{words(rng, 20)}</p></article>" for i in range(6)]
    assert all(body in t for t in H.texts_of(pages))


def test_repeats_decide_on_text_outside_of_articles():
    rng = random.Random(3)
    notice = "this site is run by people who like long and plain notices on all pages"
    own = [(words(rng, 12), words(rng, 20)) for _ in range(30)]
    pages = [f"<body><p>{notice}</p><p>{lead}</p><article><p>{o}</p></article><ul><li><a href=x>{words(rng, 3)}</a></ul></body>" for lead, o in own]
    assert H.texts_of(pages) == [f"{lead}\n\n{o}" for lead, o in own]


def test_query_equals_plain_reading(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r["page_id"]: r for r in H.op10_html_extraction(spark, sf_dir).collect()}
    for p in pages:
        body = p["html"].split("<article>", 1)[1].split("</article>")[0]
        parts = (" ".join(stdlib.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", body))
        want = "\n\n".join(x for x in parts if x)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want) and got[p["page_id"]]["url"] == p["url"]


def test_odd_rows(spark):
    rows = [(1, None, PAGE.format(end="")), (1, None, PAGE.format(end="")), (2, "http://h/x", None), (3, "https://u:p@H:80/y", ""), (None, "h", "<p>x"), (4, "http://h/", "<p>" + "w " * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as host", "'c' as text", "'c' as shard", "'c' as n_chars", "'c' as k")
    out = H.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == 6
    got = {(r["page_id"], r["n_chars"] > 0) for r in out.collect()}
    assert got == {(1, True), (2, False), (3, False), (None, True), (4, True)}
    assert [r[0] for r in df.select(H.host_of(df["url"])).distinct().orderBy(H.host_of(df["url"])).collect()] == ["", "h"]
    assert H.extract(df.where("page_id = -1")).count() == 0


def test_large_hosts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARD_CHARS", 2000)
    monkeypatch.setattr(H, "SHARD_PAGES", 3)
    rows = [(i, "http://h/x", f"<article><p>page {i} " + "words " * 20) for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"].split()[1] for r in H.extract(df).collect()} == {i: str(i) for i in range(100)}


def test_shards_do_not_change_results(spark, monkeypatch):
    rng = random.Random(4)
    notice, rare = "this site is run by people who like long and plain notices", "a passage on too few of the pages to be a notice at all"
    body = words(rng, 30)
    rows = [(i, "http://h/x", f"<p>{words(rng, 30)}</p>" + f"<p>{notice}</p>" * (i < 6) + f"<p>{rare}</p>" * (6 <= i < 8)) for i in range(30)]
    rows += [(i, "http://m/x", f"<main><p>{words(rng, 20)}</p>" + f"<p>{body}</p>" * (i % 10 > 0) + f"</main><p>{notice}</p>") for i in range(100, 130)]
    rows += [(i, "http://c/x", f"<nav>{words(rng, 9)}</nav><p>{body}</p>") for i in range(200, 230)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {}
    for host in "hmc":
        own = [r for r in rows if r[1] == f"http://{host}/x"]
        want |= dict(zip([r[0] for r in own], H.texts_of([r[2] for r in own])))
    assert not any(notice in t for t in want.values()) and sum(rare in t for t in want.values()) == 2 and sum(body in want[i] for i in range(100, 130)) == 27 and all(want[i] == body for i in range(200, 230))
    for size, least in ((300, 1), (300, 4), (1000, 10), (3000, 2), (1_000_000, 64)):
        monkeypatch.setattr(H, "SHARD_CHARS", size)
        monkeypatch.setattr(H, "SHARD_PAGES", least)
        assert {r["page_id"]: r["text"] for r in H.extract(df).collect()} == want


def test_articles_stay_on_hosts_of_any_size():
    rng = random.Random(5)
    body = words(rng, 30)
    for n in (1, 9, 12, 40):
        pages = [f"<article><p>{body}</p><p>{words(rng, 12)}</p></article>" for _ in range(n)]
        assert all(t.startswith(body) for t in H.texts_of(pages))


def test_class_names_inside_articles():
    page = "<article><p class=share-price>The share price rose</p><h2 class=search>About search</h2><div class=search>Searching</div><div class='ad-slot'>buy</div><p class=ad>buy</p><div class='social-share box'>like</div></article>"
    assert H.texts_of([page]) == ["The share price rose\n\nAbout search\n\nSearching"]
    # outside of articles any such word tells
    assert H.texts_of(["<div class='page search'>x</div><div class=text>y</div>"]) == ["y"]


def every_repeat(pages):
    """Texts of pages with open blocks only: tokens in substrings of RUN tokens or more, of any
    length, that are in enough distinct pages go; blocks of fewer tokens go as a whole."""
    blocks = [[b.split() for b in re.findall("<p>(.*?)</p>", p)] for p in pages]
    distinct = {tuple(map(tuple, b)) for b in blocks}
    on = {}
    for page in distinct:
        seen = set()
        for b in page:
            for i in range(len(b)):
                for j in range(i + H.RUN, len(b) + 1):
                    seen.add(b[i:j])
            if len(b) < H.RUN:
                seen.add(b)
        for x in seen:
            on[x] = on.get(x, 0) + 1
    least = max(H.LEAST_PAGES, H.SHARE * len(distinct))
    out = []
    for page in blocks:
        kept = []
        for b in page:
            gone = set()
            for i in range(len(b)):
                for j in range(i + 1, len(b) + 1):
                    if (j - i >= H.RUN or j - i == len(b)) and on.get(tuple(b[i:j]), 0) >= least:
                        gone |= set(range(i, j))
            kept.append(" ".join(w for i, w in enumerate(b) if i not in gone))
        out.append("\n\n".join(k for k in kept if k))
    return out


def test_equals_all_repeated_substrings(spark, monkeypatch):
    for seed in range(6):
        rng = random.Random(seed)
        shared = [words(rng, rng.randint(3, 25)) for _ in range(6)]
        pages = []
        for _ in range(25):
            parts = [rng.choice([words(rng, rng.randint(1, 12)), rng.choice(shared), words(rng, 3) + " " + rng.choice(shared) + " " + words(rng, 2)]) for _ in range(4)]
            pages.append("".join(f"<p>{x}</p>" for x in parts))
        pages += pages[:2]
        want = every_repeat(pages)
        assert H.texts_of(pages) == want
        assert want != ["\n\n".join(re.findall("<p>(.*?)</p>", p)) for p in pages]
    monkeypatch.setattr(H, "SHARD_CHARS", 500)
    monkeypatch.setattr(H, "SHARD_PAGES", 4)
    df = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert [r["text"] for r in H.extract(df).orderBy("page_id").collect()] == want


def test_very_long_and_broken_pages():
    n = 350_000
    for page in ("<a " * n, "<a \">\"" * n, "<a '" * n, "<b>" * n + "</i>" * n, "<div>" * n + "x", "<p>" * n, "<!--" * n, "<" * 3 * n, "&amp;" * n, "<table><b></b>" * 60_000, "<li><a href=x>y</a>" * 50_000):
        began = time.perf_counter()
        H.texts_of([page])
        assert time.perf_counter() - began < 20
    assert H.texts_of(["<div>" * 5000 + "x" + "</div>" * 5000 + "y"]) == ["x\n\ny"]
    assert H.texts_of(["a<p>b<a href='x"]) == ["a\n\nb"]


def test_hosts_of_large_pages_report_few_runs(spark, monkeypatch):
    """Pages of 120 kB: a shard has so many of them that a run of one page is not reported, and
    what the runs take does not grow with the pages."""
    rng = random.Random(8)
    notice = words(rng, 60)
    pages = [(i, "http://h/", f"<p>{notice}</p>" * (i % 3 == 0) + f"<p>{words(rng, 20_000)}</p>") for i in range(160)]
    assert sum(len(p[2]) for p in pages) > 120_000 * 80
    made = []
    table = H.Scratch.table

    def seen(self, df):
        out = table(self, df)
        made.append(out)
        return out

    monkeypatch.setattr(H.Scratch, "table", seen)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(8)
    texts = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert all(notice not in t and len(t.split()) == 20_000 for t in texts.values())
    told = next(t for t in made if t.columns == ["host", "shard", "pages", "run", "n", "is_open"])
    assert told.where("run is null").count() == 2 and told.count() < 500
    assert not any("array" in kind for t in made for _, kind in t.dtypes)


def test_any_depth():
    deep = lambda n, inner: "<div>" * n + inner + "</div>" * n
    assert H.texts_of(["<article><p>a</p>" + deep(2000, "<div class=sidebar>side</div>") + "<p>b</p></article>"]) == ["a\n\nb"]
    assert H.texts_of(["<div class=sidebar>" + deep(1500, "menu") + "</div><p>open words here</p>"]) == ["open words here"]


def test_step_decides_where_there_is_no_article():
    rng = random.Random(7)
    notice = words(rng, 30)
    pages = [f"<body><div><p>{words(rng, 30)}</p><p>{notice}</p></div></body>" for _ in range(20)]
    with_step = H.texts_of(pages)
    parsed = [H.blocks_of(p) for p in pages]
    without = H.cleaned(parsed, H.np.empty(0, H.np.int64), H.np.empty(0, H.np.int64), len(pages))
    assert all(a != b and notice in b and notice not in a for a, b in zip(with_step, without))
