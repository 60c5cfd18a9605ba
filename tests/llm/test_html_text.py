"""Main text: blocks, repetition against brute force, and edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm.html_text import MAIN_TEXT, MARKED, MIN_RUN, OUTSIDE, blocks_of, extract_main_text, repeated, suffix_array
from quire.llm.html_text import main_texts as main_texts_and_counts


def main_texts(pages):
    return [text for text, _, _ in main_texts_and_counts(pages)]

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><article>no";</script></head>
<body><nav><ul><li><a href="/x">x</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><div class="Cookie-notice"><p>We use</div>
<article class=post><h1>One &amp; two</h1><p>First<br>line&nbsp; &lt;b&gt; 1 < 2<p>Second <b>bold</b>er <form>f<input></form> end</p>
<aside>side</aside><div id="comments"><p>me too</p></div><ul><li>a<li>b</ul></article><footer>&copy; me</footer>"""


def test_blocks_follow_the_markup():
    assert main_texts([PAGE]) == ["One & two\n\nFirst line <b> 1 < 2\n\nSecond bolder\n\nend\n\na\n\nb"]
    assert blocks_of(None) == blocks_of("") == blocks_of("<p></p> \n") == []
    assert main_texts(["no markup at all", "<p>x", "a</nav>b"]) == ["no markup at all", "x", "a\n\nb"]


def test_names_of_classes_comments_and_blanks():
    assert main_texts(["<article><p>a</p><article class='comment'><p>me too</p></article><p>b</p></article>"]) == ["a\n\nb"]
    assert main_texts(["<p>a</p><p>&nbsp;</p><p> &#8203;</p><p>b</p>".replace("&#8203;", "&emsp;")]) == ["a\n\nb"]
    assert main_texts(["<div class='content no-sidebar'><p>all of it</p></div>"]) == ["all of it"]
    assert main_texts(["<article><section class='related-work'>kept</section><div class='comment-list'>x</div><div class='site-footer'>y</div></article>"]) == ["kept"]
    assert main_texts(["<p>one <span class=ad>buy</span>block <b><i class=promo>z</b> here</p>"]) == ["one block here"]
    assert main_texts(["<p>AT&amp;amp;T &lt;b&gt;</p>"]) == ["AT&amp;T <b>"]
    assert [k for _, k in blocks_of("<nav>m</nav><p>o</p><article>t</article>")] == [MARKED, OUTSIDE, MAIN_TEXT]


def test_ids_beside_nulls_are_exact(spark):
    rows = [(2**60 + 1, "http://h/", "<p>x"), (None, "http://h/", "<p>y")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id for r in got.collect()} == {2**60 + 1, None}


def test_suffix_array_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        s = [rng.randint(0, 2) for _ in range(rng.randint(0, 40))]
        order, lcp = suffix_array(np.array(s, np.int64))
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert order.tolist() == want
        for k in range(1, len(s)):
            a, b = s[want[k - 1] :], s[want[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == n


def test_whole_pages_equal_brute_force(spark):
    """Every page of a host against plain sets of runs: what is dropped, and that every page's tokens are in the array."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    extra = "<p>A notice that all pages of this host repeat word by word here</p><p>Only {0} has {0} this {0}</p>"
    pages = [(p.page_id, p.url, p.html.replace("<article>", extra.format(p.page_id) + "<article>", 1)) for p in pages]
    got = {r.page_id: r for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), 20_000).collect()}
    hosts = {}
    for i, url, h in pages:
        hosts.setdefault(url.split("/")[2], []).append((i, blocks_of(h)))
    for held in hosts.values():
        runs, streams = {}, {}
        for i, blocks in held:
            stream = []
            for text, kind in blocks:
                if kind != MAIN_TEXT:
                    n = len(text.split(" "))
                    start = stream[-1][2] + stream[-1][3] if stream else 0
                    stream.append((text, kind, start, n + max(1, MIN_RUN - n)))
            flat = [t for text, _, _, n in stream for t in [*text.split(" "), *["\n"] * (n - len(text.split(" ")))]]
            streams[i] = stream, flat
            for k in range(len(flat) - MIN_RUN + 1):
                runs.setdefault(tuple(flat[k : k + MIN_RUN]), set()).add(i)
        for i, blocks in held:
            stream, flat = streams[i]
            covered = [False] * len(flat)
            for k in range(len(flat) - MIN_RUN + 1):
                if len(runs[tuple(flat[k : k + MIN_RUN])]) > 1:
                    covered[k : k + MIN_RUN] = [True] * MIN_RUN
            at, kept = iter(stream), []
            for text, kind in blocks:
                if kind == MAIN_TEXT:
                    kept.append(text)
                else:
                    _, _, start, _ = next(at)
                    n = len(text.split(" "))
                    if kind == OUTSIDE and sum(covered[start : start + n]) < 0.5 * n:
                        kept.append(text)
            assert got[i].text == "\n\n".join(kept)
            assert got[i].n_tokens == len(flat) > 0 and got[i].n_repeated == sum(covered)
    assert sum(r.n_repeated > 0 for r in got.values()) > 0.9 * len(got)


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for run in (1, 2, 4, 8):
        for _ in range(20):
            streams = [np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 60))], np.int64) for _ in range(rng.randint(1, 5))]
            got = repeated(streams, run)
            for k, s in enumerate(streams):
                others = {tuple(o[i : i + run]) for j, o in enumerate(streams) if j != k for i in range(len(o) - run + 1)}
                want = np.zeros(len(s), bool)
                for i in range(len(s) - run + 1):
                    if tuple(s[i : i + run]) in others:
                        want[i : i + run] = True
                assert got[k].tolist() == want.tolist()


def test_repeated_blocks_without_main_go(spark):
    page = "<body><div>Home page of the daily stone with news about stones</div><p>{}</p><p>{}</p><div>Read on</div></body>"
    rows = [(i, "http://h.example/x", page.format(f"unique story {i} of a stone called {i * 7}", f"and more about {i}"), "z") for i in range(6)]
    rows += [(6, "http://alone.example/", rows[0][2], "z"), (7, None, None, "z"), (7, None, None, "z"), (8, "nonsense", "", "z"), (None, "http://h.example/y", "<article>kept Read on</article>", "z")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None and r.page_id < 6:
            assert r.text == f"unique story {r.page_id} of a stone called {r.page_id * 7}\n\nand more about {r.page_id}"
        assert r.n_chars == len(r.text)
    by = {r.page_id: r.text for r in got}
    assert by[6].startswith("Home page") and by[7] == by[8] == "" and by[None] == "kept Read on"
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repetition_decides_outside_the_article_too():
    page = "<p>Lead number {0} tells of stone {0} alone</p><div>Home page of the daily stone with all news about stones</div><article><p>Story {0}</p><p>Kept though all pages have it</p></article><p>Second part {0} after the article {0}</p>"
    want = "Lead number {0} tells of stone {0} alone\n\nStory {0}\n\nKept though all pages have it\n\nSecond part {0} after the article {0}"
    assert main_texts([page.format(k) for k in range(5)]) == [want.format(k) for k in range(5)]


def test_sharding_a_host_changes_nothing(spark):
    page = "<p>Story {0} of stone {0} alone and by itself {0}</p><div>{1}</div><div>Read on</div>"
    notice = lambda k: " ".join(f"n{k}w{j}" for j in range(12))
    rows = [(i, "http://h.example/x", page.format(i, notice(i % 20))) for i in range(40)]  # each notice on two pages
    rows += [(99, "http://small.example/", page.format(99, notice(0))), (None, "http://h.example/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    assert all(whole[i] == f"Story {i} of stone {i} alone and by itself {i}" for i in range(40)) and "n0w1" in whole[99]
    for chars in (400, 1000):
        assert {r.page_id: r.text for r in extract_main_text(pages, chars).collect()} == whole


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    for r in pages.select("page_id", "html", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("h1")).collect():
        import html

        assert got[r.page_id].startswith(" ".join(html.unescape(r.h1).split()))
        assert "©" not in got[r.page_id] and "track(" not in got[r.page_id]
