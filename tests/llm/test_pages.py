import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, connection
from tidewheel.llm import html_text, queries, urls

RULES = queries.URL_RULES
URLS = [
    None, "", "no scheme", "http://", "http://org/", "https://Sub.EXAMPLE.org/es/x", "http://example.org/en/12", "http://badexample.org/es/", "http://a.com/fr", "http://a.com/fr/?q", "http://x.com/de/a#b",
    "http://x.com?de/", "x://y://z.org/a", "http://org", "http://é.org/ü", "http://a..org//", "http://example.org/en/1", "//example.org/es/", "http://user@a.com:80/de/", "http://a.com/" + "de/" * 5000,
]


def slow_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_urls_by_hand(spark):
    pages = spark.createDataFrame([(i, u, 1.0, "p") for i, u in enumerate([*URLS, *URLS])] + [(None, URLS[5], 1.0, "p")], "page_id long, url string, host double, verdict string")
    rows = urls.judge(pages, RULES).collect()
    assert len(rows) == 2 * len(URLS) + 1
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == slow_judge(URLS[r["page_id"] % len(URLS)] if r["page_id"] is not None else URLS[5])
    assert urls.judge(pages.where(F.lit(False)), RULES).count() == 0


def test_long_hosts_and_many_nameless_urls(spark):
    hosts = ["a." * 50_000 + "example.org", "x" * 100_000 + ".com", "." * 60_000, "com" + "." * 9]
    pages = spark.createDataFrame([(i, f"https://{h}/es/{'d/' * 20_000}") for i, h in enumerate(hosts)] + [(9, None)] * 500, "page_id long, url string")
    begin = time.time()
    rows = urls.judge(pages, RULES).collect()
    assert time.time() - begin < 30 and len(rows) == 504
    for r in rows:
        if r["page_id"] < 9:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == slow_judge(f"https://{hosts[r['page_id']]}/es/{'d/' * 20_000}")


def test_precedence_of_like_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = [("allow", "a.b", "/"), ("block", "b", "/c"), ("allow", "b", "/c")]
    assert urls.judge(pages, rules).first()["rule"] == "a.b/"
    assert urls.judge(pages, rules[1:]).first()["verdict"] == "block"


def test_urls_equal_sql(spark, sf_dir):
    assert_same(queries.op5_url_rules(spark, sf_dir), connection(sf_dir), queries.ORACLES["op5_url_rules"])


def test_urls_run_without_python(spark, sf_dir):
    plan = queries.op5_url_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p>";</script></head><body class="page">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>One<br>two<p>Three <b>bold
 text</b></p><div class="ad">Buy</div><ul><li>First<li>Second</ul><form>Name</form><section id="comments"><p>Nice!</p></section><!-- no --></article>
<aside><p>Side</p></aside><footer>&copy; {}</footer>"""


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def make(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")


def test_articles(spark):
    want = "Head & line\nOne two\nThree bold text\nFirst\nSecond"
    rows = [(1, "http://a/1", PAGE.format(1)), (2, "http://a/2", PAGE.format(2)), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", "<nav>only</nav>"), (6, "http://a/6", PAGE.format(6)[:330])]
    found = texts(html_text.main_text(make(spark, rows)))
    assert found[1] == found[2] == want and found[3] == found[4] == found[5] == ""
    assert html_text.main_text(make(spark, rows).where(F.lit(False))).count() == 0


@pytest.mark.parametrize("broken", ["<p>a <b", "<", "<p class='x>a</p>", "a &am", "<article><p>x</article></article></p>", "<!-- open", "<script>var x", "<p>1 < 2</p>"])
def test_broken_markup_does_not_crash(broken):
    assert isinstance(html_text.blocks(broken), list)


def test_pages_without_article_keep_unique_runs(spark):
    shared = "<div>the same words stand at the top of all pages here</div>"
    rows = [(i, f"http://h.example/{i}", f"{shared}<div>only page number {i} says this and nothing else does so {'x' * i}</div>") for i in range(3)]
    rows.append((9, "http://other.example/", f"{shared}"))
    found = texts(html_text.main_text(make(spark, rows)))
    for i in range(3):
        assert "the same words" not in found[i] and f"only page number {i}" in found[i]
    assert found[9].startswith("the same words")


def test_copies_are_no_evidence(spark):
    page = "<div>a page of its own words that a copy repeats as it stands</div>"
    found = texts(html_text.main_text(make(spark, [(1, "http://h/1", page), (2, "http://h/2", page)])))
    assert found[1] == found[2] != ""


@pytest.mark.parametrize("kinds", [1, 3, 50])
def test_suffix_array_equals_sorting(kinds):
    stream = np.append(np.random.default_rng(2).integers(0, kinds, 300), kinds)
    order, common = html_text.suffix_array(stream)
    suffixes = [stream[i:].tolist() for i in order]
    assert suffixes == sorted(suffixes)
    for a, b, c in zip(suffixes, suffixes[1:], common[1:], strict=False):
        assert c == next(i for i in range(len(stream)) if i >= len(a) or i >= len(b) or a[i] != b[i])


def test_coverage_equals_brute_force():
    rng = np.random.default_rng(4)
    pages = [[f"t{x}" for x in rng.integers(0, 4, rng.integers(0, 60))] for _ in range(12)]
    pages[5][3:3] = pages[2][:20]
    k = html_text.LEAST_RUN
    owners = {}
    for p, page in enumerate(pages):
        for i in range(len(page) - k + 1):
            owners.setdefault(tuple(page[i : i + k]), set()).add(p)
    for page, cover in zip(pages, html_text.covered(pages, list(range(12))), strict=True):
        want = np.zeros(len(page), dtype=bool)
        for i in range(len(page) - k + 1):
            if len(owners[tuple(page[i : i + k])]) > 1:
                want[i : i + k] = True
        assert np.array_equal(cover, want)


def test_unmarked_pages_by_hand(spark):
    """No page marks an article: menus and notices that pages of a host share go, runs of any length that one page has stay."""
    menu = "<ul><li><a href='/'>Home</a><li><a href='/n'>News of the day</a><li><a>Sports and games</a><li>About</ul>"
    foot = "<p>All rights reserved by the owners of this site since 1999</p>"
    bodies = ["<h1>First</h1><p>Alpha beta gamma.<p>Short.", "<h1>Second</h1><p>Delta <b>epsilon</b> zeta eta theta iota kappa lambda mu.", "<p>Third page says: All rights reserved by nobody &amp; no one."]
    rows = [(i, f"http://h.example/{i}", f"<html><body><div>{menu}</div><div>{b}</div>{foot}</body></html>") for i, b in enumerate(bodies)]
    found = html_text.main_text(make(spark, rows))
    assert found.columns[:4] == ["page_id", "url", "text", "n_chars"]
    assert texts(found) == {
        0: "First\nAlpha beta gamma.\nShort.",
        1: "Second\nDelta epsilon zeta eta theta iota kappa lambda mu.",
        2: "Third page says: All rights reserved by nobody & no one.",
    }
    assert all(r["by_repeats"] and r["n_covered"] == 20 and r["n_chars"] == len(r["text"]) for r in found.collect())


def test_marked_pages_are_evidence_but_keep_their_articles(spark):
    passage = "<p>a passage of ten words that two of the articles share</p>"
    notice = "<p>this site will be closed for repairs on next sunday morning</p>"
    rows = [(i, f"http://h.example/{i}", f"{notice}<article>{passage}<p>{i}</p></article>") for i in range(2)]
    rows += [(2, "http://h.example/2", f"{notice}<p>news</p>")]
    found = texts(html_text.main_text(make(spark, rows)))
    assert found == {0: "a passage of ten words that two of the articles share\n0", 1: "a passage of ten words that two of the articles share\n1", 2: "news"}


@pytest.mark.parametrize("piece", ["<a ", "<b>", "</i>", "<b></i>", "<", "<p>", "<li>", "<table><b></i>", "<!--", "<a x=\"", "<a x='", "&#0", "&#9", "<i class=ad>", "<div class ", "</p "])
@pytest.mark.parametrize("end", ["", ">"])
def test_broken_markup_takes_linear_time(piece, end):
    n = 250_000 // len(piece)
    begin = time.process_time()
    html_text.blocks(piece * n + end)
    assert time.process_time() - begin < 5  # quadratic work would take minutes


def test_a_long_broken_page(spark):
    rows = [(1, "http://a/1", "<a " * 350_000), (2, "http://a/2", "<article>" + "word " * 300_000 + "&#" + "9" * 6000 + ";<b"), (3, "http://a/3", "&#x0000041;&#065;")]
    found = texts(html_text.main_text(make(spark, rows)))
    assert found[1].startswith("<a <a") and len(found[2].split(" ")) == 300_001 and found[3] == "AA"


def test_results_do_not_depend_on_shards(spark, monkeypatch):
    notice = "<div>this notice of eight or more words stands on some pages only</div>"
    rare = "<div>a passage which just two of all the pages of this host share</div>"
    rows = []
    for i in range(60):
        own = f"<div>page {i} says things of its own like {' '.join(f'w{i}x{j}' for j in range(9))}</div>"
        rows.append((i, f"http://big.example/{i}", (notice if i % 7 == 0 else "") + own + (rare if i in (3, 40) else "")))
    rows += [(100 + i, f"http://big.example/copy/{i}", "<div>copies of one page are no evidence against each other at all</div>") for i in range(20)]
    rows += [(200 + i, f"http://other.example/{i}", notice if i == 0 else f"<div>small {i}</div>") for i in range(3)]
    results = []
    for tokens in (1 << 19, 200, 1):
        monkeypatch.setattr(html_text, "SHARD_TOKENS", tokens)
        results.append(sorted(html_text.main_text(make(spark, rows)).collect()))
    assert results[0] == results[1] == results[2]
    found = {r["page_id"]: r["text"] for r in results[1]}
    assert "this notice" not in found[7] and "page 7 says" in found[7] and "a passage" not in found[3] + found[40]
    assert found[100].startswith("copies of one page") and found[200].startswith("this notice")


ARTICLE = "<article><h1>Head</h1><p>Body of the text.</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f'<div id="page" class="has-sidebar">{ARTICLE}</div>',
        f'<div class="layout no-header"><main>{ARTICLE[9:-10]}</main></div>',
        f"<form action='/post'>{ARTICLE}<input name=q></form>",
        f'<div class="sidebar-layout">{ARTICLE}</div>',
        '<article><h1>Head</h1><div class="search-result"><p>Body of the text.</p></div></article>',
        '<article><h1>Head</h1><section class="legal">Body of the text.</section></article>',
    ],
)
def test_articles_in_wrappers_survive(spark, page):
    assert texts(html_text.main_text(make(spark, [(1, "http://a/1", page)]))) == {1: "Head\nBody of the text."}


def test_boilerplate_stays_out_of_articles(spark):
    page = f"""<aside><article>Teaser</article></aside><div class="related"><article>Other story</article></div>{ARTICLE[:-10]}
<form><p>Subscribe</p></form><div class="ad-box">Buy</div><p class="with-sidebar">Stays.</p></article><section id="comments"><article class="comment">Nice!</article></section>"""
    assert texts(html_text.main_text(make(spark, [(1, "http://a/1", page)]))) == {1: "Head\nBody of the text.\nStays."}
    comments = '<div class="comments"><article>Nice!</article></div>'
    assert texts(html_text.main_text(make(spark, [(1, "http://a/1", comments)]))) == {1: ""}


def test_repeats_decide_what_names_only_suggest(spark):
    """Articles in wrappers and doubtful blocks in articles: what other pages of the host have too goes, the rest stays, in page order."""
    legal = '<div class="legal">no part of this text may be used without the written consent of us</div>'
    teaser = '<div class="promo"><article>read the most popular story of this week on our front page now</article></div>'
    rows = [(i, f"http://h.example/{i}", f'{teaser}<article><p>Start {i}.</p>{legal}<div class="legal">Case {i} was closed.</div><p>End.</p></article>') for i in range(3)]
    rows += [(10 + i, f"http://w.example/{i}", f'{teaser}<div class="sidebar-layout"><main><p>Page {i} stands in a wrapper of the site and keeps its words.</p></main></div>') for i in range(3)]
    found = html_text.main_text(make(spark, rows))
    assert texts(found) == {i: f"Start {i}.\nCase {i} was closed.\nEnd." for i in range(3)} | {10 + i: f"Page {i} stands in a wrapper of the site and keeps its words." for i in range(3)}
    assert all(r["by_repeats"] and r["n_covered"] > 0 for r in found.collect())


@pytest.mark.parametrize("tokens", [1 << 19, 1])
def test_every_page_meets_the_suffix_arrays(spark, monkeypatch, tokens):
    """Repeats outside articles are found on pages that mark theirs too; articles stay whole, and marks drop what is unique."""
    monkeypatch.setattr(html_text, "SHARD_TOKENS", tokens)
    menu, passage = "<nav>the menu of this host has nine words here</nav>", "<p>a passage of nine words that all articles share</p>"
    rows = [(i, f"http://h.example/{i}", f"{menu}<article><p>Text {i}.</p>{passage}</article><footer>{c} own words</footer>") for i, c in enumerate("abc")]
    rows += [(7, "http://h.example/7", rows[0][2]), (8, "http://alone.example/", rows[0][2])]
    found = {r["page_id"]: r for r in html_text.main_text(make(spark, rows)).collect()}
    for i, r in found.items():
        assert r["text"] == f"Text {i if i < 3 else 0}.\na passage of nine words that all articles share"
        assert (r["by_repeats"], r["n_covered"], r["n_named"]) == ((False, 0, 12) if i == 8 else (True, 9, 3))


@pytest.mark.parametrize("tokens", [1 << 19, 2000])
def test_repeats_of_the_table_equal_brute_force(spark, sf_dir, monkeypatch, tokens):
    monkeypatch.setattr(html_text, "SHARD_TOKENS", tokens)
    k, pages, owners = html_text.LEAST_RUN, {}, {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        outside = [w for p, t in html_text.blocks(r["html"] or "") if p != html_text.ARTICLE for w in t.split(" ")]
        pages[r["page_id"]] = [(slow_judge(r["url"])[0], *outside[i : i + k]) for i in range(len(outside) - k + 1)], len(outside)
        for window in pages[r["page_id"]][0]:
            owners.setdefault(window, set()).add(r["html"])
    want = {i: len({at + j for at, w in enumerate(windows) if len(owners[w]) > 1 for j in range(k)}) for i, (windows, _) in pages.items()}
    found = queries.op8_html_text(spark, sf_dir).collect()
    assert {r["page_id"]: r["n_covered"] for r in found} == want and sum(want.values()) > 0
    assert all(r["n_named"] == pages[r["page_id"]][1] - r["n_covered"] for r in found)  # all pages of the table mark their articles
