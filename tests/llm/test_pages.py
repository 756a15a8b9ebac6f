"""HTML extraction and URL filters."""

import itertools
import random

from framelake.llm import html_text, url_filter
from framelake.llm.url_filter import UrlRule

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t = "<p>no</p>";</script></head><body class="has-sidebar">
<header class="site-header"><div>My Site</div><nav><ul><li><a href="/">Home</a></li></ul></nav></header><div id="cookie-consent">We use cookies to improve your visit to this site, accept?</div>
<main><h1>Big news</h1><p>First paragraph of the article, long enough to be text &amp; with <a href=x>a link</a> in it.<p>Second&nbsp;one
 goes   on.</p><ul><li>point one</li><li>point two</li></ul><aside>Related: other story</aside><blockquote>Quoted words.</blockquote>
<section class="comments"><h2>Comments</h2><p>Great article, I really enjoyed reading this one so much, thank you!</p></section></main>
<form><label>Email</label><input name=a><button>Send</button></form><div class="ad">Buy it now and save a lot of money today only.</div><footer>&copy; 2024 Site</footer></body></html>"""


def test_main_text():
    want = "Big news\nFirst paragraph of the article, long enough to be text & with a link in it.\nSecond one goes on.\npoint one\npoint two\nQuoted words."
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text("") == "" and html_text.main_text("<p>Short.</p>") == "Short."
    assert html_text.main_text("<p>a &lt;b&gt; c < d</p>") == "a <b> c < d"


def test_cut_is_minimal():
    """Against all labellings."""
    r = random.Random(6)
    for _ in range(300):
        n = r.randint(1, 7)
        scores = [r.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, r.randint(0, 6)) for i, j in itertools.combinations(range(n), 2) if r.random() < 0.5]

        def cost(label, scores=scores, edges=edges):
            return sum(s if not x else 0 for s, x in zip(scores, label, strict=True) if s > 0) + sum(-s if x else 0 for s, x in zip(scores, label, strict=True) if s < 0) + sum(w for a, b, w in edges if label[a] != label[b])

        assert cost(html_text.minimum_cut(scores, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_broken_and_large_pages():
    for page in ("<div>" * 5000 + "deep words", "<a '" * 3000, "<p>x" * 3000, "<!-- open", "<script>never closed", "&#xD800; &bogus; &#0;", "<p>para of text</p><div class=ad>x</div>" * 3000):
        assert isinstance(html_text.main_text(page), str)


def test_extract_rows(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y")], "page_id long, url string, html string, text string")
    got = html_text.extract(rows).collect()
    assert len(got) == 4 and [x.text for x in got if x.page_id == 2] == [""] and got[0].text == html_text.main_text(PAGE)
    assert html_text.extract(rows.limit(0)).collect() == []


def brute_judge(url, rules):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(len(r.name), r.verdict == "block", r.name, r.verdict) for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, *(max(fit)[2:] if fit else (None, "allow"))


def test_urls_match_brute_force(spark):
    r = random.Random(8)
    rules = (*url_filter.RULES, UrlRule("block", "a.net", "/x"), UrlRule("allow", "b.a.net", "/x/y"), UrlRule("block", "org", "/fr/z/"))
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/1", "http://net/", "http://xnet/", "http://a.net", "x://y://a.net/x", "http://a.net?x=/x", "http://a.net/x\n/y"]
    urls += [f"http://{'.'.join(r.choices(['a', 'b', 'example', 'A'], k=r.randint(0, 2)) + [r.choice(['net', 'org', 'com'])])}{r.choice(['', '/', '/en/', '/fr/z/1', '/fr/', '/x', '/xy', '/x/y', '/x/yz', '/de/', '//x'])}{r.choice(['', '?q=/', '#top'])}" for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge(rows, rules).collect()}
    assert got == {i: brute_judge(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge(rows.limit(0)).collect() == []
