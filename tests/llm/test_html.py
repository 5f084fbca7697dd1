import html as entities
import math
import random
import re
import time
from collections import Counter

import pytest

from tarn.llm import html as H
from tarn.llm import queries

SITE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class='has-sidebar'>"
    "<header><h2>Site</h2></header><nav><ul><li><a href='/a'>Home</a></li></ul></nav>{body}"
    "<div class='cookie-notice'>We use cookies</div><form><label>mail</label><input></form>"
    "<footer>&copy; host</footer><script>var t='</p>';</script></body></html>"
)


def text_of(source):
    """What a host of this one page gives: only what the page declares to be furniture goes."""
    page = H.parse(source)
    return H.main_text(page, page.furniture())


@pytest.mark.parametrize(
    ("body", "wanted"),
    [
        ("<article><h1>A  &amp;\n b</h1><p>x <b>y</b>z<br>w</p></article>", "A & b\nx yz w"),
        ("<article><p><b>one.<br><p>two <i>three</i></article>", "one.\ntwo three"),
        ("<main><p>x</p><aside>no</aside><section class='comments'><p>reader</p></section></main>", "x"),
        ("<article><header><h1>T</h1></header><p>a</p><!-- <p>no</p> --><script>no()</script></article>", "T\na"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
        ("<div class='post'><p>free</p></div><div class='sideBar'>no</div>", "free"),
        ("<article><p>1 < 2 and <unknown>x</unknown></p><p hidden>no</p></article>", "1 < 2 and x"),
        ("<div class='layout with-sidebar'><article><p>in</p></article></div>", "in"),
        ("<div id='nav-wrap' class='nav'><article><p>kept</p><div class='related'>no</div></article></div>", "kept"),
        ("<div class='comments'><article><p>reader</p></article></div><article><p>text</p></article>", "text"),
        ("<div id='header'><p>Site</p></div><div class='story'><p>free</p></div><ol class='commentlist'><li>no</ol>", "free"),
        ("<article><div class='article-header'><h1>T</h1></div><aside><article>no</article></aside><p>b</p></article>", "T\nb"),
        ("<form action='/'><div><article><p>page</p><form><input>no</form></article></div></form>", "page"),
        ("<article></article>", ""),
    ],
)
def test_main_text(body, wanted):
    assert text_of(SITE.replace("{body}", body)) == wanted


@pytest.mark.parametrize("source", ["", "plain &lt;text", "<", "<p", "<!-- open", "<article><p>x", "</p></p>", "<script>"])
def test_broken_sources_do_not_fail(source):
    assert isinstance(text_of(source), str)


@pytest.mark.parametrize(
    "source",
    [
        "<div>" * 100_000 + "deep",
        "<b>" * 100_000 + "deep" + "</i>" * 100_000 + "</b>" * 100_000,
        "<div><article>" + "<section>" * 50_000 + "deep" + "</div>" * 50_000,
        "deep" + "<a" * 500_000,
        "deep" + "<a x=\"" * 150_000,
        "deep" + "<a x='\" " * 150_000 + ">",
        "deep" + "<p>" * 200_000 + "</p></li></td>" * 50_000,
        "deep" + "<!--" * 250_000,
        "deep" + "<li><table>" * 50_000 + "</ul>" * 50_000,
        "deep" + "&" * 500_000 + "<" * 200_000,
        "deep<i " + "= " * 300_000 + ">",
    ],
    ids=range(11),
)
def test_odd_pages_take_no_longer_than_their_size(source):
    began = time.perf_counter()
    page = H.parse(source)
    H.branch_features(page)
    assert "deep" in H.main_text(page, set())
    assert time.perf_counter() - began < 10


def pages():
    rng = random.Random(6)
    rows = []
    story = lambda n: "".join(f"<p>story {rng.random()} {rng.random()}</p>" for _ in range(n))
    for k in range(40):
        rows.append((k, "http://Big.example.com/x", f"<body><div class='top'><p>Same words</p></div><div class='txt'>{story(rng.randrange(1, 6))}</div></body>", k))
    rows += [(100, "http://big.example.com/y", rows[0][2], 0), (100, "http://big.example.com/y", rows[0][2], 0)]
    rows += [(101, None, "<p>no host</p>", 1), (None, "http://one.example.org", None, 2), (102, "nonsense", "", None)]
    for k in range(30):  # a notice that stands inside every article, under no name that tells
        body = f"<article><h1>Title {k}</h1><div class='x7'>Read on in the app</div>{story(2)}</article><div class='q'>{story(1)}</div>"
        rows.append((200 + k, "https://paper.example.com/a", f"<body><nav>n{k}</nav>{body}<p>Same words</p></body>", 0))
    for k in range(40):  # copies of one article are no template
        rows.append((300 + k, "https://copies.example.com/a", f"<body><nav>n{k}</nav><article><h1>One</h1><p>story of a copy that is long enough</p></article></body>", 0))
    return rows


def brute_noisy(rows, threshold=0.4, trust=8.0, layouts=64, declared=True):
    """The noisy branches by counting over whole lists."""
    seen = {}
    for _, url, source, _ in rows:
        page = H.parse(source or "")
        for key, features in H.branch_features(page).items():
            held = seen.setdefault((H.site_of(url, page), key), {}).setdefault(H.copy_name(page), features)
            seen[H.site_of(url, page), key][H.copy_name(page)] = tuple(map(min, held, features))
    noisy = {}
    for (site, key), copies in seen.items():
        m, values = len(copies), []
        for f in range(4):
            counts = Counter(x[f] for x in copies.values()).values()
            entropy = -sum(n / m * math.log(n / m) for n in counts)
            share = min(1.0, entropy / math.log(min(m, layouts) if f < 3 else m)) if m > 1 else 1.0
            values.append((trust + m * share) / (trust + m))
        layout = max(values[:3])
        if declared:
            layout = 0.0 if any(x[4] for x in copies.values()) else 1.0 if site.endswith(" marked") else layout
        if values[3] * layout < threshold:
            noisy.setdefault(site, set()).add(key)
    return noisy


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_style_tree_equals_brute_force(spark, limit):
    rows = pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    noisy, expected, untouched = brute_noisy(rows), [], 0
    for number, url, source, _ in rows:
        page = H.parse(source or "")
        text = H.main_text(page, noisy.get(H.site_of(url, page), set()))
        untouched += text == H.main_text(page, page.furniture())
        expected.append((str(number), str(url), text, len(text)))
    found = H.extract_main_text(frame, broadcast_bytes=limit).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in found) == sorted(expected)
    assert untouched == len(rows) - 72  # of 42 pages and 30 articles the tree takes what no name gives away


def test_style_tree_removes_what_a_host_repeats(spark):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string, text int")
    for r in H.extract_main_text(frame).collect():
        source = next(p[2] for p in pages() if p[0] == r.page_id and p[1] == r.url)
        assert "Same words" not in r.text and "in the app" not in r.text
        if source:
            inside = source.partition("<article>")[2].partition("</article>")[0] or source
            assert r.text.count("story") == inside.count("story")
            assert "<h1>" not in source or r.text.startswith(("Title", "One"))


def article_lines(source):
    """The article's text as its markup gives it, by patterns that fit the generated pages alone."""
    inside = re.sub(r"<(script|style)>.*?</\1>", "", source.partition("<article>")[2].partition("</article>")[0])
    parts = re.split(r"</?(?:p|h1)>", inside.replace("<br>", " "))
    lines = (" ".join(entities.unescape(re.sub(r"</?[a-z][^>]*>", "", x)).split()) for x in parts)
    return "\n".join(filter(None, lines))


def test_entropy_alone_finds_the_articles_of_large_hosts(spark):
    """Without names and marks the tree tells menus, adverts and footers, whose words differ on every page, from articles."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    hosts = Counter(H.host_of(r.url) for r in source.values())
    found = H.extract_main_text(pages, declared=False).collect()
    right = [r.text == article_lines(source[r.page_id].html) for r in found if hosts[H.host_of(r.url)] >= 60]
    assert len(right) > 700 and sum(right) / len(right) > 0.95


def test_query_equals_brute_force(spark):
    """The registered query on the smallest table: by the tree, and as the article's own text."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html, 0) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    found = {r.page_id: r.text for r in queries.op5_html_extraction(spark, sf).collect()}
    noisy, lost = brute_noisy(rows), 0
    for number, url, source, _ in rows:
        page = H.parse(source)
        assert found[number] == H.main_text(page, noisy.get(H.site_of(url, page), set()))
        assert found[number] == article_lines(source)
        lost += H.main_text(page, set()) != found[number]
    assert lost == len(rows)  # without the tree every page keeps what is not its article


def test_empty(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.extract_main_text(frame).count() == 0
