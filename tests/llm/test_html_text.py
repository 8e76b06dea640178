"""HTML extraction on pages with known texts, and template counts against brute force."""

from collections import Counter, defaultdict
from html import escape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lathe.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- ad > --><div class="ad">Buy</div>
<div id='cookie-notice'>Cookies!</div><article class="post"><header><h1>Title &copy; 1</h1></header><p><b>One  two<br>three
<p>Four <i>fi</i>ve &lt;six&gt; &#233;&nbsp;x</p><ul><li>a<li>b</ul><script>no()</script><div class="comments"><p>First!</p></div>
text <!-- gone --> here<form>q</form><table><tr><td>c<td>d<tr><td>e</table></article><aside>more</aside><footer>&copy; host</footer></body></html>"""
TEXT = "Title © 1\nOne two three\nFour five <six> é x\na\nb\ntext here\nc d\ne"


def test_main_text():
    assert ht.main_text(PAGE) == TEXT
    assert ht.main_text("<p>a<p>b") == "a\nb"
    assert ht.main_text("plain & simple < text") == "plain & simple < text"
    assert ht.main_text("<main><h1>H</h1><div>x</div></main>out") == "H\nx"
    assert ht.main_text("<article>") == "" and ht.main_text("") == "" and ht.main_text("<script>x") == "" and ht.main_text("a<!-- b") == "a"
    assert ht.main_text("</div></p>x<br/>y<img src='a>b'>z") == "x yz"
    assert ht.main_text("<div>" * 20_000 + "deep") == "deep"
    assert ht.main_text("<article><div class='x'>" + "long " * 50_000 + "</div></article>") == ("long " * 50_000).strip()


KEPT = ["post type-post comments-open", "post comments-closed", "layout no-sidebar", "content-wrap has-sidebar", "with-sidebar", "hentry has-ads", "without-ads entry", "sidebar-off",
        "page is-menu", "no-comments", "site-content nav-open", "wrap layout-sidebar-right", "comments-disabled single", "article-body share-enabled", "menu-hidden content", "not-sponsored"]
GONE = ["comments", "comment-list", "site-footer", "main-nav", "cookie-banner", "share-buttons", "related-posts", "widget sidebar-widget", "ad", "ad-slot top", "newsletter-signup", "post-comments"]


@pytest.mark.parametrize("name", KEPT)
def test_names_that_state_a_condition(name):
    for html in (f'<article class="{name}"><p>Own text</p></article>', f'<div class="{name}"><p>Own text</p></div>', f'<div class="{name}"><article><p>Own text</p></article></div>',
                 f'<body id="x"><main role="main"><section class="{name}"><h2 id="related">Own</h2><p>text</p></section></main></body>'):
        assert ht.main_text(html).replace("\n", " ") == "Own text"


@pytest.mark.parametrize("name", GONE)
def test_names_of_something_else(name):
    """Gone beside the article and within it, even if it holds articles of readers."""
    other = f'<div class="{name}"><article><p>Not this</p></article></div>'
    long = "<p>" + "Own text " * 9 + "</p>"
    assert ht.main_text(f"<body><article>{long}{other}</article>{other}</body>") == ("Own text " * 9).strip()
    assert ht.main_text(f"<body>{long}{other.replace('article', 'div')}</body>") == ("Own text " * 9).strip()


def test_holders_are_never_asides():
    """What holds the first article stays whatever it is called; a second one in an aside goes."""
    assert ht.main_text('<div class="sidebar"><article class="widget"><p>Own</p></article></div><div class="comments"><article>No</article></div>') == "Own"
    assert ht.main_text('<div class="post-sidebar-wrap"><p>' + "Most of the page. " * 5 + "</p></div><p>rest</p>").startswith("Most of")
    assert ht.main_text('<aside><article>No</article></aside><div class="related"><main><h1 class="alert">Own</h1></main></div>') == "Own"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-ap b\"'=&;p", max_size=60))
def test_never_raises(html):
    ht.main_text(html)
    ht.subtrees(html)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_paragraphs_come_back(blocks):
    html = "<nav>m</nav><article>" + "".join(f"<p>{escape(b)}</p>" for b in blocks) + "</article>"
    assert ht.main_text(html) == "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def site(n):
    """Pages without an article element: only repetition tells the template."""
    out = []
    for i in range(n):
        body = f"<div><p>About us</p><p>Call now</p></div><div><h1>Title {i}</h1><p>Own text {i}</p><p>Often said</p></div><div>Imprint</div>"
        out.append((i, "http://a.org/x", f"<html><body>{body}</body></html>"))
    return out


def test_template_of_a_host(spark):
    rows = site(30) + [(100 + i, "http://b.org/x", h) for i, (_, _, h) in enumerate(site(5))]
    rows += [(200 + i, u, h) for i, (_, u, h) in enumerate([(0, None, site(1)[0][2]), (0, "nohost", site(1)[0][2]), (0, "http://a.org", None), (0, "http://a.org", "")])]
    rows += [(5, *site(30)[5][1:]), (None, None, None)]
    rows += [(300 + i, "http://c.org", f"<article><p>Same line</p><p>own {i}</p><div><p>Subscribe</p></div></article>") for i in range(20)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, text int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in ht.extract(df).collect()), key=str)
    pages, hosts = defaultdict(Counter), Counter()
    for p, u, h in {r for r in rows if r[1] and "://" in r[1] and r[2]}:
        host = u.split("://")[1].split("/")[0]
        hosts[host] += 1
        pages[host].update(ht.subtrees(h))
    want = []
    for p, u, h in rows:
        host = u.split("://")[1].split("/")[0] if u and "://" in u else ""
        template = {k for k, n in pages[host].items() if n >= ht.MIN_PAGES and n >= ht.SHARE * hosts[host]}
        text = ht.main_text(h or "", template)
        want.append((p, u, text, len(text)))
    assert got == sorted(want, key=str)
    texts = {r[0]: r[2] for r in got}
    assert texts[3] == "Title 3\nOwn text 3" and "Imprint" in texts[101] and "Imprint" in texts[201]
    assert texts[305] == "Same line\nown 5"
    assert ht.extract(df.limit(0)).collect() == []


def test_unmarked_boilerplate_of_a_part_of_a_host(spark):
    rows, own = [], {}
    for i in range(200):
        extra = "<div><p>Words of the travel desk</p><p>Call the desk</p></div>" if i % 10 == 0 else ""
        extra += f"<div>Rotation {i % 5 // 2}</div>" if i % 5 < 4 else ""
        own[i] = [f"Title {i}", f"Own text {i}", *["A common saying"] * (i % 4 == 0)]
        words = "".join(f"<p>{x}</p>" for x in own[i])
        words, own[i] = (f"<article>{words}<p>{'tail ' * 30}{i}</p>{extra}</article>", [*own[i], "tail " * 30 + str(i)]) if i % 2 else (f"<div>{words}</div>{extra}", own[i])
        rows.append((i, "http://a.org/x", f"<html><body>{words}</body></html>"))
    # copies of one page are no boilerplate
    rows += [(1000 + i, "http://a.org/y", "<body><div>Copied title</div><div>Copied text</div></body>") for i in range(40)]
    got = {r.page_id: r.text for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in own} == {i: "\n".join(x) for i, x in own.items()}
    assert got[1000] == "Copied title\nCopied text"
