"""Main text of pages: golden pages, templates by recurrence, and the given table."""

import html
import re
from collections import Counter
from urllib.parse import urlsplit

import pytest

from pagelake.llm.common import table
from pagelake.llm.htmltext import main_text, read_page

GOLDEN = [
    ("", []),
    ("plain &amp; text", ["plain & text"]),
    ("<p>a  b\n c<p>d<br>e", ["a b c", "d e"]),
    ("<body class='menu-open'><header>Top</header><nav>n</nav><h1>T &lt;x&gt;</h1><p>one</p><footer>f</footer>", ["T <x>", "one"]),
    ("<main><article><header><h1>T</h1></header><p>x<aside>s</aside></article><article class=comment>bad</article></main>out", ["T", "x"]),
    ("<article>a<div class='cookie-notice'>c</div><form>q</form><ul><li>1<li>2</ul><section id=comments><p>r</section></article>", ["a", "1", "2"]),
    ("<div class=ad>x</div><div role=navigation>n</div><div hidden>h</div><div style='display: none'>s</div><p>kept", ["kept"]),
    ("<script>var t='</p><p>no'</script><style>p{}</style><!-- <p>no</p> --><noscript>n</noscript>yes", ["yes"]),
    ("<p title='a > b'>x</p><p title=\"it's\">y", ["x", "y"]),
    ("a < b > c &lt;b&gt; <3", ["a < b > c <b> <3"]),
    ("<table><tr><td>1<td>2</table><pre>x  y</pre>&eacute;&#233;&nbsp;&copy;", ["1", "2", "x y", "éé ©"]),
    ("<p>a<![CDATA[<b>]]></p></div></span>z", ["a<b>", "z"]),
    ("<script>never closed <p>x", []),
    ("<svg><text>x</text></svg><SCRIPT>a</Script>y", ["y"]),
]


@pytest.mark.parametrize("source,blocks", GOLDEN)
def test_golden(source, blocks):
    assert read_page(source)[0] == blocks


def test_linear_on_broken_pages():
    import time

    begun = time.time()
    for source in ("<div>" * 20_000 + "x", '<a href="' * 20_000, "<" * 100_000, "<!--" * 50_000, "<p " * 50_000,
                   "<b>" * 20_000 + "<p></p>" * 20_000, "<div>" * 20_000 + "<p>x</p>" * 20_000,
                   "<svg>" * 20_000 + ">", "<b>" * 20_000 + "</i>" * 20_000, "</p>" * 50_000):
        read_page(source)
    assert time.time() - begun < 20


def test_templates(llm):
    """Containers recurring on a host go, elsewhere they stay; prose in articles stays."""
    rows = []
    for n in range(10):
        box = "<div class=box><p>Follow us</p><p>Every day</p></div>"
        rows.append((n, f"http://a.example/{n}", f"<p>story {n}</p>{box}<p>end {n}</p>"))
        rows.append((20 + n, f"http://b.example/{n}", f"<article><p>story {n}</p>{box}<p>often quoted</p></article>"))
    rows.append((40, "http://c.example/1", "<p>story</p><div class=box><p>Follow us</p><p>Every day</p></div>"))
    rows += [(50 + n, f"http://d.example/{n}", "<div><p>one text</p></div>") for n in range(9)]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    assert all(got[n] == f"story {n}\nend {n}" for n in range(10))
    assert all(got[20 + n] == f"story {n}\noften quoted" for n in range(10))
    assert got[40] == "story\nFollow us\nEvery day"
    assert all(got[50 + n] == "one text" for n in range(9))


@pytest.mark.parametrize("source,blocks", [
    ("<div class='layout has-sidebar'><article>story</article></div>", ["story"]),
    ("<div id=page class=no-sidebar><p>story</p></div>", ["story"]),
    ("<div class='sticky-header site'><article>story</article></div>", ["story"]),
    ("<div class=post-social>a</div><section class=search-history><article>story</article></section>", ["a", "story"]),
    ("<div class=sidebar><div class=menu>m</div><article>story</article></div>", ["story"]),
    ("<div class=widget><p>a long story</p><div class=menu>m</div></div><p>end", ["a long story", "end"]),
    ("<form><div class=search>s</div><article>story</article></form>", ["story"]),
    ("<main><h1>Headline</h1><p>lead</p><article>story</article></main>out", ["Headline", "lead", "story"]),
    ("<div class=content>whole story</div><article>one teaser</article>", ["whole story", "one teaser"]),
    ("<div hidden><article>no</article></div><nav><p>a long menu of links</nav><div class=sidebar>side</div><p>a story", ["a story"]),
])
def test_names_decide_little(source, blocks):
    assert read_page(source)[0] == blocks


@pytest.mark.parametrize("begin,end", [
    ("<a id=top>", "</a>"), ("<span class=x>", "</span>"), ("<story-body>", "</story-body>"), ("<b><font>", "</font></b>"),
])
def test_different_text_below_inline_elements(llm, begin, end):
    """A wrapper that is no block hides nothing of what is in it from the hash."""
    page = "<article><div class=body>{0}<p>story {1}</p>more {1}{2}</div><div class=box>{0}<p>Follow us</p>{2}</div></article>"
    rows = [(n, f"http://a.example/{n}", page.format(begin, n, end)) for n in range(10)]
    rows += [(20 + n, f"http://b.example/{n}", f"<div>{begin}story {n}<button><div>x</div></button>{end}</div>") for n in range(10)]
    got = {r["page_id"]: r["text"] for r in main_text(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"story {n}\nmore {n}" for n in range(10)} | {20 + n: f"story {n}" for n in range(10)}


def test_template_on_a_small_share_of_a_large_host(llm):
    box = "<div class=box><p>Follow us</p></div>"
    rows = [(n, f"http://a.example/{n}", f"<p>story {n}</p>{box if n % 100 == 0 else ''}") for n in range(4000)]
    rows += [(5000 + n, f"http://b.example/{n}", f"<p>story {n}</p>{box if n < 10 else ''}") for n in range(1000)]
    got = {r["page_id"]: r["text"] for r in main_text(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[n] == f"story {n}" for n in range(4000))
    assert all(got[5000 + n] == f"story {n}\nFollow us" for n in range(10))


def test_templates_by_shape(llm):
    """Beside an article containers whose words change go by their shape, unless they hold the story or its title."""
    rows = []
    for n in range(10):
        menu = "".join(f"<li><a href=/{n}/{i}>entry {n} {i}</a>" for i in range(2 + n % 3))
        rows.append((n, f"http://a.example/{n}", f"<ul class=x7>{menu}</ul><div class=x8><h1>title {n}</h1></div>"
                     f"<div class=x9><a>word {n}</a></div><article><p>story {n}</p><ul class=x7><li>point {n}</ul></article>"))
        rows.append((20 + n, f"http://b.example/{n}", f"<div class=x1><p>a long story {n}</p></div><article>teaser</article>"))
        rows.append((40 + n, f"http://c.example/{n}", f"<ul class=x7>{menu}</ul><p>no article {n}"))
        rows.append((60 + n, f"http://d{n}.example/", f"<ul class=x7>{menu}</ul><article>alone {n}</article>"))
    pages = llm.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    for n in range(10):
        entries = "\n".join(f"entry {n} {i}" for i in range(2 + n % 3))
        assert got[n] == f"title {n}\nstory {n}\npoint {n}"
        assert got[20 + n] == f"a long story {n}\nteaser"
        assert got[40 + n] == f"{entries}\nno article {n}"
        assert got[60 + n] == f"{entries}\nalone {n}"


@pytest.mark.parametrize("names", [True, False])
def test_counts_against_plain_python(llm, names):
    """Templates counted by Spark are those counted page by page."""
    pages = table(llm, "/root/testdata/sf0.01", "pages")
    rows = [(r["page_id"], urlsplit(r["url"]).hostname, read_page(r["html"], names)) for r in pages.collect()]
    once = {(host, tuple(page.blocks)): page for _, host, page in rows}
    sizes = Counter(host for host, _ in once)
    seen, held, whole = Counter(), Counter(), Counter()
    for (host, blocks), page in once.items():
        seen.update((host, h) for h in {e[0] for e in page.elements})
        for shape, size in page.shapes.items():
            seen[host, shape] += 1
            held[host, shape] += size
            whole[host, shape] += sum(map(len, blocks))
    templates = {key for key, n in seen.items()
                 if n >= 5 and (n >= 24 or n >= 0.05 * sizes[key[0]]) and 2 * held[key] <= whole[key]}
    want = {}
    for name, host, page in rows:
        cut = {i for h, s, lo, hi in page.elements if {(host, h), (host, s)} & templates for i in range(lo, hi)}
        want[name] = "\n".join(b for i, b in enumerate(page.blocks) if i not in cut)
    assert {r["page_id"]: r["text"] for r in main_text(pages, names=names).collect()} == want
    if not names:  # on every host with pages enough something was found
        assert {host for host, n in sizes.items() if n >= 5} <= {host for host, _ in templates}


def test_templates_do_without_names(llm):
    """On the given pages subtrees alone find what the names find."""
    pages = table(llm, "/root/testdata/sf0.1", "pages")
    by_names = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    alone = {r["page_id"]: r["text"] for r in main_text(pages, names=False).collect()}
    assert sum(alone[n] == by_names[n] for n in by_names) >= 0.95 * len(by_names)


def test_odd_rows(llm):
    rows = [(1, None, None), (1, None, None), (2, "", ""), (None, "no url", "<p>x</p>"), (3, "http://h/", "w " * 200_000)]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'x' as text", "1 as host", "2 as row", "3 as blocks")
    got = sorted((tuple(r) for r in main_text(pages).collect()), key=str)
    long = " ".join(["w"] * 200_000)
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (2, "", "", 0), (None, "no url", "x", 1), (3, "http://h/", long, len(long))], key=str)
    assert main_text(pages.limit(0)).collect() == []


def test_given_pages(llm, sf):
    got = {r["page_id"]: r for r in main_text(table(llm, sf, "pages")).collect()}
    for r in table(llm, sf, "pages").collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|</?h1>|<br>", article)]
        text = "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text)
        assert got[r["page_id"]]["url"] == r["url"]
