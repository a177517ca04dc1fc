"""Elements as intervals: any depth, markup that is only text, addresses, unclosed elements."""

import time

from markup import BASE, U, card, info, page
from pyspark.sql import functions as F

from pagelake.functions import html as h
from pagelake.functions.elements import Chain, ranks, tile
from pagelake.operators.cards import extract_details, listing_cards
from pagelake.plans.rules import DETAILS, LISTING_CARDS


def venues(spark, pages, *columns):
    """Per page its named cards: names, or tuples with further columns."""
    df = spark.createDataFrame([(n, BASE, p) for n, p in enumerate(pages)], "page_no int, url string, html string")
    out = [[] for _ in pages]
    for r in listing_cards(df, LISTING_CARDS).filter("name is not null").orderBy("page_no", "pos").collect():
        out[r["page_no"]].append(tuple(r[c] for c in ("name", *columns)) if columns else r["name"])
    return out


def fields(spark, pages):
    df = spark.createDataFrame([(n, U, p) for n, p in enumerate(pages)], "n int, url string, html string")
    return extract_details(df, DETAILS, keep=("n",)).orderBy("n").collect()


DEPTHS = (1, 23, 24, 25, 30, 300)


def test_cards_of_any_depth(spark):
    """What a card holds counts however deep it lies, and nothing behind the card does."""
    score = '<div class="card__menu-footer--score">{}</div>'
    one = '<div class="card__menu"><h3 class="title">A</h3>{}</div>' + score.format("Other")
    deep = [one.format("<div>" * n + score.format("Deep") + "</div>" * n) for n in DEPTHS]
    empty = [one.format("<div>" * n + "</div>" * n) for n in DEPTHS]
    assert venues(spark, deep + empty, "location") == [[("A", "Deep")]] * 6 + [[("A", None)]] * 6


def test_details_of_any_depth(spark):
    near = "<h2>Nearby Restaurants</h2>" + card("N", "n")
    outside = info("Out").replace("data-sheet__detail-info", "x")
    pages = []
    for n in DEPTHS:
        around = lambda inner: "<div>" * n + inner + "</div>" * n  # noqa: B023, E731
        pages.append(f'<div class="container">{around(near)}</div><div class="container">{card("Z", "z")}</div>')
        pages.append(around(info("In", "x · y")) + outside)
        pages.append(f'<div class="data-sheet__detail-info">{around("")}</div>{outside}')
    got = fields(spark, pages)
    assert [[v["name"] for v in r["nearby_restaurants"]] for r in got[::3]] == [["N"]] * 6
    assert [r["address"] for r in got[1::3]] == ["In"] * 6
    assert [r["address"] for r in got[2::3]] == [None] * 6


def test_markup_that_is_only_text(spark):
    ways = [
        "<textarea>{}</textarea>", "<title>{}</title>", "<iframe>{}</iframe>", "<TEXTAREA rows=3>{}</textarea >",
        "<noscript>{}</noscript>", "<!-- {} -->", "<p title='{}'>", "<div data-x='{}'></div>", "<xmp>{}</xmp>",
    ]
    ghost = '<div class="card__menu"><h3 class="title">Ghost</h3></div>'
    pages = [page(way.format(ghost), card("New", "n")) + way.format(ghost) for way in ways]
    title = '<h3 class="title">Ghost</h3>'
    pages += [page(card("New", "n").replace("<h3", way.format(title) + "<h3", 1)) for way in ways]
    assert [names[0] for names in venues(spark, pages)] == ["New"] * 18
    assert all(len(names) == 1 for names in venues(spark, pages)[:9])
    # Pattern rules see the elements the same way.
    rows = [(way.format('<div class="k">no</div>') + '<div class="k">yes</div>',) for way in ways]
    df = spark.createDataFrame(rows, "s string")
    texts = df.select(h.first_text(F.col("s"), h.element("div", h.has_class("k")))).collect()
    assert [r[0] for r in texts] == ["yes"] * 9


def test_base_address(spark):
    bases = [
        ('<base href="https://b.example/x/">', "https://b.example/x/", "https://b.example/x/s"),
        ("<head><BASE target=_top><base href='/y/'><base href='/z/'></head>", "https://g.example/y/", "https://u.example/y/s"),
        ('<base href="">', "https://g.example/", "https://u.example/s"),
        ('<!-- <base href="/no/"> -->', "https://g.example/", "https://u.example/s"),
    ]
    near = '<div class="card__menu"><h3 class="title">A</h3><a href="./restaurant/a">x</a><a href="/restaurant/b">y</a></div>'
    rooted = '<div class="card__menu"><h3 class="title">A</h3><a href="/restaurant/b">y</a></div>'
    got = venues(spark, [base + near for base, _, _ in bases], "url")
    assert got == [[("A", folder + "restaurant/a")] for _, folder, _ in bases]
    got = venues(spark, [base + rooted for base, _, _ in bases], "url")
    assert got == [[("A", "/".join(folder.split("/")[:3]) + "/restaurant/b")] for _, folder, _ in bases]
    sites = fields(spark, [base + '<a href="s">Visit Website</a>' for base, _, _ in bases])
    assert [r["website"] for r in sites] == [site for _, _, site in bases]


def test_unclosed_elements(spark):
    """Cards end where the next one begins, other elements at the first closing tag."""
    html = '<div class="card__menu"><h3 class="title">A</h3><div class="card__menu"><h3 class="title">B</h3>'
    assert venues(spark, [html]) == [["A", "B"]]
    df = spark.createDataFrame([("<div class=k><div>x</div> y",)], "s string")
    k = h.has_class("k")
    first = lambda rule, group=1: df.select(h.first_match(F.col("s"), rule, group)).first()[0]
    assert first(h.element("div", k)) == "<div>x"
    assert first(h.region("div", k)) == "<div>x</div> y"
    assert first(h.region("div", k), 0) == "<div class=k><div>x</div> y"
    assert first(h.element("div"), 0) == "<div class=k><div>x</div>"
    assert first(h.element("section")) is None


def test_outermost_and_nested(spark):
    df = spark.createDataFrame([("<ul>a<ul>b</ul></ul><ul></ul>c<UL\n>d</Ul >",)], "s string")
    found = lambda rule, group: df.select(h.all_matches(F.col("s"), rule, group)).first()[0]
    assert found(h.element("ul"), 1) == ["a<ul>b</ul>", "", "d"]
    assert found(h.element("ul"), 0) == ["<ul>a<ul>b</ul></ul>", "<ul></ul>", "<UL\n>d</Ul >"]
    assert df.select(h.split_cards(F.col("s"), h.block("ul"))).first()[0][1] == "<ul>b</ul>"


def test_pieces_are_the_page(spark):
    """The pieces, one behind the other, are the page, broken or not."""
    pages = [
        "", "x", "<", "<a", "<div", "<div class='a <p>x", "a<div>b</div>c<!-- <div> --><div/>d",
        "<script>if (a<div) {}</script><div>", "<!-- <div>", "</div></div><div>", "<abbr><a>x</a>", "<div <div>y</div>",
    ]
    df = spark.createDataFrame([(p,) for p in pages], "s string")
    pieces = F.regexp_extract_all("s", F.lit(tile(["div", "a"])), F.lit(0))
    assert [r[0] for r in df.select(F.array_join(pieces, "")).collect()] == pages


def test_ranks(spark):
    chain = Chain()
    points = chain.let("array(1L, 5L, 5L, 9L)")
    places = chain.let("array(9L, 0L, 6L, 5L, 10L, 1L)")
    sql = chain.sql(ranks(points, places, in_order=False))
    assert spark.sql(f"select {sql} r").first()["r"] == [3, 0, 3, 1, 4, 0]
    rising = "array(0L, 1L, 5L, 6L, 9L, 10L)"
    assert spark.sql(f"select {ranks('array(1L, 5L, 5L, 9L)', rising)} r").first()["r"] == [0, 0, 1, 3, 3, 4]


def test_large_pages_take_linear_time(spark):
    """Twice the cards, nested or side by side, take hardly more than twice the time."""

    def seconds(html):
        pages = spark.createDataFrame([(1, BASE, html)] * 4, "page_no int, url string, html string").coalesce(1)
        best = float("inf")
        for _ in range(3):
            started = time.perf_counter()
            assert listing_cards(pages, LISTING_CARDS).count() == 4 * html.count("card__menu ")
            best = min(best, time.perf_counter() - started)
        return best

    one = '<div class="card__menu "><h3 class="title">A</h3><div>x</div>{}</div>'
    flat = lambda n: one.format("") * n
    deep = lambda n: one.split("{}")[0] * n + "</div>" * n
    for build in (flat, deep):
        assert seconds(build(8_000)) < 4 * seconds(build(4_000)) + 1
