"""Expressions: text, rules, values, nested forms."""

import json

import pytest
from markup import B, S
from pyspark.sql import functions as F

from pagelake.functions import html as h
from pagelake.functions import nested, text, values


def one(spark, value, expr, kind="string"):
    df = spark.createDataFrame([(value,)], f"s {kind}")
    return df.select(expr(F.col("s")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, None),
        ("", ""),
        ("a & b", "a & b"),
        ("&lt;&amp;&gt;", "<&>"),
        ("&amp;lt;", "&lt;"),
        ("&#38;lt;", "&lt;"),
        ("caf&eacute; &#3647;&#x1F37D;", "café ฿\U0001f37d"),
        ("&nope; &amp; &", "&nope; & &"),
        ("&#xD800;|&#0;", "�|�"),
        ("&#39;&apos;&quot;", "''\""),
        ("&#0000000038;&#x00000026;&#99999999;", "&&�"),
        ("&#146;s &colon; &copy 2024 &NotEqualTilde;", "’s : © 2024 ≂̸"),
        ("&copyright &notit; &Tab;x &#38 &amp&lt", "©right ¬it; \tx & &<"),
        ("&#99999999999999999999999999; &#x00FFFFFFFFFFFFFFFFF; &#129;", "� � \x81"),
    ],
)
def test_decode_entities(spark, raw, want):
    assert one(spark, raw, text.decode_entities) == want


def test_references_in_links(spark):
    """In an attribute an old name without a semicolon is mostly part of a query."""
    in_link = lambda c: text.decode_entities(c, attribute=True)
    assert one(spark, "/a?x=1&copy=2&amp;lt=3&regx&sect", in_link) == "/a?x=1&copy=2&lt=3&regx§"


@pytest.mark.parametrize(
    "raw, visible, content",
    [
        (None, None, None),
        ("", "", ""),
        (" a\n  b ", "a b", "a\n  b"),
        ("  x　", "x", "x"),
        ("<p>a <b> b</b>c<br/> x</p><p>y</p>", "a bc\nx\ny", "a  bc xy"),
        ("a<!-- <p>no</p> -->b", "ab", "ab"),
        ("a<script>var t='</p>'</script>b", "ab", "avar t=''b"),
        ("฿฿\n   ·&nbsp;Thai", "฿฿ · Thai", "฿฿\n   ·\xa0Thai"),
        ("1 < 2", "1 < 2", "1 < 2"),
    ],
)
def test_text(spark, raw, visible, content):
    assert one(spark, raw, text.visible_text) == visible
    assert one(spark, raw, text.text_content) == content


@pytest.mark.parametrize(
    "href, want",
    [
        ("https://o.example/x", "https://o.example/x"),
        ("//h.example/x", "https://h.example/x"),
        ("/r/../s/./t?x=../", "https://g.example/s/t?x=../"),
        ("../u", "https://g.example/list/u"),
        ("v?q", "https://g.example/list/p/v?q"),
        ("#f", "https://g.example/list/p/i.html?a=1#f"),
        ("?q=1", "https://g.example/list/p/i.html?q=1"),
        ("mailto:x@y", "mailto:x@y"),
        ("", ""),
        (None, None),
    ],
)
def test_resolve_url(spark, href, want):
    page = F.lit("https://g.example/list/p/i.html?a=1#z")
    assert one(spark, href, lambda c: text.resolve_url(c, page)) == want


def test_absent_is_not_empty(spark):
    """The fallback is for an absent element; a present, empty one stays empty."""
    chain = lambda c: h.first_text(c, h.element("h2"), h.element("h1"))
    assert one(spark, "<h1>a</h1>", chain) == "a"
    assert one(spark, "<h1>a</h1><h2> </h2>", chain) == ""
    assert one(spark, "<h3>a</h3>", chain) is None


def test_conditions(spark):
    name = lambda cond: (lambda c: h.first_match(c, h.element("div", cond)))
    page = '<div class="a card__menu-x">1</div><DIV id=q data-class="card__menu" class=\'b card__menu\'>2</DIV>'
    assert one(spark, page, name(h.has_class("card__menu"))) == "2"
    assert one(spark, page, name(h.attr_contains("class", "card__menu"))) == "1"
    assert one(spark, page, name(h.has_class("menu"))) is None
    link = '<a href="tel:1" data-event="CTA_tel">x</a>'
    for cond in (h.attr_starts("href", "tel:"), h.attr_equals("data-event", "CTA_tel")):
        assert one(spark, link, lambda c, k=cond: h.first_match(c, h.element("a", k))) == "x"


def test_quotes(spark):
    """Values in either kind of quotes or none; the other kind may be inside."""
    href = lambda c: h.first_attr(c, h.attribute("a", "href"))
    assert one(spark, """<a href="/l'atelier">x</a>""", href) == "/l'atelier"
    assert one(spark, """<a href='/a"b'>x</a>""", href) == '/a"b'
    assert one(spark, "<a id=1 href=/bare>x</a>", href) == "/bare"
    assert one(spark, "<a href = '' >x</a>", href) == ""
    assert one(spark, "<a data-href='/n'>x</a>", href) is None
    for tag in ("<b class=k>", "<b class='j k'>", '<b class="it\'s k">', "<b class = k id=1>"):
        assert one(spark, tag + "t</b>", lambda c: h.first_text(c, h.element("b", h.has_class("k")))) == "t"
    for tag in ("<b class=kk>", "<b class='j-k'>", '<b title="k" class="l">', "<b class=k-j>"):
        assert one(spark, tag + "t</b>", lambda c: h.first_text(c, h.element("b", h.has_class("k")))) is None
    same = lambda c: h.first_match(c, h.element("a", h.attr_equals("rel", "q")))
    assert [one(spark, f"<a rel={v}>t</a>", same) for v in ("q", "'q'", "'qq'", "qq")] == ["t", "t", None, None]


def test_link_by_text(spark):
    rule = lambda c: h.link_by_text(
        c, "Visit Website", h.attribute("a", "href", h.attr_equals("data-event", "W")),
        F.lit("https://g.example/x"),
    )
    cta = '<a data-event="W" href="/w">w</a>'
    assert one(spark, cta + '<a href="/v"><i></i> Visit Website</a>', rule) == "https://g.example/v"
    assert one(spark, cta + '<a href="">Visit Website</a>', rule) is None
    assert one(spark, cta + '<a>Visit Website</a>', rule) is None
    assert one(spark, "<p>Visit Website</p>" + cta, rule) == "https://g.example/w"
    assert one(spark, '<a data-event="W" href="">w</a>', rule) is None


def test_split_cards(spark):
    cut = lambda c: h.split_cards(c, "<li>", h.element("b"), "</ul>")
    assert one(spark, "<li>a<li>b</ul>tail", cut) == ["<li>a", "<li>b"]
    assert one(spark, "head<b>x</b> <b>y</b>", cut) == ["x", "y"]
    assert one(spark, "none", cut) == []
    with pytest.raises(ValueError):
        h.split_cards(F.col("s"), "li")


@pytest.mark.parametrize(
    "srcs, stars, bib, listing, nearby",
    [
        ([S, S], 2, False, "2 star", "2 star(s)"),
        ([B], 0, True, "Bib Gourmand", "Bib Gourmand"),
        ([S, B], 1, True, "Bib Gourmand", "1 star(s)"),
        ([S + B], 1, False, "1 star", "1 star(s)"),
        (["x"], 0, False, "None", "None"),
        ([], 0, False, "None", "None"),
    ],
)
def test_awards(spark, srcs, stars, bib, listing, nearby):
    df = spark.createDataFrame([(srcs,)], "s array<string>")
    n, flag = values.award_flags(F.col("s"), "1star", "bib-gourmand")
    row = df.select(
        n.alias("n"),
        flag.alias("b"),
        values.distinction(n, flag).alias("l"),
        values.distinction(n, flag, "stars_first").alias("y"),
    ).first()
    assert tuple(row) == (stars, bib, listing, nearby)


@pytest.mark.parametrize(
    "raw, listing, detail",
    [
        ("฿ · Thai", ("฿", "Thai"), ("฿", "Thai")),
        ("฿ · Thai · X", ("฿", "Thai"), ("฿", "Thai")),
        ("฿·Thai", ("฿", "Thai"), ("฿·Thai", None)),
        ("Thai", (None, "Thai"), ("Thai", None)),
        ("", (None, ""), ("", None)),
        (None, (None, None), (None, None)),
    ],
)
def test_split_pair(spark, raw, listing, detail):
    df = spark.createDataFrame([(raw,)], "s string")
    a = values.split_pair(F.col("s"), "·", "left", trim=True)
    b = values.split_pair(F.col("s"), " · ", "right")
    assert tuple(df.select(*a).first()) == listing
    assert tuple(df.select(*b).first()) == detail


def test_modes_are_checked():
    with pytest.raises(ValueError):
        values.distinction(F.lit(1), F.lit(True), "x")
    with pytest.raises(ValueError):
        values.split_pair(F.lit("a"), "·", "x")


def test_fill_sentinels(spark):
    df = spark.createDataFrame(
        [(None, None, None, None, None), ("", "", 2, "x", 1)],
        "a string, b string, stars int, distinction string, n int",
    )
    rows = [tuple(r) for r in values.fill_sentinels(df).collect()]
    assert rows == [("N/A", "N/A", 0, "None", None), ("", "", 2, "x", 1)]
    rows = [tuple(r) for r in values.fill_sentinels(df, ["a"], F.lit(False)).collect()]
    assert rows[0] == (None,) * 5


def test_map_last_wins(spark):
    df = spark.createDataFrame(
        [([("b", "1"), ("a", "2"), ("b", "3"), ("c", "4"), ("a", "5"), ("b", "6")],), ([],), (None,)],
        "e array<struct<k:string,v:string>>",
    )
    rows = df.select(F.map_entries(nested.map_last_wins(F.col("e"))).alias("m")).collect()
    assert [tuple(e) for e in rows[0]["m"]] == [("b", "6"), ("a", "5"), ("c", "4")]
    assert rows[1]["m"] is None and rows[2]["m"] is None


def test_json_forms(spark):
    df = spark.createDataFrame(
        [({"é": 'q"\\\n', "b": ""}, [("x", None, 1)], ["p", "q"])],
        "m map<string,string>, a array<struct<name:string,url:string,stars:int>>, l array<string>",
    )
    row = df.select(
        nested.map_to_json(F.col("m"), spaced=True).alias("m"),
        nested.array_to_json(
            F.col("a"), {"name": "string", "url": "string", "stars": "integer"}
        ).alias("a"),
        nested.array_to_json(F.col("a")).alias("c"),
        nested.join_list(F.col("l")).alias("l"),
    ).first()
    dump = lambda v: json.dumps(v, ensure_ascii=False)
    assert row["m"] == dump({"é": 'q"\\\n', "b": ""})
    assert row["a"] == dump([{"name": "x", "url": None, "stars": 1}])
    assert json.loads(row["c"]) == [{"name": "x", "url": None, "stars": 1}]
    assert row["l"] == "p; q"


def test_broken_pages_take_linear_time(spark):
    """Long runs of unclosed tags, comments and cards neither hang nor overflow."""
    from pagelake.operators.cards import extract_details, listing_cards
    from pagelake.plans.rules import DETAILS, LISTING_CARDS

    pages = [
        "<a " * 200_000 + "tel: CTA_website Visit Website -award",
        "<div class='card--title " * 50_000 + "card-borderline data-sheet__detail-info",
        "<div class='card-borderline'>" * 20_000,
        "<div class='card__menu selection-card'>" * 20_000 + "<h3 class='title'>" * 2_000,
        "<" * 500_000 + "Nearby Restaurants data-sheet__description",
        "<p>" + "x " * 500_000 + "card__menu",
    ]
    df = spark.createDataFrame(
        [(n, f"https://g.example/{n}", page) for n, page in enumerate(pages)],
        "page_no int, url string, html string",
    )
    assert extract_details(df, DETAILS).filter("phone is not null").count() == 0
    cards = listing_cards(df, LISTING_CARDS).groupBy("page_no").count().collect()
    assert {r["page_no"]: r["count"] for r in cards} == {3: 20_000}
