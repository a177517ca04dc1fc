"""Whole jobs on hand-written pages, against answers worked out by hand."""

import csv
import glob
import json
import os
from dataclasses import replace

import pytest
from markup import (
    BASE,
    LISTING_ROWS,
    ORIGIN,
    S,
    U,
    card,
    detail_listing,
    detail_pages,
    hours_card,
    info,
    listing_pages,
    page,
    page_address,
)
from pyspark.sql import functions as F

from pagelake.operators import metrics
from pagelake.operators.cards import explode_cards, extract_details, listing_cards
from pagelake.plans.details import build_details
from pagelake.plans.listing import build_listing
from pagelake.plans.rules import DETAILS, LISTING_CARDS
from pagelake.plans.run import run
from pagelake.schemas import CARD, DETAIL, LISTING
from pagelake.session import stage, work_path
from pagelake.sinks.files import write_csv, write_csv_flat, write_json
from pagelake.sources.listing_csv import PANDAS_NA_TOKENS, read_listing_csv
from pagelake.sources.pages import listing_pages as pages_of
from pagelake.sources.pages import page_sequence, page_url


def tuples(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def text_of(path, kind):
    parts = sorted(glob.glob(f"{path}/part-*.{kind}"))
    return "".join(open(p, encoding="utf-8").read() for p in parts)


@pytest.fixture(scope="module")
def listing(spark):
    return build_listing(listing_pages(spark))


@pytest.fixture(scope="module")
def details(spark):
    return stage(build_details(detail_listing(spark), detail_pages(spark)))


def test_listing(listing):
    assert tuples(listing, "page_no", "pos") == LISTING_ROWS
    assert [(f.name, f.dataType) for f in listing.schema] == [
        (f.name, f.dataType) for f in LISTING
    ]


def test_listing_page_cap(spark):
    assert tuples(build_listing(listing_pages(spark), 1), "pos") == LISTING_ROWS[:3]


def test_summary(listing):
    assert tuple(metrics.listing_summary(listing).first()) == (4, 2, 2)
    assert [tuple(r) for r in metrics.star_breakdown(listing).collect()] == [(2, 1), (1, 1)]
    assert [tuple(r) for r in metrics.top_locations(listing).collect()] == [
        ("Bangkok", 2),
        ("Phuket", 1),
        (None, 1),
    ]


def test_tallies(spark):
    cards = stage(listing_cards(listing_pages(spark), LISTING_CARDS, outer=True))
    got = tuples(
        metrics.page_tallies(cards).select("page_no", "found", "new", "duplicate", "nameless"),
        "page_no",
    )
    assert got == [(1, 12, 3, 0, 9), (2, 8, 1, 1, 6), (3, 4, 0, 1, 3)]


def test_tally_of_a_page_without_cards(spark):
    pages = listing_pages(spark).filter("page_no = 1").unionByName(
        spark.createDataFrame([(2, "u", "<html></html>")], "page_no int, url string, html string")
    )
    cards = stage(listing_cards(pages, LISTING_CARDS, outer=True))
    got = tuples(metrics.page_tallies(cards), "page_no")
    assert got[1] == (2, 0, 0, 0, 0)


def test_pages_by_address(spark):
    rows = [(page_address(n), str(n)) for n in (1, 2, 20, 21, 10**9)]
    rows += [(BASE + "/page/x", "x"), (BASE + "s", "s"), ("https://o.example/page/3", "o")]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = tuples(pages_of(pages, BASE).select("page_no", "html"), "page_no")
    assert got == [(1, "1"), (2, "2"), (20, "20")]
    got = tuples(pages_of(pages, BASE, None).select("page_no"), "page_no")
    assert got == [(1,), (2,), (20,), (21,), (10**9,)]
    urls = page_sequence(spark, 3).select(page_url(BASE, F.col("page_no")).alias("u"))
    assert [r["u"] for r in urls.collect()] == [page_address(n) for n in (1, 2, 3)]


def test_card_fallback(spark):
    """Without cards the tracked links count; their own link is not inside them."""
    html = '<a data-track="x-restaurant" href="/restaurant/q"><h3 class="a-title">Q</h3></a>'
    pages = spark.createDataFrame([(1, BASE, html)], "page_no int, url string, html string")
    row = listing_cards(pages, LISTING_CARDS).first()
    assert (row["name"], row["url"], row["stars"], row["distinction"]) == ("Q", None, 0, "None")
    both = page(card("A", "a")) + html
    cards = explode_cards(
        spark.createDataFrame([(1, BASE, both)], "page_no int, url string, html string"),
        LISTING_CARDS.marker,
        LISTING_CARDS.fallback,
    )
    assert cards.count() == 1


def test_unnamed_mark_is_no_name(spark):
    pages = spark.createDataFrame(
        [(1, BASE, page(card("N/A", "a"), card("", "b"), card("C", "c")))],
        "page_no int, url string, html string",
    )
    assert [r["name"] for r in build_listing(pages).collect()] == ["C"]


def test_details(details):
    alpha, beta, gamma = (r.asDict(recursive=True) for r in details.orderBy("pos").collect())
    assert alpha["address"] == "68/1 Soi A" and alpha["phone"] == "+66 1"
    assert alpha["description"] == "Fine." and alpha["website"] == "https://a.example"
    assert (alpha["price_range"], alpha["cuisine_type"]) == ("฿฿฿฿", "Indian")
    assert list(alpha["opening_hours"].items()) == [
        ("Monday", "19:00-23:00"),
        ("Tuesday", "closed"),
    ]
    near = alpha["nearby_restaurants"]
    assert [n["name"] for n in near] == ["N1", "N2", "N4", "N5", "N6", "N7", "N8", "N9"]
    assert near[0] == {
        "name": "N1",
        "url": U + "r/restaurant/n1",
        "location": "Bangkok",
        "price": "฿",
        "cuisine": "Thai",
        "stars": 1,
        "distinction": "1 star(s)",
    }
    assert (near[1]["stars"], near[1]["distinction"]) == (0, "Bib Gourmand")
    assert (near[2]["price"], near[2]["cuisine"]) == (None, "Thai")
    assert beta["address"] == "" and beta["phone"] is None and beta["description"] == "Old."
    assert (beta["price_range"], beta["cuisine_type"]) == ("Thai", None)
    assert beta["website"] is None and beta["opening_hours"] is None
    assert beta["nearby_restaurants"] is None
    assert (alpha["error"], beta["error"], gamma["error"]) == (None, None, "page not found")
    assert (gamma["name"], gamma["stars"], gamma["address"]) == ("Gamma", 0, None)


def test_detail_schema(details):
    kinds = {f.name: f.dataType.simpleString() for f in details.schema}
    want = {f.name: f.dataType.simpleString() for f in DETAIL}
    assert {n: kinds[n] for n in want} == want
    assert set(kinds) - set(want) == {"page_no", "pos"}


def test_detail_fallbacks(spark):
    item = '<li class="a restaurant-details__heading--list-item"><i>{}</i></li>'
    html = (
        "<li><a href='https://maps.example'>no</a></li>"
        + item.format('<a href="https://x.example/maps/1"> 1 Road </a>')
        + item.format('<a href="skype:tel:2">02</a>')
        + '<a data-event="CTA_website" href="/home">w</a>'
    )
    pages = spark.createDataFrame([(U + "d", html)], "url string, html string")
    row = extract_details(pages, DETAILS).first()
    assert (row["address"], row["phone"]) == ("1 Road", "02")
    assert row["website"] == U + "home"
    assert row["price_range"] is None and row["description"] is None


def test_info_needs_the_second_child(spark):
    """The second text is the block's second child, in the first block that has one."""
    html = (
        '<div class="data-sheet__block"><div class="data-sheet__block--text">out</div></div>'
        '<div class="data-sheet__detail-info">'
        '<div class="data-sheet__block"><div class="data-sheet__block--title">t</div></div>'
        '<div class="data-sheet__block"><div class="data-sheet__block--text">one</div>'
        '<div class="data-sheet__block--text">฿\n  ·\n  Thai</div></div></div>'
    )
    row = extract_details(
        spark.createDataFrame([(U, html)], "url string, html string"), DETAILS
    ).first()
    assert (row["address"], row["price_range"], row["cuisine_type"]) == ("one", "฿", "Thai")


def fields(spark, html):
    return extract_details(
        spark.createDataFrame([(U, html)], "url string, html string"), DETAILS
    ).first()


def venues(spark, html, rules=LISTING_CARDS):
    pages = spark.createDataFrame([(1, BASE, html)], "page_no int, url string, html string")
    rows = listing_cards(pages, rules).filter("name is not null").orderBy("pos").collect()
    return [(r["name"], r["url"], r["stars"]) for r in rows]


@pytest.mark.parametrize("around", ["<!-- {} -->", "<script>{}</script>", "<style>{}</style>", "<template>{}</template>", "<!-- {}"])
def test_hidden_cards_are_no_cards(spark, around):
    assert venues(spark, page(card("New", "n")) + around.format(card("Old", "o"))) == [("New", ORIGIN + "n", 0)]


def test_cards_end_at_their_own_tag(spark):
    """What follows the last card on the page belongs to no card."""
    tail = '<a href="/x/restaurants/page/2">2</a><footer><h3 class="footer-title">About</h3></footer>'
    bare = '<div class="card__menu"><h3 class="title">B</h3></div>'
    assert venues(spark, page(card("A", "a"), bare) + tail) == [("A", ORIGIN + "a", 0), ("B", None, 0)]
    assert venues(spark, page('<div class="card__menu"><div>no title</div></div>') + tail) == []
    nested = '<div class="card__menu"><div><div>x</div></div><h3 class="title">N</h3></div>'
    assert venues(spark, page(nested) + tail) == [("N", None, 0)]
    unclosed = '<div class="card__menu"><div><h3 class="title">U</h3>'
    assert [v[0] for v in venues(spark, page(unclosed, card("V", "v")))] == ["U", "V"]


def test_any_card_class(spark):
    """A wrapper repeats its first card, which the dedup absorbs."""
    wrapped = f'<div class="card__menu-list">{card("A", "a")}{card("B", "b")}</div>'
    assert [v[0] for v in venues(spark, page(wrapped))] == ["A", "A", "B"]
    pages = spark.createDataFrame([(1, BASE, page(wrapped))], "page_no int, url string, html string")
    assert [r["name"] for r in build_listing(pages).orderBy("pos").collect()] == ["A", "B"]


def test_quoted_angle_brackets(spark):
    html = '<div data-x="a => b" title=\'<i>\' class="card__menu"><h3 data-y="1 > 0" class="title">Q</h3></div>'
    assert venues(spark, html) == [("Q", None, 0)]


def test_award_class_is_exact_and_block_is_balanced(spark):
    block = '<div class="card__menu-content--distinction"><div></div><img class="{}" src="{}"></div>'
    one = '<div class="card__menu"><h3 class="title">A</h3>' + block + "</div>"
    assert venues(spark, one.format("chef-award", S))[0][2] == 0
    assert venues(spark, one.format("x award", S))[0][2] == 1
    rules = replace(LISTING_CARDS, award_class="guide-award")
    assert venues(spark, one.format("guide-award", S), rules)[0][2] == 1


def test_nearby_needs_its_container(spark):
    near = "<h2>Nearby Restaurants</h2>" + card("A", "a")
    more = f'<div class="container"><h2>You may also like</h2>{card("Z", "z")}</div>'
    names = lambda html: [n["name"] for n in fields(spark, html)["nearby_restaurants"] or ()]
    assert names(near) == []
    assert names(f'<div class="x container-y">{near}</div>{more}') == ["A"]
    assert names(f'<div class="container"><div class="container">{near}</div>{card("B", "b")}</div>{more}') == ["A", "B"]


def test_address_stays_inside_the_info_element(spark):
    outside = '<div class="data-sheet__block"><div class="data-sheet__block--text">OUT</div></div>'
    item = '<li class="restaurant-details__heading--list-item-x"><a href="/maps">Map</a></li>'
    assert fields(spark, '<div class="data-sheet__detail-info"></div>' + outside + item)["address"] == "Map"
    assert fields(spark, info("In") + outside)["address"] == "In"


def test_website_by_the_links_own_text(spark):
    cta = '<a data-event="CTA_website" href="/c">x</a>'
    assert fields(spark, '<a href="/v"><span>Visit Website</span></a>' + cta)["website"] == U + "c"
    assert fields(spark, '<a href="/v"><i class="k">i</i><br>Visit Website</a>' + cta)["website"] == U + "v"


def test_hours_of_nested_cards(spark):
    """An outer card has all hours inside it; inner cards, later, overwrite its day."""
    inner = hours_card("Monday", "9-10") + hours_card("Tuesday", "11-12")
    html = f'<div class="restaurant-details__components">{inner}</div>'
    assert fields(spark, html)["opening_hours"] == {"Monday": "9-10", "Tuesday": "11-12"}


def test_hours_tail_is_cut(spark):
    html = hours_card("Monday", "9-10") + "<h2>More</h2><div class='card--content'>x</div>"
    row = extract_details(
        spark.createDataFrame([(U, html)], "url string, html string"), DETAILS
    ).first()
    assert row["opening_hours"] == {"Monday": "9-10"}


@pytest.mark.parametrize("start, rows, names", [(0, None, 3), (0, 0, 3), (1, 1, 1), (2, 5, 1), (9, 2, 0)])
def test_detail_slices(spark, start, rows, names):
    got = build_details(detail_listing(spark), detail_pages(spark), start, rows)
    assert got.count() == names


def test_details_without_links(spark):
    assert build_details(detail_listing(spark).drop("url"), detail_pages(spark)).isEmpty()


def test_first_capture_counts(spark):
    pages = spark.createDataFrame(
        [(2, U + "a", info("new", "x")), (1, U + "a", info("old", "x"))],
        "at int, url string, html string",
    )
    got = build_details(detail_listing(spark), pages, capture_order=["at"])
    assert got.count() == 3
    assert got.filter("name = 'Alpha'").first()["address"] == "old"


def test_one_row_per_listing_row(spark):
    """Without an order of captures, and with equal ones, each page still counts once."""
    pages = spark.createDataFrame(
        [(1, U + "a", info("x", "x")), (1, U + "a", info("y", "x"))], "at int, url string, html string"
    )
    for order in ((), ["at"]):
        got = build_details(detail_listing(spark), pages, capture_order=order)
        assert got.count() == 3


def test_message_of_a_failed_capture(spark):
    pages = detail_pages(spark).withColumn("error", F.lit(None).cast("string"))
    failed = spark.createDataFrame([(U + "c", None, "timeout"), (U + "a", None, "old")], pages.schema)
    got = {r["name"]: r["error"] for r in build_details(detail_listing(spark), pages.union(failed)).collect()}
    assert got == {"Alpha": None, "Beta": None, "Gamma": "timeout"}


def test_completeness(details):
    got = metrics.completeness(details).collect()
    assert [r["present"] for r in got] == [1, 2, 2, 1]
    assert [r["total"] for r in got] == [3] * 4
    assert got[1]["percent"] == pytest.approx(200 / 3) and got[1]["percent_1dp"] == 66.7
    got = metrics.completeness(details, reference_compat=True).collect()
    assert [r["present"] for r in got] == [2, 3, 3, 2]
    empty = metrics.completeness(details.limit(0)).first()
    assert (empty["present"], empty["total"], empty["percent"]) == (0, 0, None)


def test_two_stages(spark):
    out = work_path(spark, "test")
    near = detail_pages(spark).withColumn(
        "url", F.when(F.col("url").endswith("a"), LISTING_ROWS[0][3]).otherwise(LISTING_ROWS[1][3])
    )
    done = run(spark, out, listing_pages(spark), near)
    assert done.ok and done.listing.count() == 4 and done.details.count() == 4
    assert done.summary.first()["total"] == 4
    assert [r["present"] for r in done.report.collect()] == [1, 2, 2, 1]

    listing = json.loads(text_of(f"{out}/listing_json", "txt"))
    assert list(listing[0]) == [f.name for f in CARD]
    assert listing[0]["price"] == "฿฿฿฿" and listing[2] == {
        "name": "Gamma",
        "url": LISTING_ROWS[2][3],
        "stars": 0,
        "distinction": "None",
        "location": "N/A",
        "price": "N/A",
        "cuisine": "N/A",
    }
    assert sorted(n for n in os.listdir(out)) == [
        "details", "details_csv", "details_json", "listing", "listing_csv", "listing_json"]
    rows = list(csv.reader(text_of(f"{out}/listing_csv", "csv").splitlines()))
    assert rows[0] == [f.name for f in CARD] and rows[1][:3] == ["Alpha", LISTING_ROWS[0][3], "2"]

    records = json.loads(text_of(f"{out}/details_json", "txt"))
    assert "error" not in records[0] and records[1]["phone"] == "N/A"
    assert records[1]["opening_hours"] == records[1]["nearby_restaurants"] == "N/A"
    assert set(records[2]) == {"url", "name", "location", "stars", "distinction", "error"}

    cells = list(csv.DictReader(text_of(f"{out}/details_csv", "csv").splitlines()))
    assert list(cells[0]) == sorted({f.name for f in DETAIL})
    assert cells[0]["opening_hours"] == '{"Monday": "19:00-23:00", "Tuesday": "closed"}'
    assert len(json.loads(cells[0]["nearby_restaurants"])) == 8
    assert json.loads(cells[0]["nearby_restaurants"])[2]["price"] == "N/A"
    assert cells[1]["opening_hours"] == "N/A" and cells[1]["error"] == ""
    assert cells[1]["address"] == "" and cells[2]["address"] == ""

    from_csv = run(spark, out + "-c", detail_pages=near, stage="details", listing_csv=f"{out}/listing_csv", start=1)
    assert from_csv.ok
    assert json.loads(text_of(f"{out}-c/details_json", "txt")) == records[1:]

    again = run(spark, out, detail_pages=near, stage="details", max_rows=1)
    assert again.ok and again.details.count() == 1
    header = text_of(f"{out}/details_csv", "csv").splitlines()[0].split(",")
    assert "error" not in header


def test_gates(spark):
    empty = spark.createDataFrame([], "page_no int, url string, html string")
    out = work_path(spark, "test")
    assert not run(spark, out, empty, empty).ok
    missing = work_path(spark, "test")
    assert not run(spark, missing, detail_pages=empty, stage="details").ok
    with pytest.raises(ValueError):
        run(spark, out, empty, stage="x")


def test_csv_input(spark):
    path = work_path(spark, "test") + ".csv"
    rows = ["name,url,stars,distinction,location", "A,http://x,0,None,N/A"]
    rows += ["B,N/A,2.0,2 star,Bangkok", "NA,http://y,1,1 star,", '"q ""x"", y",u,,,"a\nb"']
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(rows) + "\n")
    got = [tuple(r) for r in read_listing_csv(spark, path).collect()]
    assert got == [
        ("A", "http://x", 0, "None", None),
        ("B", None, 2, "2 star", "Bangkok"),
        ("NA", "http://y", 1, "1 star", None),
        ('q "x", y', "u", None, None, "a\nb"),
    ]
    got = [tuple(r) for r in read_listing_csv(spark, path, na_tokens=PANDAS_NA_TOKENS).collect()]
    assert got[0][3] is None and got[2][0] is None
    assert read_listing_csv(spark, path + ".absent") is None


def test_sinks(spark):
    rows = [(2, 'q "x", y\n\\', None), (1, " é ", ""), (3, "", "z")]
    df = spark.createDataFrame(rows, "ord int, a string, b string").repartition(3)
    path = work_path(spark, "test")
    write_json(df, path + "-a", "array", ["ord"])
    want = [{"a": " é ", "b": ""}, {"a": rows[0][1], "b": None}, {"a": "", "b": "z"}]
    assert json.loads(text_of(path + "-a", "txt")) == want
    write_json(df.filter("ord < 0"), path + "-e", "array", ["ord"])
    assert json.loads(text_of(path + "-e", "txt")) == []
    write_json(df.filter("ord = 1"), path + "-1", "array", ["ord"])
    assert json.loads(text_of(path + "-1", "txt")) == want[:1]
    write_json(df, path + "-l")
    lines = [json.loads(x) for x in text_of(path + "-l", "json").splitlines()]
    assert {"ord": 2, "a": rows[0][1], "b": None} in lines
    assert write_csv(df.coalesce(1), path + "-c")
    back = list(csv.reader(text_of(path + "-c", "csv").splitlines(keepends=True)))
    assert back[0] == ["ord", "a", "b"] and ["2", rows[0][1], ""] in back
    assert not write_csv(df.limit(0), path + "-n") and not glob.glob(path + "-n")
    flat = spark.createDataFrame([(["p", "q"], 1)], "facilities array<string>, a int").coalesce(1)
    assert write_csv_flat(flat, path + "-f")
    assert text_of(path + "-f", "csv") == "a,facilities\n1,p; q\n"
    with pytest.raises(ValueError):
        write_json(df, path, "x")
    with pytest.raises(ValueError):
        write_json(df, path, "array")
