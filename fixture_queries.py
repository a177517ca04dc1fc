"""Every operator bound to the driver's tables, for checks and timings.

A nav link stands for a card, ``page_id`` (from 0) for the page number, ``/th`` and
``/an`` in a link for the star and Bib images, and the footer for "price, cuisine".
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions import html as h
from pagelake.functions.nested import array_to_json, join_list, map_to_json
from pagelake.functions.text import origin
from pagelake.functions.values import award_flags, distinction, fill_sentinels, split_pair
from pagelake.operators import metrics
from pagelake.operators.bucketed import enrich_bucketed, write_bucketed
from pagelake.operators.cards import (
    day_map,
    explode_cards,
    extract_details,
    listing_cards,
    nearby_array,
    require,
)
from pagelake.operators.entries import last_wins_map
from pagelake.operators.ordered import ordered_slice, write_ordered
from pagelake.operators.relational import (
    append_new,
    cap_pages,
    enrich,
    first_wins,
    slice_rows,
    stop_at_first_gap,
    union_records,
    valid_url,
)
from pagelake.plans.details import build_details
from pagelake.plans.listing import build_listing
from pagelake.plans.rules import CardRules, DetailRules
from pagelake.plans.run import run
from pagelake.session import stage, work_path
from pagelake.sinks.files import write_csv, write_csv_flat, write_json
from pagelake.sources.listing_csv import read_listing_csv
from pagelake.sources.pages import only_page, only_url, page_sequence, page_url, read_pages
from pagelake.streaming.append import collect_listing, collected

NAV_MARKER = '<li><a href="'
NAV_END = "</ul>"
NAV_NAME = r"(?s)<a href=[^>]*>(.*?)</a>"
NAV_LINK = r'<a href="([^"]*)"'
NAV_HREF = r'<li><a href="([^"]*)">'
NAV_WORD = r'(?s)<li><a href="[^"]*">(.*?)</a></li>'
STAR = "/th"
BIB = "/an"

NAV_CARDS = CardRules(
    marker=NAV_MARKER,
    fallback=None,
    end=NAV_END,
    name=NAV_NAME,
    link=NAV_LINK,
    award_block=None,
    award_src=NAV_LINK,
    score=NAV_NAME,
    star=STAR,
    bib=BIB,
)
NAV_NEARBY = replace(NAV_CARDS, label_mode="stars_first", rendered=False)

PARAGRAPH_CARD = "<p>"
PARAGRAPH_DAY = r"(?s)^<p>(?:<b>)?\s*([A-Za-z])"
PARAGRAPH_HOURS = "^<p>(?:<b>)?(" + h.up_to("(?:</p>|<br>)") + ")"

PAGE_DETAILS = DetailRules(
    info=h.region("body"),
    block=h.Rule("<article>"),
    block_child="h1",
    block_text=h.element("h1"),
    heading_item=r"(?s)<nav>(.*?)</nav>",
    map_link=NAV_NAME,
    phone=h.element("a", h.attr_equals("href", "/to")),
    phone_link=h.element("a", h.attr_starts("href", "/th")),
    description=h.element("div", h.has_class("note")),
    old_description=h.element("div", h.has_class("ad")),
    hours_card=PARAGRAPH_CARD,
    hours_end="</article>|<footer>",
    day=PARAGRAPH_DAY,
    hours=PARAGRAPH_HOURS,
    website_text="the",
    website_link=r'<a href="(/de[^"]*)"',
    nearby_heading="<nav>",
    nearby_scope=None,
    nearby=NAV_NEARBY,
)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet")


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).withColumn("page_no", F.col("page_id"))


def _host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]+)", 1)


def _nav(spark: SparkSession, sf: str) -> DataFrame:
    """All nav cards: page_id, pos, name and link, as on the page."""
    cards = explode_cards(_pages(spark, sf), NAV_MARKER, end=NAV_END, keep=("page_id",))
    return cards.select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        h.first_text(F.col("frag"), NAV_NAME).alias("name"),
        h.first_attr(F.col("frag"), NAV_LINK).alias("url"),
    )


def _nav_first(spark: SparkSession, sf: str) -> DataFrame:
    return first_wins(require(_nav(spark, sf)), ["name"], ["page_id", "pos"])


def _hosts(spark: SparkSession, sf: str, max_pages: int | None = None) -> DataFrame:
    pages = cap_pages(_pages(spark, sf), max_pages, "page_id", first_page=0)
    hosts = pages.select("page_id", _host(F.col("url")).alias("name"))
    return first_wins(hosts, ["name"], ["page_id"])


def _awards(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", h.all_matches(F.col("html"), NAV_HREF).alias("s"))


# --- sources and sinks -----------------------------------------------------------


def scan_pages(spark, sf):
    return _pages(spark, sf).select("page_id", "url", F.length("html").alias("chars"))


def single_page(spark, sf):
    return only_page(_pages(spark, sf), 3, "page_id").select("page_id", "url", "html")


def single_url(spark, sf):
    """The page whose link is the greatest of all."""
    pages = _pages(spark, sf)
    return only_url(pages, pages.agg(F.max("url")).scalar()).select("page_id", "url", "html")


def page_url_query(spark, sf):
    return _pages(spark, sf).select(
        "page_id", page_url(origin(F.col("url")), F.col("page_id")).alias("listing_url")
    )


def page_news(spark, sf):
    """Page sequence, page 0 being its number 1, against the pages that add a host."""
    count = _pages(spark, sf).count()
    news = _hosts(spark, sf).groupBy((F.col("page_id") + 1).alias("page_no"))
    return (
        page_sequence(spark, count)
        .join(news.agg(F.count("*").alias("n")), "page_no", "left")
        .select(
            F.col("page_no").cast("bigint").alias("page_no"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


_PART = T.StructType(
    [
        T.StructField("p_partkey", T.LongType()),
        T.StructField("p_name", T.StringType()),
        T.StructField("p_brand", T.StringType()),
        T.StructField("p_size", T.IntegerType()),
        T.StructField("p_retailprice", T.DoubleType()),
    ]
)


def _part(spark, sf):
    return _table(spark, sf, "part").select(*_PART.fieldNames())


def csv_scan(spark, sf):
    """Links and the mark for missing ones, read back with nulls."""
    path = work_path(spark, "csv")
    docs = _table(spark, sf, "documents").join(_table(spark, sf, "labels"), "doc_id", "left")
    rows = docs.select(
        "doc_id",
        F.col("source").alias("name"),
        F.when(F.col("quality") == 1, F.concat(F.lit("u/"), "doc_id")).alias("url"),
        F.col("quality").alias("stars"),
        F.col("lang").alias("location"),
    )
    write_csv(fill_sentinels(rows, ["url", "location"]), path)
    back = read_listing_csv(spark, path)
    return back.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def csv_rejects(spark, sf):
    """Stars that are no number, too large, or written as a fraction; no row is lost."""
    path = work_path(spark, "csv")
    kind, small = F.col("doc_id") % 4, (F.col("doc_id") % 7).cast("string")
    stars = F.when(kind == 0, "two").when(kind == 1, "99999999999").when(kind == 2, small).otherwise("2.0")
    write_csv(_table(spark, sf, "documents").select("doc_id", "lang", stars.alias("stars")), path)
    back = read_listing_csv(spark, path, rejected=True)
    return back.select(
        F.col("doc_id").cast("bigint"), "lang", "stars", F.array_join("_rejected", ",").alias("rejected")
    )


def csv_roundtrip(spark, sf):
    path = work_path(spark, "csv")
    rows = _part(spark, sf)
    write_csv(rows.withColumn("p_name", F.concat(F.lit('"q", '), "p_name", F.lit("\nx"))), path)
    return read_listing_csv(spark, path, _PART)


def json_roundtrip(spark, sf):
    path = work_path(spark, "json")
    write_json(_part(spark, sf), path)
    return spark.read.schema(_PART).json(path)


def json_array_roundtrip(spark, sf):
    path = work_path(spark, "json")
    rows = _part(spark, sf).withColumn("ord", F.col("p_partkey"))
    write_json(rows, path, "array", ["ord"])
    lines = spark.read.text(path).filter("value not in ('[', ']')")
    record = F.regexp_replace("value", "^,", "")
    return lines.select(F.from_json(record, _PART).alias("r")).select("r.*")


def csv_flat_roundtrip(spark, sf):
    path = work_path(spark, "csv")
    talks = _table(spark, sf, "conversations")
    hours = last_wins_map(talks, ["conv_id"], "role", "text", "turn", "opening_hours")
    lists = talks.groupBy("conv_id").agg(
        F.array_sort(F.collect_set("role")).alias("facilities")
    )
    write_csv_flat(hours.join(lists, "conv_id"), path)
    back = read_listing_csv(spark, path)
    return back.select(F.col("conv_id").cast("bigint"), "facilities", "opening_hours")


# --- extraction ------------------------------------------------------------------


def explode_cards_query(spark, sf):
    return _nav(spark, sf)


def cards_fallback(spark, sf):
    cards = explode_cards(
        _pages(spark, sf), r"<section(?=[\s>])", h.element("li"), keep=("page_id",)
    )
    return cards.select("page_id", F.col("pos").cast("bigint").alias("pos"), "frag")


def first_text(spark, sf):
    return _pages(spark, sf).select(
        "page_id",
        h.first_text(F.col("html"), h.element("h2"), h.element("h1")).alias("heading"),
        h.first_text(F.col("html"), h.element("h2")).alias("absent"),
    )


def first_attr(spark, sf):
    return _pages(spark, sf).select(
        "page_id",
        h.first_attr(F.col("html"), h.attribute("a", "href"), F.col("url")).alias("link"),
    )


def nth_text(spark, sf):
    pattern = r"(?s)<p>(.*?)</p>"
    return _pages(spark, sf).select(
        "page_id",
        h.nth_text(F.col("html"), pattern, 0).alias("first"),
        h.nth_text(F.col("html"), pattern, 2).alias("third"),
    )


def award_label(spark, sf):
    stars, bib = award_flags(F.col("s"), STAR, BIB)
    return (
        _awards(spark, sf)
        .select("page_id", stars.cast("bigint").alias("stars"), bib.alias("bib"))
        .select(
            "page_id",
            "stars",
            "bib",
            distinction(F.col("stars"), F.col("bib")).alias("listing_label"),
            distinction(F.col("stars"), F.col("bib"), "stars_first").alias("nearby_label"),
        )
    )


def split_price_cuisine(spark, sf):
    pages = _pages(spark, sf).select(
        "page_id",
        h.first_text(F.col("html"), h.element("footer")).alias("footer"),
        h.first_text(F.col("html"), h.element("h1")).alias("heading"),
    )
    price, cuisine = split_pair(F.col("footer"), "·", "left", trim=True)
    price_range, cuisine_type = split_pair(F.col("footer"), " · ", "right")
    no_price, only_cuisine = split_pair(F.col("heading"), "·", "left", trim=True)
    only_price, no_cuisine = split_pair(F.col("heading"), " · ", "right")
    return pages.select(
        "page_id",
        price.alias("price"),
        cuisine.alias("cuisine"),
        price_range.alias("price_range"),
        cuisine_type.alias("cuisine_type"),
        no_price.alias("no_price"),
        only_cuisine.alias("only_cuisine"),
        only_price.alias("only_price"),
        no_cuisine.alias("no_cuisine"),
    )


def link_by_text(spark, sf):
    return _pages(spark, sf).select(
        "page_id",
        h.link_by_text(
            F.col("html"), "the", r'<a href="(/de[^"]*)"', F.col("url")
        ).alias("website"),
    )


def last_wins_query(spark, sf):
    talks = _table(spark, sf, "conversations")
    blank = F.trim("text")
    hours = F.when(blank == "", F.lit("closed")).otherwise(blank)
    maps = last_wins_map(
        talks.withColumn("text", hours), ["conv_id"], "role", "text", "turn", "hours"
    )
    rows = maps.select("conv_id", F.posexplode("hours").alias("place", "role", "hours"))
    return rows.withColumn("place", F.col("place").cast("bigint"))


def day_map_query(spark, sf):
    days = day_map(
        F.col("html"), PARAGRAPH_CARD, PARAGRAPH_DAY, PARAGRAPH_HOURS, "</article>|<footer>"
    )
    rows = _pages(spark, sf).select(
        "page_id", F.posexplode(days).alias("place", "day", "hours")
    )
    return rows.withColumn("place", F.col("place").cast("bigint"))


def section_after(spark, sf):
    return _pages(spark, sf).select(
        "page_id", h.section_after(F.col("html"), "<article>").alias("section")
    )


def nearby_first_n(spark, sf):
    near = nearby_array(F.col("html"), F.col("url"), "<nav>", NAV_NEARBY, 9)
    return _pages(spark, sf).select("page_id", F.inline(near))


def detail_record(spark, sf):
    return extract_details(_pages(spark, sf), PAGE_DETAILS, keep=("page_id",)).select(
        "page_id",
        "address",
        "phone",
        "description",
        map_to_json(F.col("opening_hours"), spaced=True).alias("opening_hours"),
        "price_range",
        "cuisine_type",
        "website",
        join_list(F.transform("nearby_restaurants", lambda n: n["name"])).alias("nearby"),
    )


def fill_sentinels_query(spark, sf):
    docs = _table(spark, sf, "documents").join(_table(spark, sf, "labels"), "doc_id", "left")
    return fill_sentinels(
        docs.select(
            "doc_id",
            F.when(F.col("toxic") == 0, F.col("source")).alias("location"),
            F.col("quality").alias("stars"),
            F.when(F.col("quality") > 0, distinction(F.col("quality"), F.lit(False))).alias(
                "distinction"
            ),
        )
    )


# --- relational ------------------------------------------------------------------


def dedup_first(spark, sf):
    return _nav_first(spark, sf)


def append_new_query(spark, sf):
    """Nav words that do not occur in any heading."""
    headings = _pages(spark, sf).select(
        F.explode(F.split(h.first_text(F.col("html"), h.element("h1")), " ")).alias("name")
    )
    return append_new(headings, require(_nav(spark, sf)), ["name"], ["page_id", "pos"])


def stop_at_gap(spark, sf):
    return stop_at_first_gap(_hosts(spark, sf), "page_id", max_pages=None, first_page=0)


def stop_at_gap_capped(spark, sf):
    return stop_at_first_gap(_hosts(spark, sf, 5), "page_id", max_pages=5, first_page=0)


def _links(spark, sf):
    """Links, with the missing mark in place of those that have a query."""
    url = F.when(F.col("url").contains("?"), "N/A").otherwise(F.col("url"))
    return valid_url(_pages(spark, sf).withColumn("url", url))


def slice_rows_query(spark, sf):
    return slice_rows(_links(spark, sf).select("page_id", "url"), ["page_id"], 10, 25)


def slice_indexed(spark, sf):
    """Two slices of one stored order: rows 10 to 35 and all from 100 on."""
    path = work_path(spark, "order")
    write_ordered(_links(spark, sf).select("page_id", "url"), path, ["page_id"])
    return ordered_slice(spark, path, 10, 25).union(ordered_slice(spark, path, 100))


def slice_tail(spark, sf):
    return slice_rows(_links(spark, sf).select("page_id", "url"), ["page_id"], 100)


def enrich_left(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return enrich(
        docs, _table(spark, sf, "labels"), ["lang", "source", "n_chars"], "doc_id", order=()
    )


def enrich_hot(spark, sf):
    """One language holds most rows: the join splits its hot keys."""
    docs = _table(spark, sf, "documents").select("doc_id", "lang", "source")
    langs = docs.groupBy("lang").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    return enrich(docs, langs, ["doc_id", "source"], "lang", order=(), salted=True, hot_rows=100)


def enrich_bucketed_query(spark, sf):
    """Both sides stored by the hash of the key first; the join itself shuffles nothing."""
    docs = _table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    names = []
    for df in (docs, _table(spark, sf, "labels")):
        path = work_path(spark, "bucketed")
        names.append(path.rsplit("/", 1)[1].replace("-", "_"))
        write_bucketed(df, names[-1], path, "doc_id", buckets=16)
    return enrich_bucketed(spark, *names, ["lang", "source", "n_chars"], "doc_id", order=())


def union_query(spark, sf):
    return union_records(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


# --- metrics ---------------------------------------------------------------------


def _award_rows(spark, sf):
    return award_label(spark, sf).withColumnRenamed("listing_label", "distinction")


def listing_summary(spark, sf):
    return metrics.listing_summary(_award_rows(spark, sf))


def star_breakdown(spark, sf):
    return metrics.star_breakdown(_award_rows(spark, sf))


def top_k_stable(spark, sf):
    return metrics.top_locations(_nav(spark, sf), 10, "name", "page_id", "pos")


def _labelled(spark, sf):
    docs = _table(spark, sf, "documents").join(_table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(
        F.when(F.col("quality") == 1, "p").when(F.col("quality") == 0, "N/A").alias("phone"),
        F.when(F.col("toxic") == 0, "").when(F.col("toxic") == 1, "N/A").alias("address"),
        F.col("lang").alias("description"),
        F.when(F.col("quality").isNull(), F.lit("page not found")).alias("error"),
    )


def completeness(spark, sf):
    return metrics.completeness(_labelled(spark, sf), metrics.SHORT_CHECKS)


def completeness_compat(spark, sf):
    return metrics.completeness(_labelled(spark, sf), metrics.SHORT_CHECKS, reference_compat=True)


def page_tallies(spark, sf):
    cards = stage(listing_cards(_numbered(spark, sf), NAV_CARDS, outer=True), "cards")
    return metrics.page_tallies(cards, first_page=0)


# --- nested text -----------------------------------------------------------------


def map_to_json_query(spark, sf):
    pair = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    return _table(spark, sf, "part").select(
        "p_partkey",
        map_to_json(pair).alias("compact"),
        map_to_json(pair, spaced=True).alias("spaced"),
    )


def array_to_json_query(spark, sf):
    words = F.transform(
        h.all_matches(F.col("html"), NAV_WORD),
        lambda w: F.struct(w.alias("name"), F.length(w).alias("n")),
    )
    return _pages(spark, sf).select(
        "page_id",
        array_to_json(words).alias("compact"),
        array_to_json(words, {"name": "string", "n": "integer"}).alias("spaced"),
    )


def array_join(spark, sf):
    return _pages(spark, sf).select(
        "page_id", join_list(h.all_matches(F.col("html"), NAV_WORD)).alias("words")
    )


# --- whole jobs ------------------------------------------------------------------


def build_listing_query(spark, sf):
    return build_listing(_numbered(spark, sf), None, NAV_CARDS, first_page=0)


def _detail_pages(spark, sf):
    """Pages known by the link of their first nav entry, so that some cards hit them."""
    link = h.first_attr(F.col("html"), NAV_LINK, F.col("url"))
    return _pages(spark, sf).withColumn("url", link)


def _detail_columns(details):
    """All columns; maps and arrays as text."""
    return details.select(
        "page_no",
        "pos",
        "url",
        "address",
        "phone",
        "description",
        map_to_json(F.col("opening_hours"), spaced=True).alias("opening_hours"),
        "price_range",
        "cuisine_type",
        "website",
        array_to_json(F.col("nearby_restaurants")).alias("nearby"),
        "name",
        "location",
        "stars",
        "distinction",
        "error",
    )


def build_details_query(spark, sf):
    listing = build_listing(_numbered(spark, sf), None, NAV_CARDS, first_page=0)
    details = build_details(
        listing, _detail_pages(spark, sf), rules=PAGE_DETAILS, capture_order=["page_id"]
    )
    return _detail_columns(details)


def build_details_slice(spark, sf):
    listing = build_listing(_numbered(spark, sf), None, NAV_CARDS, first_page=0)
    details = build_details(
        listing, _detail_pages(spark, sf), 5, 40, PAGE_DETAILS, capture_order=["page_id"]
    )
    return _detail_columns(details)


def two_stage_run(spark, sf):
    outcome = run(
        spark,
        work_path(spark, "run"),
        _numbered(spark, sf),
        _detail_pages(spark, sf),
        max_pages=None,
        card_rules=NAV_CARDS,
        detail_rules=PAGE_DETAILS,
        first_page=0,
        capture_order=["page_id"],
    )
    return outcome.report


def details_from_csv(spark, sf):
    """Listing stage, its CSV, and the detail stage on that file: rows 5 to 45."""
    first, second = work_path(spark, "run"), work_path(spark, "run")
    run(spark, first, _numbered(spark, sf), stage="global", max_pages=None, card_rules=NAV_CARDS, first_page=0)
    outcome = run(
        spark,
        second,
        detail_pages=_detail_pages(spark, sf),
        stage="details",
        start=5,
        max_rows=40,
        listing_csv=f"{first}/listing_csv",
        detail_rules=PAGE_DETAILS,
        capture_order=["page_id"],
    )
    return _detail_columns(outcome.details).drop("page_no", "pos")


def _streamed(spark, sf):
    """A table of the pages' cards from a stream of four batches, the last pages first."""
    pages, source = _numbered(spark, sf), work_path(spark, "source")
    table, progress = work_path(spark, "stream"), work_path(spark, "progress")
    last = pages.agg(F.max("page_no")).scalar()
    for part in (3, 1, 2, 0):
        some = pages.filter(F.floor(F.col("page_no") * 4 / (last + 1)) == part)
        some.write.mode("append").parquet(source)
        stream = spark.readStream.schema(pages.schema).parquet(source)
        collect_listing(stream, table, progress, NAV_CARDS).awaitTermination()
    return table


def listing_stream(spark, sf):
    return collected(spark, _streamed(spark, sf))


def listing_stream_stop(spark, sf):
    """The stop rule on what the stream has collected."""
    return collected(spark, _streamed(spark, sf), until_stop=True, first_page=0)


# --- the directory's own markup, put around the words of every page -----------------

_VENUE = """
<div data-x="a > b" class="card__menu selection-card"><!-- <div class="card__menu">$2</div> -->
<div class="card__menu-content"><h3 class="card__menu-content--title"><a href='$1?x=/restaurant'>$2</a></h3>
<div class="card__menu-content--distinction"><div></div><img class="x award" src="$1/1star.svg"></div></div>
<div class="card__menu-footer--score">$2</div><div class="card__menu-footer--score">$1 · $2</div></div>"""
_NAV_ITEM = r"<li><a href=\"([^\"]*)\">([^<]*)</a></li>"


def _venues() -> Column:
    """The page's nav words as venue cards."""
    return F.regexp_replace(F.regexp_extract("html", "(?s)<ul>(.*?)</ul>", 1), _NAV_ITEM, _VENUE)


def _directory(spark, sf):
    """Result pages: cards in comments and scripts, and a tail that belongs to no card."""
    ghost = '<div class="card__menu"><h3 class="title">Ghost</h3></div>'
    parts = [
        F.lit(f"<html><body><!-- {ghost} --><script>{ghost}</script>"),
        _venues(),
        F.lit('<div class="card__menu"><h3 class="title">Bare '),
        F.col("page_id").cast("string"),
        F.lit('</h3></div><a href="/x/restaurants/page/2">2</a><footer><h3 class="t-title">About</h3></footer>'),
    ]
    return _numbered(spark, sf).withColumn("html", F.concat(*parts))


def directory_listing(spark, sf):
    return build_listing(_directory(spark, sf), None, first_page=0).drop("pos")


def _directory_details(spark, sf):
    """Detail pages made of each page's heading, footer, paragraphs and nav words."""
    heading = F.concat(F.lit('<div class="data-sheet__block--text">'), F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1), F.lit("</div>"))
    second = F.concat(F.lit('<div class="data-sheet__block--text">'), F.regexp_extract("html", "(?s)<footer>(.*?)</footer>", 1), F.lit("</div>"))
    outside = '<div class="data-sheet__block"><div class="data-sheet__block--text">OUT</div><div class="data-sheet__block--text">O · UT</div></div>'
    hours = F.regexp_replace(
        F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1),
        "(?s)<p>([^<]*)</p>",
        '<div class="card-borderline"><div class="card--title">$1</div><div class="card--content"> 9 &ndash; 5 </div><div class="card--content"></div></div>',
    )
    html = F.concat(
        F.lit(outside + '<div class="data-sheet__detail-info x"><div class="data-sheet__block"><!-- c -->'),
        heading, second,
        F.lit('</div></div>' + outside + '<a href="tel:1"><b>Call</b> '), F.col("page_id").cast("string"),
        F.lit('</a><a href="/span"><span>Visit Website</span></a><div class="data-sheet__description"><div>'),
        F.regexp_extract("html", '(?s)<div class="ad">(.*?)</div>', 1),
        F.lit('</div> more</div>'), hours,
        F.lit('<a data-event="CTA_website" href="/home">w</a><div class="a container-b"><div class="container"><h2>Nearby Restaurants</h2>'),
        _venues(),
        F.lit('</div></div><div class="container"><h2>You may also like</h2><div class="card__menu selection-card">'
              '<h3 class="card__menu-content--title"><a href="/z">Z</a></h3></div></div>'),
    )
    return _pages(spark, sf).withColumn("html", html)


def directory_details(spark, sf):
    details = extract_details(_directory_details(spark, sf), DetailRules(), keep=("page_id",))
    return details.select(
        "page_id",
        "address",
        "phone",
        "description",
        map_to_json(F.col("opening_hours"), spaced=True).alias("opening_hours"),
        "price_range",
        "cuisine_type",
        "website",
        array_to_json(F.col("nearby_restaurants")).alias("nearby"),
    )


QUERIES = {
    "scan_pages": scan_pages,
    "single_page": single_page,
    "single_url": single_url,
    "page_url": page_url_query,
    "page_news": page_news,
    "csv_scan": csv_scan,
    "csv_rejects": csv_rejects,
    "csv_roundtrip": csv_roundtrip,
    "json_roundtrip": json_roundtrip,
    "json_array_roundtrip": json_array_roundtrip,
    "csv_flat_roundtrip": csv_flat_roundtrip,
    "explode_cards": explode_cards_query,
    "cards_fallback": cards_fallback,
    "first_text": first_text,
    "first_attr": first_attr,
    "nth_text": nth_text,
    "award_label": award_label,
    "split_price_cuisine": split_price_cuisine,
    "link_by_text": link_by_text,
    "last_wins_map": last_wins_query,
    "day_map": day_map_query,
    "section_after": section_after,
    "nearby_first_n": nearby_first_n,
    "detail_record": detail_record,
    "fill_sentinels": fill_sentinels_query,
    "dedup_first": dedup_first,
    "append_new": append_new_query,
    "stop_at_gap": stop_at_gap,
    "stop_at_gap_capped": stop_at_gap_capped,
    "slice_rows": slice_rows_query,
    "slice_tail": slice_tail,
    "slice_indexed": slice_indexed,
    "enrich_left": enrich_left,
    "enrich_hot": enrich_hot,
    "enrich_bucketed": enrich_bucketed_query,
    "union_records": union_query,
    "listing_summary": listing_summary,
    "star_breakdown": star_breakdown,
    "top_k_stable": top_k_stable,
    "completeness": completeness,
    "completeness_compat": completeness_compat,
    "page_tallies": page_tallies,
    "map_to_json": map_to_json_query,
    "array_to_json": array_to_json_query,
    "array_join": array_join,
    "build_listing": build_listing_query,
    "build_details": build_details_query,
    "build_details_slice": build_details_slice,
    "two_stage_run": two_stage_run,
    "details_from_csv": details_from_csv,
    "listing_stream": listing_stream,
    "listing_stream_stop": listing_stream_stop,
    "directory_listing": directory_listing,
    "directory_details": directory_details,
}
