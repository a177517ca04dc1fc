"""Pages to cards and cards to records. Everything here is narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import html as h
from pagelake.functions.compiled import cards_compile, compiled_cards, compiled_details, details_compile, read
from pagelake.functions.nested import map_last_wins
from pagelake.functions.text import CONTENT, VISIBLE, apply_all, let
from pagelake.functions.values import MISSING, award_flags, distinction, split_pair
from pagelake.plans.rules import CardRules, DetailRules
from pagelake.schemas import NEARBY

PRICE_SEPARATOR = "·"
DETAIL_SEPARATOR = " · "


def explode_cards(
    pages: DataFrame,
    marker: str | h.Rule,
    fallback: str | h.Rule | None = None,
    end: str | None = None,
    keep: tuple[str, ...] = ("page_no", "url"),
    html: str = "html",
    outer: bool = False,
) -> DataFrame:
    """One row per card: the kept columns, ``pos`` (from 0) and the fragment ``frag``.

    ``outer`` keeps pages without cards as one row with a null ``pos``.
    """
    cards = h.split_cards(h.without_hidden(F.col(html)), marker, fallback, end)
    cut = F.posexplode_outer if outer else F.posexplode
    return pages.select(*keep, cut(cards).alias("pos", "frag"))


def card_record(frag: Column, page_url: Column, rules: CardRules) -> Column:
    """The seven fields of one card as a struct, null for a card without a name."""
    rule = VISIBLE if rules.rendered else CONTENT

    def named(name: Column) -> Column:
        scores = let(
            h.all_matches(frag, rules.score),
            lambda found: apply_all(F.array(F.get(found, 0), F.get(found, 1)), rule),
        )
        block = frag if rules.award_block is None else h.first_match(frag, rules.award_block)
        srcs = F.coalesce(h.all_matches(block, rules.award_sources), F.array().cast("array<string>"))

        def awards(found: Column) -> Column:
            stars, bib = award_flags(found, rules.star, rules.bib)
            return F.struct(stars.alias("stars"), bib.alias("bib"))

        def record(part: Column) -> Column:
            stars, bib = part["award"]["stars"], part["award"]["bib"]
            price, cuisine = split_pair(F.get(part["texts"], 1), PRICE_SEPARATOR, "left", trim=True)
            return F.struct(
                name.alias("name"),
                h.first_attr(frag, rules.link, page_url).alias("url"),
                stars.alias("stars"),
                distinction(stars, bib, rules.label_mode).alias("distinction"),
                F.get(part["texts"], 0).alias("location"),
                price.alias("price"),
                cuisine.alias("cuisine"),
            )

        return let(F.struct(scores.alias("texts"), let(srcs, awards).alias("award")), record)

    found = apply_all(F.array(h.first_match(frag, rules.name)), rule)
    missing = lambda name: name.isNull() | name.isin("", MISSING)
    return let(F.get(found, 0), lambda name: F.when(~missing(name), named(name)))


def finished(raw: Column, rules: CardRules) -> Column:
    """The seven fields from a compiled card's raw parts, null for a card without a name."""
    price, cuisine = split_pair(raw["pair"], PRICE_SEPARATOR, "left", trim=True)
    record = F.struct(
        raw["name"].alias("name"),
        raw["url"].alias("url"),
        raw["stars"].alias("stars"),
        distinction(raw["stars"], raw["bib"], rules.label_mode).alias("distinction"),
        raw["location"].alias("location"),
        price.alias("price"),
        cuisine.alias("cuisine"),
    )
    return F.when(raw["name"].isNotNull() & ~raw["name"].isin("", MISSING), record)


def listing_cards(pages: DataFrame, rules: CardRules, outer: bool = False) -> DataFrame:
    """Cards of result pages as records in listing form; nameless ones have no fields.

    Records are built inside the page's row and exploded afterwards, so a later
    filter on ``name`` reads a finished field instead of repeating the extraction.
    """
    cut = F.posexplode_outer if outer else F.posexplode
    if cards_compile(rules):
        pages = read(pages, compiled_cards(rules), ["page_no"], "_cards")
        records = F.transform("_cards", lambda raw: finished(raw, rules))
    else:
        page = h.without_hidden(F.col("html"))
        frags = h.split_cards(page, rules.marker, rules.fallback, rules.end)
        records = F.transform(frags, lambda frag: card_record(frag, F.col("url"), rules))
    return pages.select("page_no", cut(records).alias("pos", "card")).select(
        "page_no", "pos", "card.*"
    )


def require(df: DataFrame, column: str = "name") -> DataFrame:
    """Drop rows whose ``column`` is missing or empty."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def nearby_array(
    html: Column,
    page_url: Column,
    heading: str | h.Rule,
    rules: CardRules,
    limit: int = 9,
    scope: str | h.Rule | None = None,
) -> Column:
    """The first ``limit`` cards of the heading's section as an array of records.

    The section is the outermost ``scope`` element that holds the heading, without a
    scope all that follows the heading. Cards are cut off before those without a title
    are dropped; null if none is left.
    """

    def record(frag: Column) -> Column:
        return let(
            card_record(frag, page_url, rules),
            lambda card: F.when(
                card.isNotNull(), F.struct(*[card[n].alias(n) for n in NEARBY.fieldNames()])
            ),
        )

    def records(section: Column) -> Column:
        cards = F.slice(h.split_cards(section, rules.marker, rules.fallback, rules.end), 1, limit)
        return F.filter(F.transform(cards, record), lambda c: c.isNotNull())

    section = h.section_after(html, heading) if scope is None else h.within(html, scope, heading)
    found = let(let(section, records), lambda cards: F.when(F.size(cards) > 0, cards))
    marks = h.marks_of(heading)
    return F.when(F.greatest(*[F.contains(html, F.lit(m)) for m in marks * 2]), found) if marks else found


def day_map(
    html: Column,
    card: str | h.Rule,
    day: str | h.Rule,
    hours: str | h.Rule,
    end: str | None = None,
) -> Column:
    """Opening hours: day to hours joined by ``, ``; ``closed`` if all are blank.

    Cards without a title or without hours are skipped, a repeated day keeps its
    last value. Null if no day is left.
    """

    def raw(frag: Column) -> Column:
        title = F.array(h.first_match(frag, day))
        return apply_all(F.concat(title, h.all_matches(frag, hours)), VISIBLE)

    def entry(texts: Column) -> Column:
        shown = F.filter(F.slice(texts, 2, F.size(texts)), lambda t: t != "")
        value = F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise(F.lit("closed"))
        return F.struct(F.get(texts, 0).alias("k"), value.alias("v"))

    texts = F.filter(
        F.transform(h.split_cards(html, card, end=end), raw),
        lambda t: (F.size(t) > 1) & (F.get(t, 0) != ""),
    )
    return map_last_wins(F.transform(texts, entry))


def _info_blocks(html: Column, rules: DetailRules) -> Column:
    """Raw (first, second) text of the info blocks, each from the first block that has it."""

    def child(section: Column, n: int) -> Column:
        return h.first_match(
            section, h.nth_child(rules.block, rules.block_child, n, rules.block_text)
        )

    return let(
        F.array_join(h.all_matches(html, rules.info, 0), " "),
        lambda section: F.array(child(section, 0), child(section, 1)),
    )


def _compiled_details(pages: DataFrame, rules: DetailRules, keep: tuple[str, ...]) -> DataFrame:
    """:func:`extract_details` for rules that compile."""
    page = F.col("_page")

    def entry(card: Column) -> Column:
        shown = F.filter(card["hours"], lambda t: t != "")
        value = F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise(F.lit("closed"))
        return F.struct(card["day"].alias("k"), value.alias("v"))

    def venue(raw: Column) -> Column:
        card = finished(raw, rules.nearby)
        return F.when(card.isNotNull(), F.struct(*[card[n].alias(n) for n in NEARBY.fieldNames()]))

    days = F.filter(page["hours"], lambda card: (F.size(card["hours"]) > 0) & (card["day"] != ""))
    venues = F.filter(F.transform(page["nearby"], venue), lambda card: card.isNotNull())
    price_range, cuisine_type = split_pair(page["second"], DETAIL_SEPARATOR, missing="right")
    pages = pages.filter(F.col("html").isNotNull())
    return (
        read(pages, compiled_details(rules), [*keep, "url"], "_page")
        .select(
            *keep,
            "url",
            page["address"].alias("address"),
            page["phone"].alias("phone"),
            page["description"].alias("description"),
            map_last_wins(F.transform(days, entry)).alias("opening_hours"),
            price_range.alias("price_range"),
            cuisine_type.alias("cuisine_type"),
            page["website"].alias("website"),
            let(venues, lambda cards: F.when(F.size(cards) > 0, cards)).alias("nearby_restaurants"),
        )
    )


def extract_details(pages: DataFrame, rules: DetailRules, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per detail page: ``url`` and the eight extracted fields.

    The page is cut into its few regions first, each in a column of its own; the rules
    for links run on the page's links only. Whether a fallback applies is decided on the
    raw matches, then one rule turns them all into text.
    """
    if details_compile(rules):
        return _compiled_details(pages, rules, keep)
    html, url, links = F.col("_html"), F.col("url"), F.col("_links")
    heading = [h.first_within(html, rules.heading_item, r) for r in (rules.map_link, rules.phone_link)]
    raw = F.array(
        F.coalesce(F.get("_info", 0), heading[0]),
        F.coalesce(h.first_match(links, rules.phone), heading[1]),
        h.first_of(html, rules.description, rules.old_description),
        F.get("_info", 1),
    )
    address, phone, description, second = (F.get("_texts", n) for n in range(4))
    price_range, cuisine_type = split_pair(second, DETAIL_SEPARATOR, missing="right")
    nearby = nearby_array(
        html, url, rules.nearby_heading, rules.nearby, rules.nearby_limit, rules.nearby_scope
    )
    return (
        pages.filter(F.col("html").isNotNull())
        .select(*keep, url, h.without_hidden(F.col("html")).alias("_html"))
        .select(
            *keep,
            url,
            html,
            F.array_join(h.all_matches(html, h.element("a"), 0), "").alias("_links"),
            _info_blocks(html, rules).alias("_info"),
        )
        .select(
            *keep,
            url,
            apply_all(raw, VISIBLE).alias("_texts"),
            day_map(html, rules.hours_card, rules.day, rules.hours, rules.hours_end).alias(
                "opening_hours"
            ),
            h.link_by_text(links, rules.website_text, rules.website_link, url).alias("website"),
            nearby.alias("nearby_restaurants"),
        )
        .select(
            *keep,
            "url",
            address.alias("address"),
            phone.alias("phone"),
            description.alias("description"),
            "opening_hours",
            price_range.alias("price_range"),
            cuisine_type.alias("cuisine_type"),
            "website",
            "nearby_restaurants",
        )
    )
