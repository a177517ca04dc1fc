"""Extraction rules for listing cards and detail pages.

The defaults describe the markup of the venue directory. Every mark is a field, so
another markup is another instance, not other code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pagelake.functions import html as h

# Class names, attribute marks and headings of the directory's pages.
CARD_CLASS = "card__menu"
AWARD_CLASS = "award"  # of award images; the directory's own name goes here
NEARBY_CARD_CLASS = "selection-card"
CARD_LINK_TRACK = "restaurant"
VENUE_PATH = "/restaurant"
TITLE_PART = "title"
NEARBY_TITLE_CLASS = "card__menu-content--title"
AWARD_BLOCK_CLASS = "card__menu-content--distinction"
SCORE_CLASS = "card__menu-footer--score"
DETAIL_INFO_CLASS = "data-sheet__detail-info"
DETAIL_BLOCK_CLASS = "data-sheet__block"
DETAIL_TEXT_CLASS = "data-sheet__block--text"
HEADING_ITEM_CLASS = "restaurant-details__heading--list-item"
DESCRIPTION_CLASSES = ("restaurant-details__description--text", "data-sheet__description")
OLD_DESCRIPTION_CLASS = "restaurant-details__description"
HOURS_CLASSES = ("restaurant-details__components", "card-borderline")
DAY_CLASS = "card--title"
HOURS_CLASS = "card--content"
NEARBY_HEADING = "Nearby Restaurants"
NEARBY_SCOPE = "container"
WEBSITE_TEXT = "Visit Website"
PHONE_EVENT = "CTA_tel"
WEBSITE_EVENT = "CTA_website"

Pattern = str | h.Rule


@dataclass(frozen=True)
class CardRules:
    """How to read the seven fields of a card."""

    marker: Pattern = h.block("div", h.attr_contains("class", CARD_CLASS))
    fallback: Pattern | None = h.element("a", h.attr_contains("data-track", CARD_LINK_TRACK))
    end: str | None = None
    name: Pattern = h.element("h3", h.attr_contains("class", TITLE_PART))
    link: Pattern = h.attribute("a", "href", h.attr_contains("href", VENUE_PATH))
    award_block: Pattern | None = h.element("div", h.has_class(AWARD_BLOCK_CLASS))
    award_class: str = AWARD_CLASS
    award_src: Pattern | None = None  # None: sources of images with the award class
    score: Pattern = h.element("div", h.has_class(SCORE_CLASS))
    star: str = "1star.svg"
    bib: str = "bib-gourmand.svg"
    label_mode: str = "bib_first"
    rendered: bool = True  # visible text; False keeps inner white space

    @property
    def award_sources(self) -> Pattern:
        return self.award_src or h.attribute("img", "src", h.has_class(self.award_class))


_TITLE = h.opening("h3", h.has_class(NEARBY_TITLE_CLASS))

NEARBY_CARDS = CardRules(
    marker=h.block("div", h.has_class(CARD_CLASS), h.has_class(NEARBY_CARD_CLASS)),
    fallback=None,
    name=h.inside(_TITLE, h.element("a")),
    link=h.inside(_TITLE, h.attribute("a", "href")),
    star="1star",
    bib="bib-gourmand",
    label_mode="stars_first",
    rendered=False,
)


@dataclass(frozen=True)
class DetailRules:
    """How to read a detail page."""

    info: Pattern = h.region("div", h.has_class(DETAIL_INFO_CLASS))
    block: h.Rule = h.opening("div", h.has_class(DETAIL_BLOCK_CLASS))
    block_child: str = "div"
    block_text: h.Rule = h.element("div", h.has_class(DETAIL_TEXT_CLASS))
    heading_item: Pattern = h.element("li", h.attr_contains("class", HEADING_ITEM_CLASS))
    map_link: Pattern = h.element("a", h.attr_contains("href", "maps"))
    phone: Pattern = h.element(
        "a", h.any_of(h.attr_starts("href", "tel:"), h.attr_equals("data-event", PHONE_EVENT))
    )
    phone_link: Pattern = h.element("a", h.attr_contains("href", "tel:"))
    description: Pattern = h.element("div", h.any_of(*map(h.has_class, DESCRIPTION_CLASSES)))
    old_description: Pattern = h.element("div", h.has_class(OLD_DESCRIPTION_CLASS))
    hours_card: Pattern = h.block("div", h.any_of(*map(h.has_class, HOURS_CLASSES)))
    hours_end: str | None = None
    day: Pattern = h.element("div", h.has_class(DAY_CLASS))
    hours: Pattern = h.element("div", h.has_class(HOURS_CLASS))
    website_text: str = WEBSITE_TEXT
    website_link: Pattern = h.attribute("a", "href", h.attr_equals("data-event", WEBSITE_EVENT))
    nearby_heading: Pattern = h.opening_before("h2", NEARBY_HEADING)
    # The part of the page that holds the heading and its cards; None: all behind it.
    nearby_scope: Pattern | None = h.region("div", h.attr_contains("class", NEARBY_SCOPE))
    nearby: CardRules = NEARBY_CARDS
    nearby_limit: int = 9


LISTING_CARDS = CardRules()
DETAILS = DetailRules()
