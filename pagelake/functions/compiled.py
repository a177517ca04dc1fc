"""Card and detail rules compiled into one SQL expression per page.

All rules of a page are tested in one pass over its tags (see
:mod:`pagelake.functions.elements`); a field is then a look-up among the places found.
Every text is read once, however many cards share it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions.elements import Chain, Tags, ranks, shown
from pagelake.functions.html import ANCHOR, BASE, HREF, Rule, own_text
from pagelake.functions.text import ATTRIBUTE, CONTENT, RESOLVED, VISIBLE, apply, origin_sql, sql_let, sql_text

if TYPE_CHECKING:
    from pagelake.plans.rules import CardRules, DetailRules


def _card_rules(rules: CardRules) -> list:
    fields = [rules.marker, rules.fallback, rules.name, rules.link, rules.award_block, rules.award_sources, rules.score]
    return [rule for rule in fields if rule is not None]


def _with_outer(rules: list) -> list[Rule]:
    return [one for rule in rules for one in ((rule.outer, rule.inner) if rule.outer else (rule,))]


def _structured(rules: list) -> bool:
    return all(isinstance(rule, Rule) and rule.tag for rule in rules)


def cards_compile(rules: CardRules) -> bool:
    """Whether the rules name tags and attributes, as those built by the helpers do."""
    return rules.end is None and rules.marker.__class__ is Rule and rules.marker.whole and _structured(_card_rules(rules))


def _detail_rules(rules: DetailRules) -> list:
    fields = [
        rules.info, rules.block, rules.block_text, rules.heading_item, rules.map_link, rules.phone,
        rules.phone_link, rules.description, rules.old_description, rules.hours_card, rules.day,
        rules.hours, rules.website_link, rules.nearby_heading, rules.nearby_scope,
    ]
    return [rule for rule in fields if rule is not None]


def details_compile(rules: DetailRules) -> bool:
    return (
        rules.hours_end is None
        and _structured(_detail_rules(rules))
        and rules.block.tag == rules.block_child == rules.block_text.tag
        and cards_compile(rules.nearby)
    )


class _Page:
    """A page's tags, its address for links, and the values looked up in them."""

    def __init__(self, page: str, url: str, rules: list[Rule]) -> None:
        self.chain = Chain()
        self.tags = Tags(self.chain, page, [*rules, BASE])
        self.page_url = url
        base = self.tags.points(self.tags.mask(BASE))
        self.base = self.chain.let(f"IF(size({base}) > 0, {self.value(f'get({base}, 0)', BASE)}, NULL)")

    def parts(self, body: str, present: str, none: str) -> list[str]:
        """``body`` in parts, computed for pages with ``present``; the others have ``none``."""
        first, *more = self.chain.parts(body, "t.state")
        parts = [f"CASE WHEN {present} THEN {first} END"]
        parts += [f"CASE WHEN t.state IS NOT NULL THEN {part} END" for part in more]
        parts[-1] = f"CASE WHEN {'t.state IS NOT NULL' if more else present} THEN {(more or [first])[-1]} WHEN t.html IS NOT NULL THEN {none} END"
        return [f"t -> {part}" for part in parts]

    def value(self, place: str, rule: Rule) -> str:
        """SQL of the attribute that the rule reads from one tag, null without it."""
        text = sql_text((rule.inner or rule).pattern)
        return sql_let(
            "w",
            f"regexp_extract({self.tags.piece(place)}, {text}, 0)",
            f"IF(w <> '', regexp_extract(w, {text}, 1), NULL)",
        )

    def links(self, raw: str) -> str:
        """Name of the addresses of raw attribute values."""
        let = self.chain.let
        decoded = let(f"transform(concat(array({self.base}), {raw}), {ATTRIBUTE})")
        base = sql_let("l", f"named_struct('href', get({decoded}, 0), 'page', {self.page_url})", RESOLVED.removeprefix("l -> "))
        own = let(f"coalesce(IF({self.base} IS NULL, NULL, nullif({base}, '')), {self.page_url})")
        site = let(origin_sql(own))
        # Most links begin at the site's root and have no dots to resolve.
        rooted = "startswith(h, '/') AND NOT startswith(h, '//') AND NOT contains(h, '/.')"
        other = sql_let("l", f"named_struct('href', h, 'page', {own})", RESOLVED.removeprefix("l -> "))
        return let(
            f"transform(slice({decoded}, 2, size({decoded})), h -> CASE WHEN {rooted} THEN concat({site}, h) ELSE {other} END)"
        )

    def texts(self, spans: str) -> str:
        """SQL of the raw contents of intervals."""
        return f"transform({spans}, v -> {shown_content(self.tags, 'v.b', 'v.e')})"

    def targets(self, rule: Rule) -> str:
        """Name of the intervals a rule finds, those of its inner elements if it has an outer one."""
        if not rule.outer:
            if rule.kind == "attribute":
                points = self.tags.points(self.tags.mask(rule))
                return self.chain.let(f"transform({points}, v -> named_struct('b', v, 'e', v + 1))")
            return self.tags.spans(rule)
        outer = self.tags.spans(rule.outer)
        found = self.targets(rule.inner)
        begins = self.chain.let(f"transform({found}, v -> v.b)")
        first = self.tags.first_in(begins, outer)
        return self.chain.let(f"filter(transform({first}, r -> get({found}, r)), v -> v IS NOT NULL)")

    def look_up(self, spans: str, cards: str) -> str:
        """Name of the index, per card, of the first of ``spans`` inside it."""
        begins = self.chain.let(f"transform({spans}, v -> v.b)")
        return self.chain.let(self.tags.first_in(begins, cards))

    def cards(self, rules: CardRules, cards: str) -> str:
        """SQL of the records of the intervals ``cards``, in order.

        A record has the raw parts of a card's fields; its name is null if there is none.
        """
        let, tags = self.chain.let, self.tags
        names, links, scores = (self.targets(rule) for rule in (rules.name, rules.link, rules.score))
        rule = VISIBLE if rules.rendered else CONTENT
        texts = let(f"transform(concat({self.texts(names)}, {self.texts(scores)}), {rule})")
        urls = self.links(f"transform({links}, v -> {self.value('v.b', rules.link)})")
        blocks = cards if rules.award_block is None else self.targets(rules.award_block)
        image = tags.mask(rules.award_sources)
        inside = f"slice({tags.numbers}, CAST(v.b + 2 AS INT), CAST(v.e - v.b - 1 AS INT))"
        srcs = (
            f"transform(filter({inside}, n -> (n & {image}L) = {image}L), "
            f"n -> {self.value('shiftright(n, 32)', rules.award_sources)})"
        )
        star, bib = sql_text(rules.star), sql_text(rules.bib)
        counted = (
            f"named_struct('stars', size(filter(a, s -> contains(s, {star}))), "
            f"'bib', exists(a, s -> contains(s, {bib}) AND NOT contains(s, {star})))"
        )
        awards = let(f"transform({blocks}, v -> {sql_let('a', srcs, counted)})")
        name, link, score = (self.look_up(found, cards) for found in (names, links, scores))
        award = "k" if rules.award_block is None else f"get({self.look_up(blocks, cards)}, k)"
        second = f"IF(get({scores}, get({score}, k) + 1).b < v.e, get({texts}, size({names}) + get({score}, k) + 1), NULL)"
        return (
            f"transform({cards}, (v, k) -> named_struct('name', get({texts}, get({name}, k)), "
            f"'url', get({urls}, get({link}, k)), 'stars', coalesce(get({awards}, {award}).stars, 0), "
            f"'bib', coalesce(get({awards}, {award}).bib, false), "
            f"'location', get({texts}, size({names}) + get({score}, k)), 'pair', {second}))"
        )


def shown_content(tags: Tags, begin: str, end: str) -> str:
    return sql_let("z", tags.content(begin, end), shown("z"))


def read(pages: DataFrame, parts: list[str], keep: Sequence[str], name: str) -> DataFrame:
    """The columns ``keep`` of the pages, and as ``name`` what the parts lead to."""
    state = F.lit(None).alias("state")
    columns = dict.fromkeys([*keep, "html", "url"])
    for part in parts:
        page = apply(F.struct("html", "url", state), part).alias(name)
        pages = pages.select(*columns, page)
        state = F.col(name).alias("state")
    return pages.select(*keep, name)


CARD = "ARRAY<STRUCT<name: STRING, url: STRING, stars: INT, bib: BOOLEAN, location: STRING, pair: STRING>>"


def compiled_cards(rules: CardRules) -> list[str]:
    """Lambdas that lead from a page to the raw records of its cards (see :func:`read`)."""
    page = _Page("t.html", "t.url", _with_outer(_card_rules(rules)))
    cards = page.tags.spans(rules.marker, "next")
    marks = rules.marker.marks
    if rules.fallback is not None:
        other = page.tags.outermost(page.tags.spans(rules.fallback))
        cards = page.chain.let(f"IF(size({cards}) > 0, {cards}, {other})")
        marks += rules.fallback.marks
    present = " OR ".join(f"contains(t.html, {sql_text(mark)})" for mark in marks) or "true"
    return page.parts(page.cards(rules, cards), present, f"CAST(array() AS {CARD})")


def compiled_details(rules: DetailRules) -> list[str]:
    """Lambdas that lead from a page to its raw fields (see :func:`read`)."""
    nearby = rules.nearby
    page = _Page("t.html", "t.url", [*_with_outer(_detail_rules(rules) + _card_rules(nearby)), ANCHOR])
    tags, let = page.tags, page.chain.let

    # The info blocks: the n-th child of a block, if it is a text element.
    infos = tags.outermost(tags.spans(rules.info, "page"))
    blocks = tags.spans(rules.block, "page")
    starts = let(f"transform({blocks}, v -> v.b)")
    inside = tags.first_in(starts, infos)
    last = ranks(starts, f"transform({infos}, v -> v.e)")
    held = let(f"flatten(zip_with({inside}, {last}, (r, s) -> IF(r IS NULL, array(), slice({blocks}, r + 1, s - r))))")
    kind = tags.opens[rules.block.tag] | tags.closes[rules.block.tag]
    own = f"filter(slice({tags.numbers}, CAST(v.b + 2 AS INT), CAST(v.e - v.b - 1 AS INT)), n -> (n & {kind}L) <> 0)"
    # Openings at depth 0 within the block: the k-th opening at index j is 2k - j deep.
    opened = f"filter(transform(d, (n, j) -> IF((n & {tags.opens[rules.block.tag]}L) <> 0, j, -1)), j -> j >= 0)"
    children = sql_let(
        "d", own,
        f"transform(filter(transform({opened}, (j, k) -> IF(2 * k = j, j, -1)), j -> j >= 0), j -> get(d, j))",
    )
    grown = let(f"transform({held}, v -> slice({children}, 1, 2))")
    texts = tags.spans(rules.block_text)
    places = let(f"transform({texts}, v -> v.b)")
    text = tags.mask(rules.block_text)

    def info(n: int) -> str:
        fit = f"filter(transform({grown}, g -> get(g, {n})), n -> (n & {text}L) = {text}L)"
        at = let(f"array_position({places}, shiftright(get({fit}, 0), 32))")
        return f"IF({at} > 0, get({texts}, CAST({at} - 1 AS INT)), NULL)"

    def first(rule: Rule) -> str:
        return f"get({page.targets(rule)}, 0)"

    items = tags.spans(rules.heading_item)

    def in_item(rule: Rule) -> str:
        links = page.targets(rule)
        index = page.look_up(links, items)
        return f"get({links}, get(filter({index}, r -> r IS NOT NULL), 0))"

    address = f"coalesce({info(0)}, {in_item(rules.map_link)})"
    phone = f"coalesce({first(rules.phone)}, {in_item(rules.phone_link)})"
    description = f"coalesce({first(rules.description)}, {first(rules.old_description)})"
    single = let(f"array({address}, {phone}, {description}, {info(1)})")

    # Opening hours: per card its day and all its hours.
    hours_cards = tags.spans(rules.hours_card, "next")
    days, hours = page.targets(rules.day), tags.outermost(page.targets(rules.hours))
    begins = let(f"transform({hours}, v -> v.b)")
    day = page.look_up(days, hours_cards)
    begin = let(ranks(begins, f"transform({hours_cards}, v -> v.b + 1)"))
    end = let(ranks(begins, f"transform({hours_cards}, v -> v.e)", in_order=False))
    shown_texts = let(
        f"transform(concat(transform({single}, v -> IF(v IS NULL, NULL, {shown_content(tags, 'v.b', 'v.e')})), "
        f"{page.texts(days)}, {page.texts(hours)}), {VISIBLE})"
    )
    before = let(f"4 + size({days})")
    entries = (
        f"transform({hours_cards}, (v, k) -> named_struct('day', get({shown_texts}, 4 + get({day}, k)), "
        f"'hours', slice({shown_texts}, {before} + get({begin}, k) + 1, greatest(get({end}, k) - get({begin}, k), 0))))"
    )

    # The website: the first link whose own text holds the words.
    anchors = page.targets(ANCHOR)
    words = sql_text(rules.website_text)
    named = (
        f"get(filter({anchors}, v -> exists(slice({tags.pieces}, CAST(v.b + 1 AS INT), CAST(v.e - v.b AS INT)), "
        f"s -> contains(s, {words})) AND concat({tags.content('v.b', 'v.e')}, '</a>') RLIKE {sql_text('^' + own_text(rules.website_text).replace('GROUP', '1'))}), 0)"
    )
    site = let(f"IF(contains(t.html, {words}), {named}, NULL)")
    other = tags.points(tags.mask(rules.website_link))
    website = (
        f"IF({site} IS NOT NULL, {page.value(f'{site}.b', HREF)}, "
        f"IF(size({other}) > 0, {page.value(f'get({other}, 0)', rules.website_link)}, NULL))"
    )
    website = page.links(f"array({website})")

    # Nearby venues: the cards of the outermost container of the first heading.
    heading = let(f"get({tags.points(tags.mask(rules.nearby_heading))}, 0)")
    if rules.nearby_scope is None:
        scope = let(f"named_struct('b', {heading}, 'e', {tags.size})")
    else:
        containers = tags.spans(rules.nearby_scope, "page")
        scope = let(f"get(filter({containers}, v -> v.b < {heading} AND v.e > {heading}), 0)")
    cards = tags.spans(nearby.marker, "next")
    near = let(
        f"slice(filter({cards}, v -> {scope}.b IS NOT NULL AND v.b > {scope}.b AND v.b < {scope}.e), 1, {rules.nearby_limit})"
    )
    venues = page.cards(nearby, near)
    texts = ", ".join(f"'{name}', get({shown_texts}, {n})" for n, name in enumerate(("address", "phone", "description", "second")))
    body = f"named_struct({texts}, 'hours', {entries}, 'website', nullif(get({website}, 0), ''), 'nearby', {venues})"
    return page.parts(body, "t.html IS NOT NULL", "NULL")
