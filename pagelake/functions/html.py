"""Extraction rules over raw HTML.

A rule is a regular expression whose group 1 is the wanted part. The helpers below build
rules from tag names and attribute conditions; the extractors turn a rule into one column
expression. In a tag, quoted values may hold any character; outside of quotes there is no
"<", so an unclosed tag ends at the next one and the search stays linear on broken pages.
Elements that may hold others of their name end at their own closing tag, which is found
in the page's tags (see :mod:`pagelake.functions.elements`). A rule may carry marks, plain texts one of which every match contains: a page without any of them is
not searched further, and looking for a plain text is far cheaper than running an
expression.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.elements import NESTING, REST, Chain, Tags, hidden
from pagelake.functions.text import (
    VISIBLE,
    apply,
    apply_all,
    decode_entities,
    let,
    resolve_url,
    sql_let,
    sql_text,
    visible_text,
)


class Rule(NamedTuple):
    """A pattern and its marks; a plain string is a rule without marks.

    ``whole`` rules match entire elements, and elements inside a match are matches too.
    Rules from the helpers below also tell their tag, a pattern of the opening tag alone
    and their kind; one made by :func:`inside` has the rules it is made of.
    """

    pattern: str
    marks: tuple[str, ...] = ()
    whole: bool = False
    tag: str = ""
    test: str = ""
    kind: str = ""
    outer: Rule | None = None
    inner: Rule | None = None


class Condition(NamedTuple):
    """A pattern for part of an opening tag and the marks it implies."""

    pattern: str
    marks: tuple[str, ...]


def _rule(rule: str | Rule) -> Rule:
    return Rule(rule) if isinstance(rule, str) else rule


def _before(attr: str) -> str:
    """Pattern of a tag's part before its first attribute of this name."""
    return rf"""(?:[^<>"'\s]++|\s(?!(?i:{attr})\s*=)|"[^"]*+"|'[^']*+')*+\s(?i:{attr})\s*=\s*"""


def marks_of(rule: str | Rule) -> tuple[str, ...]:
    return _rule(rule).marks


def _condition(attr: str, value: str, double: str, single: str, bare: str) -> Condition:
    """One pattern per way to quote; ``VALUE`` stands for the wanted text."""
    ways = f"(?:\"{double}|'{single}|{bare})".replace("VALUE", re.escape(value))
    return Condition(f"(?={_before(attr)}{ways})", (value,))


def has_class(name: str) -> Condition:
    """The class list holds exactly this name."""
    return _condition(
        "class",
        name,
        r"(?:[^\"]*\s)?VALUE(?=[\s\"])",
        r"(?:[^']*\s)?VALUE(?=[\s'])",
        r"VALUE(?=[\s>])",
    )


def attr_contains(attr: str, value: str) -> Condition:
    """The attribute contains this text."""
    return _condition(attr, value, r"[^\"]*?VALUE", r"[^']*?VALUE", r"[^\s\"'<>]*?VALUE")


def attr_starts(attr: str, value: str) -> Condition:
    """The attribute starts with this text."""
    return _condition(attr, value, "VALUE", "VALUE", "VALUE")


def attr_equals(attr: str, value: str) -> Condition:
    """The attribute equals this text."""
    return _condition(attr, value, 'VALUE"', "VALUE'", r"VALUE(?=[\s>])")


def any_of(*conditions: Condition) -> Condition:
    """At least one of the conditions holds."""
    return Condition(
        "(?:" + "|".join(c.pattern for c in conditions) + ")",
        tuple(mark for c in conditions for mark in c.marks),
    )


def _marks(conditions: tuple[Condition, ...]) -> tuple[str, ...]:
    return conditions[0].marks if conditions else ()


def _checks(conditions: tuple[Condition, ...]) -> str:
    return "".join(c.pattern for c in conditions)


def opening(tag: str, *conditions: Condition) -> Rule:
    """An opening tag that meets all conditions (no group)."""
    pattern = rf"<(?i:{tag})(?=[\s/>]){_checks(conditions)}{REST}>"
    return Rule(pattern, _marks(conditions), tag=tag, test=pattern, kind="opening")


def opening_before(tag: str, text: str) -> Rule:
    """An opening tag whose own first text holds ``text`` (no group)."""
    pattern = f"{opening(tag).pattern}[^<]*{re.escape(text)}"
    return Rule(pattern, (text,), tag=tag, test=pattern, kind="opening")


def up_to(stop: str) -> str:
    """Pattern of text up to the next match of ``stop``, which starts with ``<``.

    Only ``<`` characters are tested against ``stop``, and the loop is possessive:
    it neither backtracks nor recurses, however long the text is.
    """
    return f"[^<]*+(?:(?!{stop})<[^<]*+)*+"


def _closed(tag: str, conditions: tuple[Condition, ...], kind: str) -> Rule:
    """A rule for elements; its pattern ends at the first closing tag, whatever lies inside."""
    start, close = opening(tag, *conditions), rf"</(?i:{tag})\s*>"
    ends = {"element": close, "region": rf"(?:{close}|\z)", "block": f"(?:{close}|(?={start.pattern}))"}
    content = up_to(close) if kind != "block" else up_to(f"(?:{close}|{start.pattern})")
    return start._replace(pattern=f"{start.pattern}({content}){ends[kind]}", kind=kind, whole=kind == "block")


def element(tag: str, *conditions: Condition) -> Rule:
    """An element; group 1 is its content up to its own closing tag.

    One that has none ends at the first closing tag.
    """
    return _closed(tag, conditions, "element")


def region(tag: str, *conditions: Condition) -> Rule:
    """An element up to its own closing tag, or to the page's end if it is not closed."""
    return _closed(tag, conditions, "region")


def block(tag: str, *conditions: Condition) -> Rule:
    """Whole elements, also those inside one another, in the order of their openings.

    An element that is not closed ends where the next of its kind begins.
    """
    return _closed(tag, conditions, "block")


def attribute(tag: str, name: str, *conditions: Condition) -> Rule:
    """An opening tag; group 1 is the value of one attribute, quoted or bare."""
    value = r"""(?<=\")[^\"]*(?=\")|(?<=')[^']*(?=')|(?<=[=\s])[^\s\"'<>]+"""
    start = rf"<(?i:{tag})(?=\s){_checks(conditions)}{_before(name)}"
    test = rf"<(?i:{tag})(?=\s){_checks(conditions)}(?={_before(name)}){REST}>"
    return Rule(rf"{start}[\"']?({value})[\"']?", _marks(conditions), tag=tag, test=test, kind="attribute")


def after(first: Rule, gap: str, second: Rule) -> Rule:
    """``second`` right behind ``first`` and a gap; the groups are those of ``second``."""
    return first._replace(pattern=first.pattern + gap + second.pattern)


def inside(outer: Rule, inner: Rule) -> Rule:
    """The first ``inner`` inside each ``outer`` element; as a pattern, right behind its opening."""
    both = after(outer, "[^<]*", inner)
    return both._replace(tag=inner.tag, test=inner.test, kind=inner.kind, outer=outer, inner=inner)


def nth_child(parent: Rule, tag: str, n: int, child: Rule) -> Rule:
    """``child`` as the n-th (from 0) element ``tag`` inside ``parent``."""
    skip = up_to(rf"<(?i:{tag})(?=[\s/>])")
    close = rf"</(?i:{tag})\s*>"
    earlier = f"{skip}{opening(tag).pattern}{up_to(close)}{close}" * n
    return after(parent, earlier + skip, child)


BASE = attribute("base", "href")
ANCHOR = element("a")
HREF = attribute("a", "href")


def without_hidden(html: Column) -> Column:
    """The page without comments and without elements that hold no elements, such as scripts."""
    return F.regexp_replace(html, "<" + hidden(), "")


def _search(html: Column, rule: Rule, body: str, none: str) -> Column:
    """Apply the SQL ``body`` over ``t``, the page, if it has a mark of the rule."""
    if rule.marks:
        present = " OR ".join(f"contains(t, {sql_text(mark)})" for mark in rule.marks)
        body = f"CASE WHEN {present} THEN {body} WHEN t IS NOT NULL THEN {none} END"
    return apply(html, f"t -> {body}")


def _nests(rule: Rule) -> bool:
    return rule.kind in ("element", "region", "block") and rule.tag in NESTING and rule.outer is None


def _elements(rule: Rule, group: int, nested: bool = False) -> str:
    """SQL over ``t`` for the elements a rule finds: their content (1) or all of them (0).

    With ``nested`` elements inside others count as well.
    """
    chain = Chain()
    tags = Tags(chain, "t", [rule])
    ends = {"element": "first", "region": "page", "block": "next"}[rule.kind]
    spans = tags.spans(rule, ends)
    if not nested:
        spans = tags.outermost(spans)
    text = tags.content("v.b", "v.e") if group else tags.whole("v.b", "v.e", rule.tag)
    return chain.sql(f"transform({spans}, v -> {text})")


def first_match(html: Column, rule: str | Rule, group: int = 1) -> Column:
    """Group of the first match: null if nothing matches, '' if the group is empty.

    The scan ends at the first match. The pattern must consume text and must not
    look beyond its own match.
    """
    rule = _rule(rule)
    if _nests(rule):
        return _search(html, rule, f"get({_elements(rule, group)}, 0)", "NULL")
    text = sql_text(rule.pattern)
    found = sql_let(
        "m", f"regexp_extract(t, {text}, 0)", f"IF(m <> '', regexp_extract(m, {text}, {group}), NULL)"
    )
    return _search(html, rule, found, "NULL")


def all_matches(html: Column, rule: str | Rule, group: int = 1) -> Column:
    """Group of every match, in order."""
    rule = _rule(rule)
    found = f"regexp_extract_all(t, {sql_text(rule.pattern)}, {group})"
    if _nests(rule):
        found = _elements(rule, group)
    return _search(html, rule, found, "CAST(array() AS ARRAY<STRING>)")


def first_of(html: Column, *rules: str | Rule) -> Column:
    """Raw first match of the first rule that matches at all."""
    return F.coalesce(*[first_match(html, rule) for rule in rules])


def nth_of(html: Column, rule: str | Rule, n: int) -> Column:
    """Raw n-th match (from 0), null if there are fewer."""
    return first_match(html, rule) if n == 0 else F.get(all_matches(html, rule), n)


def first_within(html: Column, outer: str | Rule, inner: str | Rule) -> Column:
    """Raw first ``inner`` match that lies within an ``outer`` match."""
    found = F.filter(
        F.transform(all_matches(html, outer), lambda part: first_match(part, inner)),
        lambda part: part.isNotNull(),
    )
    return F.get(found, 0)


def first_text(html: Column, *rules: str | Rule) -> Column:
    """Visible text of the first match of the first rule that matches at all."""
    return visible_text(first_of(html, *rules))


def nth_text(html: Column, rule: str | Rule, n: int) -> Column:
    """Visible text of the n-th match (from 0), null if there are fewer."""
    return visible_text(nth_of(html, rule, n))


def visible_texts(*raw: Column) -> Column:
    """Visible texts of several raw matches as an array, with one rule for all."""
    return apply_all(F.array(*raw), VISIBLE)


def link(raw: Column, page_url: Column | None = None) -> Column:
    """A raw attribute value, decoded; with ``page_url`` as an absolute link."""
    value = decode_entities(raw, attribute=True)
    return value if page_url is None else resolve_url(value, page_url)


def first_attr(html: Column, rule: str | Rule, page_url: Column | None = None) -> Column:
    """First attribute value, decoded; with ``page_url`` as an absolute link."""
    return link(first_match(html, rule), page_url)


def own_text(text: str) -> str:
    """Pattern of a content whose own first text holds ``text``; elements before it are passed over."""
    child = rf"<((?i:[a-z][a-z0-9]*))(?=[\s/>]){REST}>[^<]*+(?:(?!</(?i:\GROUP)\s*>)<[^<]*+)*+</(?i:\GROUP)\s*>"
    empty = rf"<(?i:br|img|input|wbr)(?=[\s/>]){REST}>"
    return rf"(?:{empty}|{child})*+[^<]*{re.escape(text)}"


def link_by_text(html: Column, text: str, fallback: str | Rule, page_url: Column) -> Column:
    """Target of the first link whose text contains ``text``.

    ``fallback`` is used only if there is no such link; an empty target is missing
    and does not reach the fallback.
    """
    anchor = Rule(f"({opening('a').pattern}){own_text(text).replace('GROUP', '2')}", (text,))

    def target(opened: Column) -> Column:
        named = first_match(opened, HREF)
        return F.when(opened.isNotNull(), named).otherwise(first_match(html, fallback))

    found = let(first_match(html, anchor), target)
    return let(link(found, page_url), lambda url: F.when(url != "", url))


def section_after(html: Column, heading: str | Rule) -> Column:
    """What follows the first heading that matches, null without one."""
    rule = _rule(heading)
    return _search(html, rule, f"get(split(t, {sql_text(rule.pattern)}, 2), 1)", "NULL")


def within(html: Column, scope: str | Rule, heading: str | Rule) -> Column:
    """The first outermost ``scope`` match that holds ``heading``, null without one."""
    return F.get(
        F.filter(all_matches(html, scope, 0), lambda part: first_match(part, heading, 0).isNotNull()), 0
    )


def split_cards(
    html: Column,
    marker: str | Rule,
    fallback: str | Rule | None = None,
    end: str | None = None,
) -> Column:
    """Cut a page into the fragments that start with ``marker``, in one pass.

    Fragments of a whole rule (see :func:`block`) are its elements. Those of any other
    run to the next marker or ``end``, or to the end of the page; both are patterns that
    start with a literal ``<``. ``fallback`` is an element rule used only if the marker
    never occurs.
    """
    rule = _rule(marker)
    pattern = rule.pattern
    if not pattern.startswith("<"):
        raise ValueError(f"a marker starts with <: {pattern}")
    if rule.whole and _nests(rule):
        parts = _search(html, rule, _elements(rule, 0, nested=True), "CAST(array() AS ARRAY<STRING>)")
    elif rule.whole:
        # Only the bracket is consumed, so that elements inside are found as well.
        parts = all_matches(html, rule._replace(pattern=f"<(?=({pattern[1:]}))", kind=""))
        parts = F.transform(parts, lambda part: F.concat(F.lit("<"), part))
    else:
        stop = f"(?:{pattern})" if end is None else f"(?:{pattern}|{end})"
        parts = all_matches(html, rule._replace(pattern=f"(?:{pattern}){up_to(stop)}"), 0)
    if fallback is not None:
        parts = let(
            parts,
            lambda found: F.when(F.size(found) > 0, found).otherwise(all_matches(html, fallback)),
        )
    return parts
