"""Elements of a page as intervals of its tags, in SQL arrays.

One search tiles the page: every piece begins with a tag of a wanted kind and runs to the
next one; whatever a browser does not read as elements (comments, scripts, text areas,
quoted attribute values) lies inside pieces. A second pass turns each piece into one
number, its place and a bit per rule that its tag meets. From there on all is arithmetic
on sorted arrays of numbers:

* The k-th opening among an element kind's tags, at index j, is ``2k - j`` deep, and the
  k-th closing leaves the depth ``j - 2k - 1``. So depths need no running sum, and sorted
  by depth and place an opening is followed by its own closing, however deep it is.
* How many points lie before each of some places is a matter of sorting both together.

Nothing is searched twice, and nothing grows faster than n log n.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple, Protocol

from pagelake.functions.text import sql_let, sql_text

# The rest of a tag. Loops over groups are possessive: Java runs those without recursion.
REST = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""

# Elements that may hold others of their name. The others end at the first closing tag.
NESTING = frozenset("article aside div footer header li nav ol section span table ul".split())

# Elements whose content is text, or is not part of the page (fixed values).
TEXT_ONLY = ("script", "style", "template", "noscript", "textarea", "title", "iframe", "xmp", "noembed", "noframes")

LOW = (1 << 32) - 1


class Wanted(Protocol):
    """What a rule must tell: its tag, a pattern of the opening tag, and its marks."""

    tag: str
    test: str
    marks: tuple[str, ...]


def hidden(but: Sequence[str] = ()) -> str:
    """Pattern behind a ``<`` of what holds no elements; group 1 is used."""
    names = "|".join(name for name in TEXT_ONLY if name not in but)
    return rf"(?:!--[\s\S]*?(?:-->|\z)|((?i:{names}))(?=[\s/>]){REST}>[\s\S]*?(?:</(?i:\1)\s*>|\z))"


def tile(tags: Sequence[str]) -> str:
    """Pattern whose matches, one behind the other, are the whole page.

    A match begins with an opening or closing tag of ``tags``, the first one with the
    page.
    """
    kind = rf"/?(?i:{'|'.join(tags)})(?=[\s/>])"
    other = rf"<(?!{kind})(?:{hidden(tags)}|[a-zA-Z/!?]{REST}>)?+"
    return rf"(?:<{kind}(?:{REST}>)?+|\A)(?:[^<]++|{other})*+"


class Chain:
    """SQL values that build on one another, each computed once.

    Values that need nothing of each other are computed side by side, as fields of one
    structure: Spark resolves nested names one level after the other.
    """

    NAME = re.compile(r"__value(\d+)__")

    def __init__(self) -> None:
        self.values: list[str] = []
        self.levels: list[int] = []

    def let(self, value: str) -> str:
        needs = [self.levels[int(n)] for n in self.NAME.findall(value)]
        self.values.append(value)
        self.levels.append(1 + max(needs, default=0))
        return f"__value{len(self.values) - 1}__"

    def _named(self, text: str, done: int, state: str) -> str:
        """``text`` with the names of values: fields of ``state`` up to level ``done``."""

        def name(match: re.Match) -> str:
            level = self.levels[int(match[1])]
            return f"{state if level <= done else f'level{level}'}.f{match[1]}"

        return self.NAME.sub(name, text)

    def parts(self, body: str, state: str, step: int = 3) -> list[str]:
        """``body`` as SQL in parts, each of which reads the one before as ``state``.

        Apply them in projections of their own: Spark limits how deep names may nest in
        one, and merges the projections afterwards.
        """
        top = max(self.levels, default=0)
        numbered = list(enumerate(self.values))
        out = []
        for done in range(0, max(top, 1), step):
            ahead = min(done + step, top)
            if ahead < top:
                later = " ".join([body, *(v for n, v in numbered if self.levels[n] > ahead)])
                needed = sorted({int(n) for n in self.NAME.findall(later) if self.levels[int(n)] <= ahead})
                result = "named_struct(" + ", ".join(f"'f{n}', __value{n}__" for n in needed) + ")"
            else:
                result = body
            sql = self._named(result, done, state)
            for level in range(ahead, done, -1):
                fields = [
                    f"'f{n}', {self._named(value, done, state)}"
                    for n, value in numbered
                    if self.levels[n] == level
                ]
                sql = sql_let(f"level{level}", f"named_struct({', '.join(fields)})", sql)
            out.append(sql)
        return out

    def sql(self, body: str) -> str:
        """``body`` as one SQL expression."""
        return self.parts(body, "", len(self.levels) + 1)[0]


def ranks(points: str, places: str, in_order: bool = True) -> str:
    """SQL: per place the number of ``points`` before it. ``points`` rise, and so do
    ``places`` if they are ``in_order``."""
    keys = (
        f"transform({places}, (v, k) -> shiftleft(v * 2, 24) + k), "
        f"transform({points}, v -> shiftleft(v * 2 + 1, 24))"
    )
    merged = sql_let(
        "m",
        f"sort_array(concat({keys}))",
        "filter(transform(m, (v, u) -> IF((shiftright(v, 24) & 1) = 1, -1L, shiftleft(CAST(u AS BIGINT), 24) + (v & 16777215L))), v -> v >= 0)",
    )
    if in_order:
        return f"transform({merged}, (v, k) -> CAST(shiftright(v, 24) - k AS INT))"
    back = f"sort_array(transform({merged}, (v, k) -> shiftleft(v & 16777215L, 32) + shiftright(v, 24) - k))"
    return f"transform({back}, v -> CAST(v & {LOW}L AS INT))"


class Interval(NamedTuple):
    """SQL of an element's first piece and of the piece of its closing tag."""

    begin: str
    end: str


class Tags:
    """A page's pieces and their numbers, for a set of rules.

    ``pieces`` is the name of the array of texts, ``numbers`` that of the numbers: place
    in the upper half, bits in the lower.
    """

    def __init__(self, chain: Chain, page: str, rules: Sequence[Wanted]) -> None:
        self.chain = chain
        tags = sorted({rule.tag for rule in rules}, key=lambda tag: (-len(tag), tag))
        self.opens, self.closes, self.bits = {}, {}, {}
        bit = 1
        for tag in tags:
            self.opens[tag], self.closes[tag], bit = bit, bit * 2, bit * 4
        self.rule_bits = bit
        # A piece has one tag, so the rules of different tags share the bits above.
        for key in dict.fromkeys((rule.tag, rule.test) for rule in rules):
            self.bits[key] = bit << sum(other[0] == key[0] for other in self.bits)
        if max(self.bits.values()) > LOW:
            raise ValueError("too many rules for one page")
        self._spans: dict[str, str] = {}
        self.rules = rules
        self.pieces = chain.let(f"regexp_extract_all({page}, {sql_text(tile(tags))}, 0)")
        self.size = chain.let(f"CAST(size({self.pieces}) AS BIGINT)")
        cases = []
        marks = {(rule.tag, rule.test): rule.marks for rule in rules}
        for tag in tags:
            met = [
                f"IF({self._has(marks[key])}s RLIKE {sql_text('^' + key[1])}, {bit}, 0)"
                for key, bit in self.bits.items()
                if key[0] == tag
            ]
            cases.append(f"WHEN startswith(p, '</{tag}') THEN {self.closes[tag]}")
            cases.append(f"WHEN startswith(p, '<{tag}') THEN {' + '.join([str(self.opens[tag]), *met])}")
        kind = sql_text(rf"^</?(?i:{'|'.join(tags)})(?=[\s/>])")
        case = f"CASE WHEN i = 0 AND NOT s RLIKE {kind} THEN 0 {' '.join(cases)} ELSE 0 END"
        start = f"lower(substring(s, 1, {max(map(len, tags)) + 2}))"
        self.numbers = chain.let(
            f"transform({self.pieces}, (s, i) -> shiftleft(CAST(i AS BIGINT), 32) + {sql_let('p', start, case)})"
        )

        # The few pieces that meet a rule.
        self.met = chain.let(f"filter({self.numbers}, v -> (v & {LOW}L) >= {self.rule_bits}L)")

    @staticmethod
    def _has(marks: tuple[str, ...]) -> str:
        if not marks:
            return ""
        return "(" + " OR ".join(f"contains(s, {sql_text(mark)})" for mark in marks) + ") AND "

    def mask(self, rule: Wanted) -> int:
        """The bits of a tag that opens an element and meets the rule."""
        return self.opens[rule.tag] | self.bits[rule.tag, rule.test]

    def points(self, mask: int) -> str:
        """Name of the places that have all bits of ``mask``, rising."""
        among = self.met if mask >= self.rule_bits else self.numbers
        return self.chain.let(
            f"transform(filter({among}, v -> (v & {mask}L) = {mask}L), v -> shiftright(v, 32))"
        )

    def _nested(self, tag: str) -> str:
        """Name of the intervals ``(b, e, f)`` of the tag's elements that meet any rule, by place.

        ``e`` is null for an element that is never closed, ``f`` are its bits.
        """
        if tag in self._spans:
            return self._spans[tag]
        let, size = self.chain.let, self.size
        opened, closed = self.opens[tag], self.closes[tag]
        wanted = sum({bit for key, bit in self.bits.items() if key[0] == tag})
        tags = let(f"filter({self.numbers}, v -> (v & {opened | closed}L) <> 0)")
        index = lambda bit: let(
            f"filter(transform({tags}, (v, j) -> IF((v & {bit}L) <> 0, j, -1)), j -> j >= 0)"
        )
        first, last = index(opened), index(closed)
        place = f"shiftright(get({tags}, j), 32) * 2"
        keys = let(
            f"sort_array(concat(filter(transform({first}, (j, k) -> IF((get({tags}, j) & {wanted}L) <> 0, "
            f"shiftleft(2 * k - j + {size}, 32) + {place}, -1L)), v -> v >= 0), "
            f"transform({last}, (j, k) -> shiftleft(j - 2 * k - 1 + {size}, 32) + {place} + 1)))"
        )
        at = lambda v: f"shiftright({v} & {LOW}L, 1)"
        following = f"get({keys}, u + 1)"
        end = f"IF(shiftright({following}, 32) = shiftright(v, 32), {at(following)}, NULL)"
        found = (
            f"filter(transform({keys}, (v, u) -> IF((v & 1) = 0, named_struct('b', {at('v')}, 'e', {end}, "
            f"'f', get({self.numbers}, CAST({at('v')} AS INT)) & {LOW}L), NULL)), v -> v IS NOT NULL)"
        )
        self._spans[tag] = let(f"sort_array({found})")
        return self._spans[tag]

    def spans(self, rule: Wanted, unclosed: str = "first") -> str:
        """Name of the intervals ``(b, e)`` of all elements that meet the rule, by place.

        An element without a closing tag of its own ends at the ``first`` one behind it
        (and is left out without any), where the ``next`` element of the rule begins, or
        with the ``page``. ``e`` is then the place of the piece behind the element.
        """
        let, mask = self.chain.let, self.mask(rule)
        if rule.tag in NESTING:
            own = let(f"filter({self._nested(rule.tag)}, v -> (v.f & {mask}L) = {mask}L)")
            if unclosed == "page":
                return let(f"transform({own}, v -> named_struct('b', v.b, 'e', coalesce(v.e, {self.size})))")
            if unclosed == "next":
                return let(
                    f"transform({own}, (v, u) -> named_struct('b', v.b, 'e', "
                    f"coalesce(v.e, get({own}, u + 1).b, {self.size})))"
                )
            # Most pages close what they open; the others are looked through once more.
            plain = f"transform({own}, v -> named_struct('b', v.b, 'e', v.e))"
            closed = f"filter({self.numbers}, n -> (n & {self.closes[rule.tag]}L) <> 0)"
            first = sql_let(
                "c",
                f"transform({closed}, n -> shiftright(n, 32))",
                sql_let(
                    "r",
                    ranks("c", f"transform({own}, v -> v.b)"),
                    f"transform({own}, (v, u) -> named_struct('b', v.b, 'e', coalesce(v.e, get(c, get(r, u)))))",
                ),
            )
            return let(
                f"IF(exists({own}, v -> v.e IS NULL), filter({first}, v -> v.e IS NOT NULL), {plain})"
            )
        begins, closes = self.points(mask), self.points(self.closes[rule.tag])
        first = let(f"transform({ranks(closes, begins)}, r -> get({closes}, r))")
        found = f"transform({begins}, (v, u) -> named_struct('b', v, 'e', get({first}, u)))"
        if unclosed == "first":
            return let(f"filter({found}, v -> v.e IS NOT NULL)")
        after = f"get({begins}, u + 1), " if unclosed == "next" else ""
        return let(
            f"transform({found}, (v, u) -> named_struct('b', v.b, 'e', coalesce(v.e, {after}{self.size})))"
        )

    def outermost(self, spans: str) -> str:
        """Name of those intervals that lie in no other one: all before them have ended."""
        ended = self.chain.let(
            ranks(f"sort_array(transform({spans}, v -> v.e))", f"transform({spans}, v -> v.b)")
        )
        return self.chain.let(f"filter({spans}, (v, u) -> get({ended}, u) = u)")

    def piece(self, place: str) -> str:
        return f"get({self.pieces}, CAST({place} AS INT))"

    def content(self, begin: str, end: str) -> str:
        """SQL of what lies between an opening tag and a place."""
        own = sql_text(f"^<{REST}>")
        inner = f"slice({self.pieces}, CAST({begin} + 2 AS INT), CAST({end} - {begin} - 1 AS INT))"
        tail = f"regexp_replace({self.piece(begin)}, {own}, '')"
        return f"IF({end} = {begin} + 1, {tail}, concat({tail}, array_join({inner}, '')))"

    def whole(self, begin: str, end: str, tag: str) -> str:
        """SQL of an element with its tags."""
        inner = f"slice({self.pieces}, CAST({begin} + 1 AS INT), CAST({end} - {begin} AS INT))"
        closing = sql_text(rf"^</(?i:{tag})\s*>")
        return f"concat(array_join({inner}, ''), regexp_extract(coalesce({self.piece(end)}, ''), {closing}, 0))"

    def first_in(self, points: str, spans: str, outside: str = "NULL") -> str:
        """SQL: per interval the index of the first of ``points`` inside it, else null."""
        place = ranks(points, f"transform({spans}, v -> v.b + 1)")
        return (
            f"transform({place}, (r, u) -> IF(get({points}, r) < get({spans}, u).e, r, {outside}))"
        )


def shown(raw: str) -> str:
    """SQL: raw content without what no reader sees."""
    return f"IF(contains({raw}, '<'), regexp_replace({raw}, {sql_text('<' + hidden())}, ''), {raw})"
