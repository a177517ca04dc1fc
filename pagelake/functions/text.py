"""Text expressions: trimming, markup removal, entity decoding, link resolution.

Each rule is one Spark SQL lambda over built-in functions, applied to a column by
:func:`apply`. No row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space for trimming.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Named character references of HTML 5, and the old names that need no semicolon.
ENTITIES = {name[:-1]: text for name, text in sorted(html5.items()) if name.endswith(";")}
BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))

# References that are common enough for a plain replacement (fixed values).
_COMMON = {"lt": "<", "gt": ">", "quot": '"', "nbsp": chr(0xA0), "middot": "·", "#39": "'"} | {
    "ndash": "–", "mdash": "—", "rsquo": "’", "hellip": "…"
}

_NUMBER = "#[0-9]+|#[xX][0-9a-fA-F]+"
_REFERENCE = "#[0-9xX]|[A-Za-z]"
# Numbers 128 to 159 stand for the characters that Windows-1252 has there.
_LATIN = [bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160)]
_INVISIBLE = r"(?is)<(?:!--.*?-->|(script|style)\b.*?</\1\s*>)"
_SPACES = "\t\r\n\f"
_BREAKS = (
    r"(?i)<(?:br|/?(?:address|article|div|dd|dl|dt|footer|h[1-6]|header|li|nav|ol|p|section"
    r"|table|tr|ul))(?:[\s/][^<>]*)?>"
)
_COMMENTS = r"(?s)<!--.*?-->"
_TAGS = r"</?[a-zA-Z][^<>]*>"
_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)"
_FOLDER = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]+(?:/.*(?=/))?)"
_DOTTED = r"^[^?#]*/\.\.?(?:[/?#]|$)"


def sql_text(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(x: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        x = f"regexp_replace({x}, {sql_text(pattern)}, {sql_text(new)})"
    return x


def sql_let(var: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``var`` standing for ``value``, computed once.

    An aggregation over nothing hands its start value to its last step. Taking the only
    item of a transformed array would do as well, but that asks for the item's type on
    every call, which means walking through all of ``body``.
    """
    return f"aggregate(array(), {value}, (acc, x) -> acc, {var} -> {body})"


def _stripped(x: str) -> str:
    return f"trim(BOTH {sql_text(WHITESPACE)} FROM {x})"


def _char(code: str) -> str:
    latin = ", ".join(sql_text(char) for char in _LATIN)
    valid = f"{code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111"
    return (
        f"CASE WHEN {code} BETWEEN 128 AND 159 THEN element_at(array({latin}), CAST({code} - 127 AS INT)) "
        f"WHEN {valid} THEN decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32') "
        f"ELSE {sql_text(chr(0xFFFD))} END"
    )


def _decoded(s: str, attribute: bool = False) -> str:
    """SQL for a text with its references decoded.

    Old names count without a semicolon, longest first; in an attribute only if neither
    a letter, a digit nor "=" follows, as links are full of such names. A number too
    large for a character is the replacement character.
    """
    # The table is one text literal that Spark folds into a map.
    table = "\x02".join(f"{name}\x01{char}" for name, char in ENTITIES.items())
    table = f"str_to_map({sql_text(table)}, {sql_text(chr(2))}, {sql_text(chr(1))})"
    entity = lambda name: f"try_element_at(entities, {name})"
    digits = "ltrim('0', substr(r, CASE WHEN r RLIKE '^#[xX]' THEN 3 ELSE 2 END))"
    number = (
        f"CASE WHEN length({digits}) > 7 THEN 0 "
        f"ELSE CAST(concat('0', CASE WHEN r RLIKE '^#[xX]' THEN conv({digits}, 16, 10) "
        f"ELSE {digits} END) AS BIGINT) END"
    )
    value = (
        f"CASE WHEN startswith(r, '#') THEN {sql_let('n', number, _char('n'))} "
        f"ELSE {entity('r')} END"
    )
    bare = "^(" + "|".join(BARE_NAMES) + ")" + ("(?![=A-Za-z0-9])" if attribute else "")
    name = sql_let(
        "m",
        "regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1)",
        f"CASE WHEN m <> '' AND {entity('m')} IS NOT NULL THEN m "
        f"ELSE regexp_extract(p, {sql_text(bare)}, 1) END",
    )
    found = f"coalesce(nullif(regexp_extract(p, '^({_NUMBER})', 1), ''), {name})"
    rest = "substr(p, length(r) + 1 + CASE WHEN substr(p, length(r) + 1, 1) = ';' THEN 1 ELSE 0 END)"
    piece = sql_let(
        "r", found, f"CASE WHEN r <> '' THEN concat({value}, {rest}) ELSE concat('&', p) END"
    )
    general = sql_let(
        "ps",
        f"split({s}, '&')",
        f"concat(ps[0], array_join(transform(slice(ps, 2, size(ps)), p -> {piece}), ''))",
    )
    general = sql_let("entities", table, general)
    common = s
    for name_, char in _COMMON.items():
        common = f"replace({common}, {sql_text(f'&{name_};')}, {sql_text(char)})"
    other = sql_text(f"&(?!amp;)(?:{_REFERENCE})")
    quick = sql_let(
        "q", common, f"CASE WHEN q RLIKE {other} THEN {general} ELSE replace(q, '&amp;', '&') END"
    )
    return f"CASE WHEN contains({s}, '&') THEN {quick} ELSE {s} END"


def _collapsed(x: str) -> str:
    """Runs of white space as one space; text without any is only looked through."""
    for char in _SPACES:
        x = f"replace({x}, {sql_text(char)}, ' ')"
    return sql_let(
        "w",
        x,
        f"CASE WHEN contains(w, '  ') THEN {_replaced('w', (' {2,}', ' '))} ELSE w END",
    )


def _content(f: str) -> str:
    bare = (
        f"CASE WHEN contains({f}, '<') THEN {_replaced(f, (_COMMENTS, ''), (_TAGS, ''))} "
        f"ELSE {f} END"
    )
    return _stripped(sql_let("s", bare, _decoded("s")))


def _visible(f: str) -> str:
    source = _collapsed(_replaced(f, (_INVISIBLE, "")))
    lines = _replaced(source, (_BREAKS, "\n"), (_TAGS, ""))
    markup = _replaced(lines, (r" *\n[ \n]*", "\n"), (" {2,}", " "))
    bare = f"CASE WHEN contains({f}, '<') THEN {markup} ELSE {_collapsed(f)} END"
    decoded = sql_let("s", bare, _decoded("s"))
    return _stripped(f"replace({decoded}, {sql_text(chr(0xA0))}, ' ')")


def _without_dots(path: str) -> str:
    kept = (
        f"aggregate(split({path}, '/'), CAST(array() AS ARRAY<STRING>), (acc, s) -> "
        "CASE WHEN s = '.' THEN acc WHEN s = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 1)) "
        "ELSE concat(acc, array(s)) END)"
    )
    tail = f"CASE WHEN {path} RLIKE {sql_text(r'/\.\.?$')} THEN '/' ELSE '' END"
    return f"concat(array_join({kept}, '/'), {tail})"


def origin_sql(url: str) -> str:
    """SQL for ``scheme://host`` of an absolute URL."""
    return f"regexp_extract({url}, {sql_text(_ORIGIN)}, 1)"


def _resolved(href: str, page_url: str) -> str:
    site = origin_sql(page_url)
    page = f"regexp_extract({page_url}, '^([^?#]*)', 1)"
    folder = f"regexp_extract({page}, {sql_text(_FOLDER)}, 1)"
    path = (
        f"CASE WHEN startswith({href}, '/') THEN {href} "
        f"ELSE concat(substr({folder}, length({site}) + 1), '/', {href}) END"
    )
    plain = "regexp_extract(p, '^([^?#]*)', 1)"
    tidy = sql_let(
        "p",
        path,
        f"CASE WHEN p RLIKE {sql_text(_DOTTED)} THEN "
        f"{sql_let('d', plain, 'concat(' + _without_dots('d') + ', substr(p, length(d) + 1))')} "
        "ELSE p END",
    )
    return (
        f"CASE WHEN {href} = '' OR {href} RLIKE {sql_text(_ABSOLUTE)} THEN {href} "
        f"WHEN startswith({href}, '//') THEN concat(split_part({page_url}, '/', 1), {href}) "
        f"WHEN startswith({href}, '#') THEN concat(split_part({page_url}, '#', 1), {href}) "
        f"WHEN startswith({href}, '?') THEN concat({page}, {href}) "
        f"WHEN {href} IS NOT NULL THEN concat({site}, {tidy}) END"
    )


def apply(col: Column, rule: str) -> Column:
    """A SQL lambda applied to one column, which is computed once."""
    return F.call_function("aggregate", F.array(), col, F.expr("(acc, x) -> acc"), F.expr(rule))


def apply_all(cols: Column, rule: str) -> Column:
    """A SQL lambda applied to every element of an array column."""
    return F.call_function("transform", cols, F.expr(rule))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` under a name.

    Without it, a costly expression used twice (outside a shared projection, or
    inside a lambda) would be computed twice.
    """
    return F.aggregate(F.array(), value, lambda acc, x: acc, lambda v: body(v))


DECODED = f"f -> {_decoded('f')}"
ATTRIBUTE = f"f -> {_decoded('f', attribute=True)}"
CONTENT = f"f -> {_content('f')}"
VISIBLE = f"f -> {_visible('f')}"
RESOLVED = f"l -> {_resolved('l.href', 'l.page')}"


def strip(col: Column) -> Column:
    """Remove white space, Unicode kinds included, from both ends."""
    return F.trim(col, F.lit(WHITESPACE))


def decode_entities(col: Column, attribute: bool = False) -> Column:
    """Decode named and numeric character references; unknown names stay as they are."""
    return apply(col, ATTRIBUTE if attribute else DECODED)


def text_content(fragment: Column) -> Column:
    """Text of a fragment with inner white space kept: tags out, entities decoded, trimmed."""
    return apply(fragment, CONTENT)


def visible_text(fragment: Column) -> Column:
    """Text of a fragment as a reader sees it.

    Comments, scripts and styles go, runs of white space become one space, line
    and block boundaries become a line break, no-break spaces become plain ones, and
    the ends are trimmed.
    """
    return apply(fragment, VISIBLE)


def origin(url: Column) -> Column:
    """``scheme://host`` of an absolute URL."""
    return F.regexp_extract(url, _ORIGIN, 1)


def resolve_url(href: Column, page_url: Column) -> Column:
    """Absolute form of a link found on a page; an empty link stays empty."""
    return apply(F.struct(href.alias("href"), page_url.alias("page")), RESOLVED)
