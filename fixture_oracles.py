"""The same results in DuckDB SQL, written independently of the Spark expressions."""

from __future__ import annotations

LI = '<li><a href="([^"]*)">(.*?)</a></li>'
BLANKS = "' ' || chr(9) || chr(10) || chr(12) || chr(13) || chr(160)"
BLOCKS = (
    "(?i)<(?:br|/?(?:address|article|div|dd|dl|dt|footer|h[1-6]|header|li|nav|ol|p|section"
    "|table|tr|ul))(?:[ /][^>]*)?>"
)


def entities(x: str) -> str:
    """The references that occur in the pages; the ampersand comes last."""
    for name, char in (
        ("lt", "'<'"),
        ("gt", "'>'"),
        ("quot", "chr(34)"),
        ("copy", "chr(169)"),
        ("middot", "chr(183)"),
        ("amp", "'&'"),
    ):
        x = f"replace({x}, '&{name};', {char})"
    return x


def visible(x: str) -> str:
    """Visible text of a fragment."""
    for pattern, new in (
        ("(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>", "''"),
        ("[ \\t\\r\\n\\f]+", "' '"),
        (BLOCKS, "chr(10)"),
        ("</?[a-zA-Z][^>]*>", "''"),
        (" *\\n[ \\n]*", "chr(10)"),
        (" {2,}", "' '"),
    ):
        x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    return f"trim({entities(x)}, {BLANKS})"


def first(x: str, pattern: str) -> str:
    """Group 1 of the first match, null without one."""
    return f"regexp_extract_all({x}, '{pattern}', 1, 's')[1]"


ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
H1 = visible(first("html", "<h1>(.*?)</h1>"))
FOOTER = visible(first("html", "<footer>(.*?)</footer>"))

CARDS = f"""cards as (
  select page_id, url as page_url, i - 1 as pos, {visible('n[i]')} as name, u[i] as url
  from (select page_id, url, regexp_extract_all(html, '{LI}', 1, 's') u,
               regexp_extract_all(html, '{LI}', 2, 's') n from pages) t,
       lateral (select unnest(range(1, len(t.u) + 1)) as i))"""

FIRSTS = """firsts as (
  select * exclude (rn) from (
    select *, row_number() over (partition by name order by page_id, pos) rn
    from cards where name <> '') where rn = 1)"""

HOSTS = """hosts as (
  select page_id, name from (
    select *, row_number() over (partition by name order by page_id) rn
    from (select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as name from pages))
  where rn = 1)"""


def gap(table: str, page: str, pages: str) -> str:
    """Rows of ``table`` before the first of ``pages`` page numbers without a row."""
    return f"""select * from {table} where {page} < (
      select coalesce(min(p), {pages}) from (select unnest(range(0, {pages})) as p)
      where p not in (select {page} from {table}))"""


LABELS = """labels_of as (
  select page_id, stars, bib,
    case when bib then 'Bib Gourmand' when stars > 0 then stars || ' star' else 'None' end
      as distinction,
    case when stars > 0 then stars || ' star(s)' when bib then 'Bib Gourmand' else 'None' end
      as nearby_label
  from (select page_id, len(list_filter(s, lambda x: contains(x, '/th'))) as stars,
          len(list_filter(s, lambda x: contains(x, '/an') and not contains(x, '/th'))) > 0 as bib
        from (select page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) s from pages)))"""

# A nav card as a listing row.
LISTING = f"""{CARDS}, {FIRSTS}, listing as (
  select page_id as page_no, pos, name, {ORIGIN.replace('url', 'page_url')} || url as url,
    case when contains(url, '/th') then 1 else 0 end::integer as stars,
    case when contains(url, '/th') then '1 star' when contains(url, '/an') then 'Bib Gourmand'
      else 'None' end as distinction,
    name as location, null::varchar as price, null::varchar as cuisine
  from firsts), built as (
  {gap('listing', 'page_no', '(select max(page_id) + 1 from pages)')})"""

FIRST_LINK = first("html", LI)


def website(page: str) -> str:
    """Link whose text contains "the", else the first link that starts with /de."""
    the = first("html", '<a href="([^"]*)">[^<]*the')
    de = first("html", '<a href="(/de[^"]*)"')
    return f"regexp_extract({page}, '^([a-z]+://[^/?#]+)', 1) || coalesce({the}, {de})"


def nearby_names(limit: int) -> str:
    words = f"regexp_extract_all(html, '{LI}', 2, 's')"
    return f"list_transform({words}[1:{limit}], lambda w: {entities('w')})"


PHONE = (
    "coalesce("
    + visible(first("html", '<a href="/to">(.*?)</a>'))
    + ", "
    + visible(first("html", '<a href="/th[^"]*">(.*?)</a>'))
    + ")"
)
AD = visible(first("html", '<div class="ad">(.*?)</div>'))

PARAGRAPHS = f"""days as (
  select page_id, i, regexp_extract(p, '^(?:<b>)?[ ]*([A-Za-z])', 1) as day,
    {visible("regexp_extract(p, '(?s)^(?:<b>)?(.*?)(?:</p>|<br>|$)', 1)")} as hours
  from (select page_id, unnest(range(2, len(ps) + 1)) as i, unnest(ps[2:]) as p
        from (select page_id, string_split(regexp_extract(html, '(?s)^(.*?)(?:</article>|$)', 1), '<p>') as ps
              from pages))),
 day_rows as (
  select page_id, row_number() over (partition by page_id order by min(i)) - 1 as place, day,
    case when arg_max(hours, i) = '' then 'closed' else arg_max(hours, i) end as hours
  from days where day <> '' group by page_id, day)"""

def json_text(x: str) -> str:
    return f"to_json({x})::varchar"


def nearby_json(words: str, links: str, url: str, price: str, cuisine: str, stars: str, label: str) -> str:
    """The first nine words as nearby records; the SQL may use ``i``, ``w`` and ``u``."""
    w, u = entities(f"{words}[i]"), f"{links}[i]"
    fill = lambda x: x.replace("{w}", w).replace("{u}", u)
    return f"""case when len({words}) > 0 then '[' || array_to_string(list_transform(
      range(1, least(len({words}), 9) + 1), lambda i: '{{"name":' || {json_text(w)} ||
      ',"url":' || {json_text(fill(url))} || ',"location":' || {json_text(w)} ||
      ',"price":' || {fill(price)} || ',"cuisine":' || {fill(cuisine)} ||
      ',"stars":' || {fill(stars)} || ',"distinction":"' || {fill(label)} || '"}}'), ',') || ']' end"""


MAPS = f"""maps as (
  select page_id, '{{' || string_agg({json_text('day')} || ': ' || {json_text('hours')}, ', '
    order by place) || '}}' as opening_hours from day_rows group by page_id)"""
NAV_NEARBY = nearby_json(
    "words",
    "links",
    "regexp_extract(link, '^([a-z]+://[^/?#]+)', 1) || {u}",
    "'null'",
    "'null'",
    "case when contains({u}, '/th') then 1 else 0 end",
    "case when contains({u}, '/th') then '1 star(s)' when contains({u}, '/an') then 'Bib Gourmand' else 'None' end",
)

DETAIL_PAGES = f"""{PARAGRAPHS}, {MAPS}, captures as (
  select * from (
    select *, row_number() over (partition by link order by page_id) as rn
    from (select page_id, html, {ORIGIN} || {FIRST_LINK} as link,
            regexp_extract_all(html, '{LI}', 1, 's') as links,
            regexp_extract_all(html, '{LI}', 2, 's') as words from pages))
  where rn = 1),
 extracted as (
  select link, {H1} as address, {PHONE} as phone, {AD} as description,
    null::varchar as price_range, null::varchar as cuisine_type, {website('link')} as website,
    opening_hours, {NAV_NEARBY} as nearby
  from captures left join maps using (page_id)),
 details as (
  select page_no, pos, url, address, phone, description, opening_hours, price_range,
    cuisine_type, website, nearby, name, location, stars, distinction,
    case when link is null then 'page not found' end as error
  from built left join extracted on url = link)"""


def checks(rows: str, present: dict[str, str]) -> str:
    parts = [
        f"select '{name}' as field, count(*) filter (where {test}) as present, count(*) as total "
        f"from {rows}"
        for name, test in present.items()
    ]
    return (
        "select field, present, total, present * 100.0::double / total as percent, "
        "round(present * 100.0::double / total, 1) as percent_1dp from ("
        + " union all ".join(parts)
        + ")"
    )


LABELLED = """rows_of as (
  select case quality when 1 then 'p' when 0 then 'N/A' end as phone,
    case toxic when 0 then '' when 1 then 'N/A' end as address, lang as description,
    case when quality is null then 'page not found' end as error
  from documents left join labels using (doc_id))"""

PART = "select p_partkey, p_name, p_brand, p_size, p_retailprice from part"


SQL = {
    "scan_pages": "select page_id, url, length(html)::integer as chars from pages",
    "single_page": "select page_id, url, html from pages where page_id = 3",
    "single_url": """select page_id, url, html from pages
      where url = (select max(url) from pages)""",
    "page_url": f"""select page_id, {ORIGIN} ||
      case when page_id = 1 then '' else '/page/' || page_id end as listing_url from pages""",
    "page_news": f"""with {HOSTS} select p as page_no, count(page_id) as n
      from (select unnest(range(1, (select count(*) + 1 from pages))) as p)
      left join hosts on p = page_id + 1 group by p""",
    "csv_scan": """select doc_id, source as name,
      case when quality = 1 then 'u/' || doc_id end as url, quality as stars, lang as location
      from documents left join labels using (doc_id)""",
    "csv_rejects": """select doc_id, lang,
      case doc_id % 4 when 2 then cast(doc_id % 7 as int) when 3 then 2 end as stars,
      case when doc_id % 4 < 2 then 'stars' else '' end as rejected from documents""",
    "csv_roundtrip": """select p_partkey, '"q", ' || p_name || chr(10) || 'x' as p_name,
      p_brand, p_size, p_retailprice from part""",
    "json_roundtrip": PART,
    "json_array_roundtrip": PART,
    "csv_flat_roundtrip": f"""with e as (
        select conv_id, role, arg_max(text, turn) as t, min(turn) as f
        from conversations group by 1, 2)
      select conv_id, string_agg(role, '; ' order by role) as facilities,
        '{{' || string_agg({json_text('role')} || ': ' || {json_text('t')}, ', ' order by f) || '}}'
          as opening_hours
      from e group by conv_id""",
    "explode_cards": f"with {CARDS} select page_id, pos, name, url from cards",
    "cards_fallback": """select page_id, unnest(range(0, len(c))) as pos, unnest(c) as frag
      from (select page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1, 's') as c from pages)""",
    "first_text": f"select page_id, {H1} as heading, null::varchar as absent from pages",
    "first_attr": f"select page_id, {ORIGIN} || {FIRST_LINK} as link from pages",
    "nth_text": f"""select page_id, {visible('p[1]')} as first, {visible('p[3]')} as third
      from (select page_id, regexp_extract_all(html, '<p>(.*?)</p>', 1, 's') as p from pages)""",
    "award_label": f"""with {LABELS} select page_id, stars, bib, distinction as listing_label,
      nearby_label from labels_of""",
    "split_price_cuisine": f"""with t as (
        select page_id, {FOOTER} as f, {H1} as heading from pages)
      select page_id, trim(split_part(f, '·', 1)) as price, trim(split_part(f, '·', 2)) as cuisine,
        split_part(f, ' · ', 1) as price_range, split_part(f, ' · ', 2) as cuisine_type,
        case when contains(heading, '·') then trim(split_part(heading, '·', 1)) end as no_price,
        case when contains(heading, '·') then trim(split_part(heading, '·', 2)) else heading end
          as only_cuisine,
        split_part(heading, ' · ', 1) as only_price,
        case when contains(heading, ' · ') then split_part(heading, ' · ', 2) end as no_cuisine
      from t""",
    "link_by_text": f"select page_id, {website('url')} as website from pages",
    "last_wins_map": """select conv_id,
        row_number() over (partition by conv_id order by min(turn)) - 1 as place, role,
        case when trim(arg_max(text, turn)) = '' then 'closed' else trim(arg_max(text, turn)) end
          as hours
      from conversations group by conv_id, role""",
    "day_map": f"with {PARAGRAPHS} select page_id, place, day, hours from day_rows",
    "section_after": """select page_id, html[strpos(html, '<article>') + 9:] as section
      from pages""",
    "nearby_first_n": f"""with {CARDS} select page_id, name,
        {ORIGIN.replace('url', 'page_url')} || url as url, name as location,
        null::varchar as price, null::varchar as cuisine,
        case when contains(url, '/th') then 1 else 0 end::integer as stars,
        case when contains(url, '/th') then '1 star(s)' when contains(url, '/an')
          then 'Bib Gourmand' else 'None' end as distinction
      from cards where pos < 9""",
    "detail_record": f"""with {PARAGRAPHS}, {MAPS} select page_id, {H1} as address, {PHONE} as phone, {AD} as description, opening_hours,
        null::varchar as price_range, null::varchar as cuisine_type, {website('url')} as website,
        array_to_string({nearby_names(9)}, '; ') as nearby
      from pages left join maps using (page_id)""",
    "fill_sentinels": """select doc_id,
        coalesce(case when toxic = 0 then source end, 'N/A') as location,
        coalesce(quality, 0) as stars,
        coalesce(case when quality > 0 then quality || ' star' end, 'None') as distinction
      from documents left join labels using (doc_id)""",
    "dedup_first": f"with {CARDS}, {FIRSTS} select page_id, pos, name, url from firsts",
    "append_new": f"""with {CARDS}, {FIRSTS},
        known as (select unnest(string_split({H1}, ' ')) as name from pages)
      select page_id, pos, name, url from firsts
      where name not in (select name from known where name is not null)""",
    "stop_at_gap": f"with {HOSTS} {gap('hosts', 'page_id', '(select max(page_id) + 1 from pages)')}",
    "stop_at_gap_capped": f"with {HOSTS} {gap('hosts', 'page_id', '5')}",
    "slice_rows": """select page_id, url from pages where not contains(url, '?')
      order by page_id limit 25 offset 10""",
    "slice_indexed": """select page_id, url from (
        select page_id, url, row_number() over (order by page_id) as n from pages where not contains(url, '?'))
      where n between 11 and 35 or n > 100""",
    "slice_tail": """select page_id, url from pages where not contains(url, '?')
      order by page_id offset 100""",
    "enrich_left": """select doc_id, quality, toxic, lang, source, n_chars,
        case when quality is null then 'page not found' end as error
      from documents left join labels using (doc_id)""",
    "enrich_hot": """select d.lang, first_doc, n, doc_id, source, null::varchar as error
      from documents d join (select lang, min(doc_id) as first_doc, count(*) as n
        from documents group by lang) l on d.lang = l.lang""",
    "union_records": """select doc_id, lang, n_chars, null::integer as quality, source, text,
        null::integer as toxic from documents
      union all select doc_id, null, null, quality, null, null, toxic from labels""",
    "listing_summary": f"""with {LABELS} select count(*) as total,
        count(*) filter (where stars > 0) as starred,
        count(*) filter (where distinction = 'Bib Gourmand') as bib from labels_of""",
    "star_breakdown": f"""with {LABELS} select stars, count(*) as n from labels_of
      where stars in (1, 2, 3) group by stars order by stars desc""",
    "top_k_stable": f"""with {CARDS} select name, n from (
        select name, count(*) as n, min((page_id, pos)) as f from cards group by name)
      order by n desc, f limit 10""",
    "completeness": f"""with {LABELLED} {checks('rows_of', {
        'phone': "phone <> 'N/A'", 'address': "address <> 'N/A'",
        'description': "description <> 'N/A'"})}""",
    "completeness_compat": f"""with {LABELLED} {checks('rows_of', {
        name: f"case when {name} is null then error is not null else {name} <> 'N/A' end"
        for name in ('phone', 'address', 'description')})}""",
    "page_tallies": f"""with {CARDS}, {FIRSTS},
        stops as ({gap('firsts', 'page_id', '(select max(page_id) + 1 from pages)')}),
        stop as (select coalesce(min(p), (select max(page_id) + 1 from pages)) as s
          from (select unnest(range(0, (select max(page_id) + 1 from pages))) as p)
          where p not in (select page_id from firsts))
      select page_id::integer as page_no, count(c.pos) as found, count(f.pos) as new,
        count(c.pos) - count(f.pos) - count(*) filter (where c.name = '') as duplicate,
        count(*) filter (where c.name = '') as nameless
      from pages p left join cards c using (page_id) left join firsts f using (page_id, pos)
      where page_id <= (select s from stop) group by page_id""",
    "map_to_json": f"""select p_partkey,
        '{{"name":' || {json_text('p_name')} || ',"brand":' || {json_text('p_brand')} || '}}'
          as compact,
        '{{"name": ' || {json_text('p_name')} || ', "brand": ' || {json_text('p_brand')} || '}}'
          as spaced from part""",
    "array_to_json": f"""select page_id,
        '[' || array_to_string(list_transform(w, lambda x: '{{"name":' || {json_text('x')} ||
          ',"n":' || length(x) || '}}'), ',') || ']' as compact,
        '[' || array_to_string(list_transform(w, lambda x: '{{"name": ' || {json_text('x')} ||
          ', "n": ' || length(x) || '}}'), ', ') || ']' as spaced
      from (select page_id, regexp_extract_all(html, '{LI}', 2, 's') as w from pages)""",
    "array_join": f"""select page_id,
        array_to_string(regexp_extract_all(html, '{LI}', 2, 's'), '; ') as words from pages""",
    "build_listing": f"with {LISTING} select * from built",
    "build_details": f"with {LISTING}, {DETAIL_PAGES} select * from details",
    "build_details_slice": f"""with {LISTING}, {DETAIL_PAGES} select * from details
      order by page_no, pos limit 40 offset 5""",
    "two_stage_run": f"""with {LISTING}, {DETAIL_PAGES} {checks('details', {
        name: f'{name} is not null' for name in ('phone', 'address', 'description', 'website')})}""",
    "details_from_csv": f"""with {LISTING}, {DETAIL_PAGES}
      select * exclude (page_no, pos) from (select * from details
      order by page_no, pos limit 40 offset 5)""",
    "listing_stream": f"with {LISTING} select * from listing",
    "listing_stream_stop": f"with {LISTING} select * from built",
    "directory_listing": f"""with {CARDS}, venues as (
        select page_id, pos, name, {ORIGIN.replace('url', 'page_url')} || url || '?x=/restaurant' as url,
          1 as stars, '1 star' as distinction, name as location, {entities('url')} as price, name as cuisine
        from cards where name <> ''
        union all select page_id, 1000000, 'Bare ' || page_id, null, 0, 'None', null, null, null from pages)
      select page_id as page_no, * exclude (page_id, pos, rn) from (
        select *, row_number() over (partition by name order by page_id, pos) as rn from venues)
      where rn = 1""",
    "directory_details": f"""with p as (
        select page_id, {ORIGIN} as site, {H1} as address, {FOOTER} as footer,
          trim({visible(first('html', '<div class="ad">(.*?)</div>'))} || chr(10) || 'more', {BLANKS}) as description,
          regexp_extract_all(html, '{LI}', 1, 's') as links, regexp_extract_all(html, '{LI}', 2, 's') as words,
          list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1),
            '<p>([^<]*)</p>', 1), lambda t: {visible('t')}), lambda t: t <> '') as days
        from pages)
      select page_id, address, 'Call ' || page_id as phone, description,
        case when len(days) > 0 then '{{' || array_to_string(list_transform(
          list_filter(days, lambda d, i: list_position(days, d) = i),
          lambda d: {json_text('d')} || ': "9 – 5"'), ', ') || '}}' end as opening_hours,
        split_part(footer, ' · ', 1) as price_range,
        case when contains(footer, ' · ') then split_part(footer, ' · ', 2) end as cuisine_type,
        site || '/home' as website,
        {nearby_json('words', 'links', "site || {u} || '?x=/restaurant'", json_text(entities('{u}')), json_text('{w}'), '1', "'1 star(s)'")} as nearby
      from p""",
}
SQL["enrich_bucketed"] = SQL["enrich_left"]
