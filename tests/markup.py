"""Hand-written pages that cover what the driver's pages cannot."""

S = "/a/1star.svg"
B = "/a/bib-gourmand.svg"
BASE = "https://g.example/list"


def card(name, slug=None, images=None, scores=(), href=None, award="award"):
    """A venue card; ``None`` leaves the part out."""
    parts = ['<div class="card__menu selection-card">']
    if name is not None:
        href = href if href is not None else f"/th/en/x/restaurant/{slug}"
        parts.append(f'<h3 class="card__menu-content--title"><a href="{href}">{name}</a></h3>')
    if images is not None:
        imgs = "".join(f'<img class="{award}" src="{src}">' for src in images)
        parts.append(f'<div class="card__menu-content--distinction">{imgs}</div>')
    parts += [f'<div class="card__menu-footer--score">{s}</div>' for s in scores]
    return "\n".join(parts) + "</div>"


def page(*cards):
    return "<html><body><h1>List</h1>" + "\n".join(cards) + "</body></html>"


LISTING_PAGES = [
    page(
        card(" Alpha ", "alpha", [S, S], ["Bangkok", "฿฿฿฿ · Indian"]),
        card("Beta", "beta", [B], ["Phuket", "Thai"]),
        card(None, images=[], scores=["X"]),
        card("Gamma", "gamma"),
    ),
    page(
        card("Alpha", "alpha2", [S], ["Chiang Mai", "฿ · Noodles · Extra"]),
        card("Delta", "delta", [S, B], ["Bangkok", "฿฿ · Thai"]),
    ),
    page(card("Beta", "beta", [B], ["Phuket", "Thai"])),
    page(card("Epsilon", "epsilon", [S], ["Bangkok", "฿ · Thai"])),
]

# Positions count every element whose class names a card, parts of cards included.
ORIGIN = "https://g.example/th/en/x/restaurant/"
LISTING_ROWS = [
    (1, 0, "Alpha", ORIGIN + "alpha", 2, "2 star", "Bangkok", "฿฿฿฿", "Indian"),
    (1, 4, "Beta", ORIGIN + "beta", 0, "Bib Gourmand", "Phuket", None, "Thai"),
    (1, 11, "Gamma", ORIGIN + "gamma", 0, "None", None, None, None),
    (2, 4, "Delta", ORIGIN + "delta", 1, "Bib Gourmand", "Bangkok", "฿฿", "Thai"),
]


def page_address(n):
    return BASE if n == 1 else f"{BASE}/page/{n}"


def listing_pages(spark):
    rows = [(n, page_address(n), html) for n, html in enumerate(LISTING_PAGES, 1)]
    return spark.createDataFrame(rows, "page_no bigint, url string, html string")


def hours_card(day, *hours):
    title = "" if day is None else f'<div class="card--title"> {day} </div>'
    return (
        f'<div class="card-borderline">{title}'
        + "".join(f'<div class="card--content">{t}</div>' for t in hours)
        + "</div>"
    )


def info(*texts):
    blocks = "".join(f'<div class="data-sheet__block--text">{t}</div>' for t in texts)
    return (
        f'<div class="data-sheet__detail-info"><div class="data-sheet__block">{blocks}</div></div>'
    )


def _nearby():
    cards = []
    for n in range(1, 11):
        href = f"/r/restaurant/n{n}"
        scores = ["Bangkok", "Thai"] if n == 4 else ["Bangkok", "฿ · Thai"]
        images = {1: [S, B], 2: [B]}.get(n)
        cards.append(card(None if n == 3 else f"N{n}", images=images, scores=scores, href=href))
    return "<div class='container'><h2>Nearby Restaurants</h2>" + "".join(cards) + "</div>"


U = "https://u.example/"
DETAIL_A = (
    "<html><body>"
    + info(" 68/1 Soi A ", "฿฿฿฿ · Indian")
    + '<a href="tel:+661"> +66 1 </a><div class="data-sheet__description"> Fine. </div>'
    + hours_card("Monday", "12:00-14:00", "18:00-22:00")
    + hours_card("Tuesday", " ")
    + hours_card("Wednesday")
    + hours_card(None, "x")
    + hours_card("Monday", "19:00-23:00")
    + '<a href="https://a.example">Visit Website</a>'
    + _nearby()
    + "</body></html>"
)
DETAIL_B = (
    "<html><body>"
    + info("", "Thai")
    + '<div class="restaurant-details__description">Old.</div>'
    + '<a href="">Visit Website</a><a data-event="CTA_website" href="https://b.example">x</a>'
    + "</body></html>"
)


def detail_pages(spark):
    return spark.createDataFrame(
        [(U + "a", DETAIL_A), (U + "b", DETAIL_B)], "url string, html string"
    )


def detail_listing(spark):
    rows = [
        (1, 0, "Alpha", U + "a", 2, "2 star", "Bangkok", None, None),
        (1, 1, "Beta", U + "b", 0, "Bib Gourmand", "Phuket", None, None),
        (1, 2, "Gamma", U + "c", 0, "None", None, None, None),
        (1, 3, "Nolink", "N/A", 0, "None", None, None, None),
    ]
    return spark.createDataFrame(
        rows,
        "page_no int, pos int, name string, url string, stars int, distinction string, "
        "location string, price string, cuisine string",
    )
