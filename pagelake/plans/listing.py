"""Result pages to the venue listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pagelake.operators.cards import listing_cards, require
from pagelake.operators.relational import cap_pages, first_wins, stop_at_first_gap
from pagelake.plans.rules import LISTING_CARDS, CardRules
from pagelake.schemas import ORDER
from pagelake.session import stage


def build_listing(
    pages: DataFrame,
    max_pages: int | None = 20,
    rules: CardRules = LISTING_CARDS,
    keys: Sequence[str] = ("name",),
    first_page: int = 1,
    work: str | None = None,
) -> DataFrame:
    """Listing rows in crawl order semantics: first card per key, up to the first page
    that adds nothing, at most ``max_pages`` pages.

    ``pages`` has ``page_no``, ``url`` and ``html``. The raw pages are parsed once;
    the deduplicated cards, a small fraction of them, are stored below ``work`` or the
    shared folder and read twice, for the stop and for the result.
    """
    wanted = cap_pages(pages, max_pages, "page_no", first_page)
    new = stage(first_wins(require(listing_cards(wanted, rules)), keys, ORDER), "listing", work)
    return stop_at_first_gap(new, "page_no", max_pages, first_page)
