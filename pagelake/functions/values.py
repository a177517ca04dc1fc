"""Value rules: awards, price and cuisine, missing-value marks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.text import strip

# Result labels and missing-value marks.
BIB_LABEL = "Bib Gourmand"
NO_AWARD = "None"
MISSING = "N/A"


def award_flags(srcs: Column, star: str, bib: str) -> tuple[Column, Column]:
    """(number of star images, whether a Bib image occurs).

    An image that carries both marks counts as a star; one without a source does
    not count.
    """
    stars = F.size(F.filter(srcs, lambda s: F.contains(s, F.lit(star))))
    flag = F.exists(srcs, lambda s: F.contains(s, F.lit(bib)) & ~F.contains(s, F.lit(star)))
    return stars, flag


def distinction(stars: Column, bib: Column, mode: str = "bib_first") -> Column:
    """Award label. Listing cards put Bib first, nearby cards put stars first."""
    if mode == "bib_first":
        return (
            F.when(bib, F.lit(BIB_LABEL))
            .when(stars > 0, F.concat(stars.cast("string"), F.lit(" star")))
            .otherwise(F.lit(NO_AWARD))
        )
    if mode == "stars_first":
        return (
            F.when(stars > 0, F.concat(stars.cast("string"), F.lit(" star(s)")))
            .when(bib, F.lit(BIB_LABEL))
            .otherwise(F.lit(NO_AWARD))
        )
    raise ValueError(f"unknown mode: {mode}")


def split_pair(
    col: Column, sep: str, missing: str = "left", trim: bool = False
) -> tuple[Column, Column]:
    """The first two parts around ``sep``; further parts are dropped.

    Without a separator the whole text is one side and the side named by
    ``missing`` is null.
    """
    if missing not in ("left", "right"):
        raise ValueError(f"missing must be left or right: {missing}")
    both = F.contains(col, F.lit(sep))
    tidy = strip if trim else (lambda c: c)
    left = F.when(both, tidy(F.split_part(col, F.lit(sep), F.lit(1))))
    right = F.when(both, tidy(F.split_part(col, F.lit(sep), F.lit(2))))
    if missing == "left":
        return left, right.otherwise(tidy(col))
    return left.otherwise(tidy(col)), right


def fill_sentinels(
    df: DataFrame, columns: Iterable[str] | None = None, only_if: Column | None = None
) -> DataFrame:
    """Replace nulls by the marks used in exported files.

    Text becomes ``N/A``, ``stars`` 0 and ``distinction`` ``None``; other types are
    left alone. ``columns`` limits it to some columns, ``only_if`` to some rows.
    """
    wanted = set(df.columns if columns is None else columns)
    marked = {}
    for field in df.schema.fields:
        if field.name not in wanted:
            continue
        if field.name == "stars":
            mark = F.lit(0).cast(field.dataType)
        elif field.name == "distinction":
            mark = F.lit(NO_AWARD)
        elif field.dataType.typeName() == "string":
            mark = F.lit(MISSING)
        else:
            continue
        if only_if is not None:
            mark = F.when(only_if, mark)
        marked[field.name] = F.coalesce(F.col(field.name), mark)
    return df.withColumns(marked)
