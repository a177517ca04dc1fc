"""Record schemas (explicit, so nothing is inferred from the data)."""

from __future__ import annotations

from pyspark.sql import types as T

ORDER = ("page_no", "pos")

# Header of the listing CSV, in this order (fixed values).
LISTING_FIELDS = ("name", "url", "stars", "distinction", "location", "price", "cuisine")

# What a detail row takes over from its listing row (fixed values).
CARRIED_FIELDS = ("name", "location", "stars", "distinction")

# What is read from a detail page (fixed values).
DETAIL_FIELDS = (
    "address",
    "phone",
    "description",
    "opening_hours",
    "price_range",
    "cuisine_type",
    "website",
    "nearby_restaurants",
)


def _string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


CARD = T.StructType(
    [
        _string("name"),
        _string("url"),
        T.StructField("stars", T.IntegerType()),
        _string("distinction"),
        _string("location"),
        _string("price"),
        _string("cuisine"),
    ]
)

LISTING = T.StructType(
    [T.StructField("page_no", T.LongType()), T.StructField("pos", T.IntegerType())]
    + CARD.fields
)

NEARBY = T.StructType(
    [CARD[n] for n in ("name", "url", "location", "price", "cuisine", "stars", "distinction")]
)

DETAIL = T.StructType(
    [
        _string("url"),
        _string("address"),
        _string("phone"),
        _string("description"),
        T.StructField("opening_hours", T.MapType(T.StringType(), T.StringType())),
        _string("price_range"),
        _string("cuisine_type"),
        _string("website"),
        T.StructField("nearby_restaurants", T.ArrayType(NEARBY)),
        _string("name"),
        _string("location"),
        T.StructField("stars", T.IntegerType()),
        _string("distinction"),
        _string("error"),
    ]
)
