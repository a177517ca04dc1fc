"""Personal data: keyed pseudonyms that keep the format, by Feistel permutations.

Numbers that pass their check (card, account, social security and phone numbers, network
addresses) and real dates are numbered within all values of their format, permuted there
under a key, and written back in the same layout, with check digits that fit. Equal values
become equal pseudonyms everywhere and different ones stay different. Mail addresses and
assigned secrets, which are no numbers, become keyed digests. All of it is Spark SQL.

Every format's size is a product ``a * b``, so a network of alternating additions modulo
``a`` and modulo ``b`` permutes exactly the format, without walking.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import whole_text

ROUNDS = 8
FIRST_DAY, YEARS = "1900-01-01", (1900, 2099)
DAYS = (4297, 17)  # all 73,049 days of these years

# A value may not be part of a longer word or number; a comma ends a number.
_BEFORE = r"(?<![\p{L}\p{N}_])(?<![0-9]\.)"
_AFTER = r"(?![\p{L}\p{N}_])(?!\.[0-9])"

# Lengths of account numbers by country.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _groups(length: int, countries: str) -> str:
    """Account numbers of one length in groups of four."""
    full, rest = divmod(length - 4, 4)
    last = f" [A-Z0-9]{{{rest}}}" if rest else ""
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{full}}}{last}"


_SPACED = "|".join(_groups(n, c) for n, c in IBANS.items())

# In this order: a place is read as the first kind that fits there.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "secret": r"(?<=[=:] {0,2}[\"']?)[0-9A-Fa-f]{32,64}(?![\p{L}\p{N}_])",
    "date": _BEFORE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}"
    r"|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?:(?=T[0-9])|" + _AFTER + ")",
    "iban": _BEFORE + rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:[A-Z0-9]{{15,34}}|{_SPACED})" + _AFTER,
    "ipv4": _BEFORE + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + _AFTER,
    "ssn": _BEFORE + r"(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-[0-9])" + _AFTER,
    "card": _BEFORE + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _AFTER,
    "phone": r"(?<![\p{L}\p{N}_+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){1,5}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}"
    r"|(?<![0-9][.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})(?![\p{L}\p{N}_])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _keyed(key: str, *parts: Column) -> Column:
    """A digest of the parts that only the key's holder can compute, in hexadecimal."""
    return F.sha2(F.concat_ws("|", F.lit(key), *parts, F.lit(key)), 256)


def _quotient(value: Column, by: Column) -> Column:
    return F.call_function("div", value, by)


def permute(value: Column, a: Column, b: Column, kind: str, key: str) -> Column:
    """``value`` below ``a * b`` (longs, the product below 2**63) within that range."""

    def turn(half: Column, i: Column, size: Column) -> Column:
        digest = _keyed(key, F.lit(kind), i.cast("string"), half.cast("string"))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + turn(s["r"], i, a)) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + turn(s["l"], i, b)) % b).alias("r"),
        )

    whole = value.cast("long")
    start = F.struct(_quotient(whole, b).alias("l"), (whole % b).alias("r"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _power(n: Column) -> Column:
    """``10 ** n`` for n from 0 to 18."""
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(19)]), n + 1)


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    """A string of up to 18 digits within all strings of its length."""
    size = F.length(digits)
    low = F.floor(size / 2).cast("int")
    value = permute(digits.cast("long"), _power(size - low), _power(low), kind, key)
    return F.lpad(value.cast("string"), size, "0")


def refill(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced one by one."""
    places = F.sequence(F.lit(1), F.length(layout))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(s: Column, i: Column) -> Column:
        char = F.substr(layout, i, F.lit(1))
        digit = char.rlike("[0-9]")
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substr(digits, s["n"] + 1, F.lit(1))).otherwise(char)).alias("out"),
            (s["n"] + digit.cast("int")).alias("n"),
        )

    return F.aggregate(places, start, step, lambda s: s["out"])


def luhn(digits: Column) -> Column:
    """The sum of the digits, every second from the right doubled; 0 modulo 10 if valid."""

    def step(total: Column, i: Column) -> Column:
        digit = F.substr(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == 1
        return total + F.when(~twice, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def mod97(text: Column) -> Column:
    """An account number, its first four characters moved last, letters as 10 to 35."""
    turned = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        char = F.substr(turned, i, F.lit(1))
        letter = char.rlike("[A-Z]")
        return (F.when(letter, rest * 100 + F.ascii(char) - 55).otherwise(rest * 10 + char.try_cast("int"))) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def _card(match: Column, key: str) -> Column:
    def new(digits: Column) -> Column:
        body = permuted_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), "card", key)
        full = _let(body, lambda d: F.concat(
            d, ((10 - luhn(F.concat(d, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn(digits) % 10 == 0, refill(match, full)).otherwise(match)

    return _let(_digits(match), new)


def _phone(match: Column, key: str) -> Column:
    """The country code stays; a number has 8 to 15 digits with it."""
    code = F.regexp_extract(match, r"^\+(1(?=[ .(-]|[0-9]{10}$)|[0-9]{1,3}(?=[ .(-])|[0-9]{1,2})", 0)

    def new(digits: Column) -> Column:
        filled = F.concat(code, refill(F.substr(match, F.length(code) + 1), permuted_digits(digits, "phone", key)))
        return F.when(F.length(digits).between(7, 15), filled).otherwise(match)

    return _let(_digits(F.substr(match, F.length(code) + 1)), new)


def _ipv4(match: Column, key: str) -> Column:
    def new(parts: Column) -> Column:
        value = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
        half = F.lit(65536).cast("long")
        out = _let(permute(value, half, half, "ipv4", key), lambda v: F.concat_ws(
            ".", *[F.shiftright(v, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]))
        return F.when(F.forall(parts, lambda p: p < 256), out).otherwise(match)

    return _let(F.split(match, r"\.").cast("array<long>"), new)


def _ssn(match: Column, key: str) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (F.substring(match, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    value = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def shown(v: Column) -> Column:
        high = _quotient(v, F.lit(9999).cast("long"))
        place = _quotient(high, F.lit(99).cast("long"))
        new_area = place + F.when(place >= 665, 2).otherwise(1)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in (
            (new_area, 3), (high % 99 + 1, 2), (v % 9999 + 1, 4))])

    out = _let(permute(value, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), "ssn", key), shown)
    return F.when(valid, out).otherwise(match)


def _date(match: Column, key: str) -> Column:
    """Years 1900 to 2099. With slashes the month comes first where that is a date."""
    formats = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")
    shapes = (r"^[0-9]{4}-", r"^[0-9]{4}/", r"^[0-9]{2}\.", r"^[0-9]{2}/", r"^[0-9]{2}/")
    out = match
    for layout, shape in reversed(list(zip(formats, shapes))):
        iso = F.regexp_replace(match, "^([0-9]{2}).([0-9]{2}).([0-9]{4})$",
                               "$3-$1-$2" if layout.startswith("MM") else "$3-$2-$1")
        day = F.regexp_replace(iso, "/", "-").try_cast("date")
        number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        a, b = (F.lit(n).cast("long") for n in DAYS)
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), permute(number, a, b, "date", key).cast("int"))
        fits = match.rlike(shape) & F.coalesce(F.year(day).between(*YEARS), F.lit(False))
        out = F.when(fits, F.date_format(new, layout)).otherwise(out)
    return out


def _iban(match: Column, key: str) -> Column:
    """Country and letters stay, the other digits are permuted by up to 18 at a time."""
    def new(plain: Column) -> Column:
        body = _digits(F.substr(plain, F.lit(5)))
        mixed = F.concat(*[
            F.when(F.length(body) > at, permuted_digits(F.substr(body, F.lit(at + 1), F.lit(18)), f"iban{at}", key))
            .otherwise("") for at in (0, 18)])
        text = F.concat(F.substring(plain, 1, 2), F.lit("00"), refill(F.substr(plain, F.lit(5)), mixed))
        checked = _let(text, lambda t: F.concat(
            F.lpad((98 - mod97(t)).cast("string"), 2, "0"), _digits(F.substr(t, F.lit(5)))))
        return F.when((mod97(plain) == 1) & (F.length(body) > 0), refill(match, checked)).otherwise(match)

    return _let(F.regexp_replace(match, " ", ""), new)


def _email(match: Column, key: str) -> Column:
    digest = _keyed(key, F.lit("email"), F.lower(match))
    return F.concat(F.lit("user"), F.substring(digest, 1, 16), F.lit("@example.org"))


def _secret(match: Column, key: str) -> Column:
    return F.substr(_keyed(key, F.lit("secret"), match), F.lit(1), F.length(match))


RULES: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "secret": _secret, "date": _date, "iban": _iban,
    "ipv4": _ipv4, "ssn": _ssn, "card": _card, "phone": _phone,
}


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one value found by :data:`ANY`, or the value if it fails its check."""
    shapes = {
        "email": "@", "secret": "^[0-9A-Fa-f]{32,64}$",
        "date": r"^(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$",
        "iban": "^[A-Z]{2}", "ipv4": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
        "card": "^[0-9]{13,19}$|^[0-9]{4}[ -]",
    }
    out = RULES["phone"](match, key)
    for kind, shape in reversed(shapes.items()):
        out = F.when(match.rlike(shape), RULES[kind](match, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_replaced``, their number.

    A null text stays null and has nothing replaced; text between values is untouched.
    All other columns stay; one named ``n_replaced`` is overwritten.
    """
    raw = F.col(text).cast("string")
    found = F.when(raw.rlike("[0-9@]"), F.regexp_extract_all(raw, F.lit(ANY), F.lit(0)))
    new = F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
    marked = docs.withColumn("_new", new)
    joined = F.array_join(F.flatten(F.zip_with(
        F.split(raw, ANY, -1), F.col("_new.new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    number = F.size(F.filter("_new", lambda m: m["old"] != m["new"]))
    some = F.coalesce(F.size("_new") > 0, F.lit(False))
    return (
        marked.withColumn("n_replaced", F.when(some, number).otherwise(0))
        .withColumn(text, F.when(some, joined).otherwise(raw))
        .drop("_new")
    )


def pii(docs: DataFrame, key: str = "pseudonyms-1") -> DataFrame:
    """``(doc_id, text, n_replaced)`` for every row of ``docs``; a null text is empty.

    Repeated rows get the same pseudonyms. No documents give no rows.
    """
    return pseudonymised(docs.select("doc_id", whole_text().alias("text")), key)
