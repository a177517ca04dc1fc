"""Pseudonyms against a plain Python version of the same permutations."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pagelake.llm import pii
from pagelake.llm.common import table

KEY = "k"
FOUND = [
    "+1 (743) 555-3824", "227.5.221.1", "4179672074533673", "4179 6720 7453 3673", "st.16@mail2.example.com",
    "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "123-45-6789", "2020-02-29", "31.12.1999",
    "12/31/1999", "31/12/1999", "1999/12/31", "743-555-3824", "(743) 555-3824", "+49 30 1234567",
]
LEFT = [
    "4179672074533674", "2390409500648960", "300.1.1.1", "1.2.3.4.5", "GB82WEST12345698765431", "000-12-3456",
    "666-12-1234", "2021-02-29", "1899-12-31", "32.12.1999", "12345", "v1.2.3.4", "a@b", "04dbebab91ab85687d33eeaaf9ac699e",
]


def python_permuted(value, a, b, kind, key=KEY):
    left, right = divmod(value, b)
    for i in range(pii.ROUNDS):
        half = right if i % 2 == 0 else left
        turn = int(hashlib.sha256(f"{key}|{kind}|{i}|{half}|{key}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + turn) % a
        else:
            right = (right + turn) % b
    return left * b + right


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def replaced(llm, texts, key=KEY):
    rows = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.pii(rows, key).collect()}


def test_found_and_left(llm):
    got = replaced(llm, [f"see {v}, then" for v in FOUND] + [f"see {v}, then" for v in LEFT])
    for n, value in enumerate(FOUND):
        text = got[n]["text"]
        assert got[n]["n_replaced"] == 1 and text.startswith("see ") and text.endswith(", then"), value
        new = text[4:-6]
        assert new != value
        if "@" not in value and value.count(".") != 3:
            shape = lambda t: re.sub("[0-9]", "9", t)
            assert shape(new) == shape(value)
    for n, value in enumerate(LEFT, len(FOUND)):
        assert got[n]["text"] == f"see {value}, then" and got[n]["n_replaced"] == 0, value


def test_values_joined_by_commas(llm):
    values = ["4179672074533673", "2020-02-29", "123-45-6789", "10.0.0.1", "GB82WEST12345698765432", "743-555-3824", "31.12.1999"]
    got = replaced(llm, [",".join(values), ",".join(reversed(values)), "1.2.3.4.5,10.4179672074533673", "3.2020-02-29.5"])
    for n in (0, 1):
        new = got[n]["text"].split(",")
        assert got[n]["n_replaced"] == len(new) == len(values) and not set(new) & set(values)
        assert not any(v in got[n]["text"] for v in values)
    assert sorted(got[0]["text"].split(",")) == sorted(got[1]["text"].split(","))
    assert got[2]["n_replaced"] == got[3]["n_replaced"] == 0


def test_account_numbers_end_where_they_end(llm):
    accounts = ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]
    tails = ["", " EUR", " 2024", " AB12 CD34", ", 12", " ABC"]
    got = replaced(llm, [f"to {a}{t}" for a in accounts for t in tails] + [f"{a} 4179 6720 7453 3673" for a in accounts]
                   + [f"{a} 2020-02-29" for a in accounts])
    alone = {a: got[len(tails) * n]["text"][3:] for n, a in enumerate(accounts)}
    for n, a in enumerate(accounts):
        assert alone[a] != a and len(alone[a]) == len(a) and alone[a][:2] == a[:2]
        for m, t in enumerate(tails):
            assert got[len(tails) * n + m]["text"] == f"to {alone[a]}{t}"
            assert got[len(tails) * n + m]["n_replaced"] == 1
    for n in range(24, 32):
        a = accounts[n % 4]
        assert got[n]["n_replaced"] == 2 and got[n]["text"].startswith(f"{alone[a]} ")


def test_permutations_equal_python(llm):
    got = replaced(llm, ["4179672074533673", "227.5.221.1", "2020-02-29", "123-45-6789", "+1 (743) 555-3824"])
    body = f"{python_permuted(417967207453367, 10**8, 10**7, 'card'):015d}"
    check = next(c for c in "0123456789" if luhn(body + c) == 0)
    assert got[0]["text"] == body + check
    value = python_permuted(int.from_bytes(bytes([227, 5, 221, 1])), 65536, 65536, "ipv4")
    assert got[1]["text"] == ".".join(map(str, value.to_bytes(4)))
    import datetime as dt

    first = dt.date(1900, 1, 1)
    day = python_permuted((dt.date(2020, 2, 29) - first).days, *pii.DAYS, "date")
    assert got[2]["text"] == str(first + dt.timedelta(day))
    area, group, serial = 123, 45, 6789
    value = python_permuted(((area - 1) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
    high, low = divmod(value, 9999)
    place, new_group = divmod(high, 99)
    assert got[3]["text"] == f"{place + (2 if place >= 665 else 1):03d}-{new_group + 1:02d}-{low + 1:04d}"
    digits = f"{python_permuted(7435553824, 10**5, 10**5, 'phone'):010d}"
    assert got[4]["text"] == f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}"


def test_permutation_is_one(llm):
    rows = llm.range(1000).select(
        pii.permute(F.col("id"), F.lit(40).cast("long"), F.lit(25).cast("long"), "t", KEY).alias("v"))
    assert sorted(r["v"] for r in rows.collect()) == list(range(1000))


def test_equal_values_stay_linked(llm):
    got = replaced(llm, ["a 4179672074533673 b 4179-6720-7453-3673", "4179672074533673!!", "31.12.1999 1999-12-31", "1999/12/31"])
    first, second = re.findall(r"[0-9][0-9-]{14,}", got[0]["text"])
    assert first == second.replace("-", "") == got[1]["text"][:-2] and luhn(first) == 0
    day, iso = got[2]["text"].split()
    assert day.split(".") == iso.split("-")[::-1] and got[3]["text"].replace("/", "-") == iso
    assert replaced(llm, ["4179672074533673"], "other")[0]["text"] != got[1]["text"][:-2]


def test_odd_rows(llm, odd_documents):
    got = pii.pii(odd_documents).collect()
    want = [(r["doc_id"], r["text"] or "", 0) for r in odd_documents.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert pii.pii(odd_documents.limit(0)).collect() == []
    long = "+1 (743) 555-3824 " + "wort " * 50_000 + "x" * 100_000 + " 227.5.221.1"
    text = replaced(llm, [long])[0]["text"]
    assert len(text) >= len(long) - 12 and "555-3824" not in text and "227.5.221.1" not in text


@pytest.mark.parametrize("kind", ["phone", "ipv4", "card", "email"])
def test_nothing_of_the_given_values_remains(llm, sf, kind):
    """Values found with plainer patterns, in all documents."""
    plain = {
        "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.]*[0-9])",
        "card": r"(?<![0-9a-z])[0-9]{16}(?![0-9a-z])", "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    }[kind]
    docs = {r["doc_id"]: r["text"] for r in table(llm, sf, "documents").collect()}
    new = {r["doc_id"]: r["text"] for r in pii.pii(table(llm, sf, "documents")).collect()}
    seen = 0
    for doc, text in docs.items():
        for value in re.findall(plain, text):
            if kind == "card" and luhn(value):
                assert value in new[doc]
                continue
            if kind == "ipv4" and any(int(p) > 255 for p in value.split(".")):
                continue
            seen += 1
            assert value not in new[doc]
        if not re.search("[0-9@]", text):
            assert new[doc] == text
    assert seen


def test_native(llm, sf):
    plan = pii.pii(table(llm, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
