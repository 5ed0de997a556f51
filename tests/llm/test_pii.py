"""Pseudonyms against a second, plain implementation of the network."""

import hashlib
import re
from datetime import date, timedelta

import pytest
from llm_fixtures import awkward

from allelespan.llm import pii

KEY = "test-key"


def turned(kind, left, right, a, b):
    def step(turn, value):
        return int(hashlib.sha256(f"{KEY}:{kind}:{a}:{b}:{turn}:{value}".encode()).hexdigest()[:14], 16)

    for turn in range(1, pii.ROUNDS + 1):
        if turn % 2:
            left = (left + step(turn, right) % a) % a
        else:
            right = (right + step(turn, left) % b) % b
    return left, right


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def card(digits):
    if not luhn(digits) or len(set(digits)) == 1:
        return digits
    free = len(digits) - 2
    half = free // 2
    left, right = turned("card", int(digits[1 : 1 + half]), int(digits[1 + half : -1]), 10**half, 10 ** (free - half))
    body = f"{digits[0]}{left:0{half}}{right:0{free - half}}"
    return next(body + d for d in "0123456789" if luhn(body + d))


def email(text):
    local, domain = text.split("@")
    halves = [local[: len(local) // 2], local[len(local) // 2 :]]
    for turn in range(1, pii.ROUNDS + 1):
        mine, other = (0, 1) if turn % 2 else (1, 0)
        out = ""
        for place, char in enumerate(halves[mine]):
            first, size = next(((f, n) for f, n in (("a", 26), ("A", 26), ("0", 10)) if ord(f) <= ord(char) < ord(f) + n), ("", 0))
            step = int(hashlib.sha256(f"{KEY}:email:{turn}:{place}:{halves[other]}".encode()).hexdigest()[:8], 16)
            out += chr((ord(char) - ord(first) + step) % size + ord(first)) if size else char
        halves[mine] = out
    return "".join(halves) + "@" + domain


def iso(text):
    year, month, day = map(int, text.split("-"))
    if (month, day) == (2, 29):
        return f"{turned('leap', (year - 1904) // 4, 0, 49, 1)[0] * 4 + 1904}-02-29"
    left, right = turned("date", year - 1900, (date(2001, month, day) - date(2001, 1, 1)).days, 200, 365)
    return f"{left + 1900}-{date(2001, 1, 1) + timedelta(right):%m-%d}"


def texts_of(df):
    return [r.text for r in df.orderBy("doc_id").collect()]


def test_equals_the_plain_network(frame):
    cards = ["4934796579598836", "378282246310005", "6011111111111117", "4934796579598837", "4444444444444444"]
    mails = ["cmsbsrgg.54@mail8.example.com", "A@b.co", "x.Y-9_z%q+1@a-b.c.org"]
    days = ["1984-02-29", "2001-12-31", "1900-01-01", "2099-12-31", "2024-03-01"]
    rows = [(k, v) for k, v in enumerate([*cards, *mails, *days])]
    got = texts_of(pii.pseudonymize(frame(rows, "doc_id bigint, text string"), KEY))
    assert got == [*map(card, cards), *map(email, mails), *map(iso, days)]


VALUES = {
    "email": ["a.b7@mail.example.com", "kfslg.71@mail0.example.com"],
    "card": ["4934796579598836", "4934 7965 7959 8836", "4934-7965-7959-8836"],
    "phone": ["+1 (933) 555-7070", "(933) 555-7070", "933-555-7070", "+49 30 1234567"],
    "ip": ["66.194.181.124", "9.10.255.0"],
    "ssn": ["123-45-6789", "899-99-9999"],
    "date": ["2001-12-31", "12/31/1999", "29.02.2000"],
}


def test_formats_stay_and_undo_restores(frame):
    values = [(kind, v) for kind, all_of in VALUES.items() for v in all_of]
    invalid = ["4934796579598837", "666-12-3456", "000-12-3456", "300.1.1.1", "1.2.3", "2001-02-29", "31.04.2000", "13/13/2000", "1899-12-31", "version 3.", "+1 (133) 555-7070", "a@b", "12345678901234567890", "x4934796579598836"]
    rows = [(k, f"see {v}, and again {v}.") for k, (_, v) in enumerate(values)] + [(100 + k, v) for k, v in enumerate(invalid)]
    df = frame(rows, "doc_id bigint, text string")
    hidden = pii.pseudonymize(df, KEY)
    got = {r.doc_id: r for r in hidden.collect()}
    for k, (kind, value) in enumerate(values):
        assert got[k].pii == [kind, kind], value
        first, second = re.fullmatch(r"see (.*), and again (.*)\.", got[k].text).groups()
        assert first == second != value and len(first) == len(value)
        assert re.sub("[0-9]", "9", first) == re.sub("[0-9]", "9", value) or kind == "email"
    for k, value in enumerate(invalid):
        assert (got[100 + k].text, got[100 + k].pii) == (value, []), value
    assert texts_of(pii.pseudonymize(hidden, KEY, undo=True)) == texts_of(df)
    assert texts_of(pii.pseudonymize(df, "other")) != texts_of(hidden)
    # the same number in another spelling stays the same number
    digits = {re.sub("[^0-9]", "", re.search("see (.*),", got[k].text)[1]) for k, (kind, _) in enumerate(values) if kind == "card"}
    assert len(digits) == 1


@pytest.mark.parametrize("first, last", [("10.0.0.0", 10), ("1.1.1.0", 10)])
def test_different_values_stay_different(frame, first, last):
    stem = first.rsplit(".", 1)[0]
    rows = [(k, f"{stem}.{k}") for k in range(last)]
    assert len(set(texts_of(pii.pseudonymize(frame(rows, "doc_id bigint, text string"), KEY)))) == last


def test_awkward_rows(odd, nothing):
    done = pii.pseudonymize(odd, KEY)
    assert set(done.columns) == {*odd.columns, "pii"} and done.count() == odd.count()
    got = {r.doc_id: r for r in done.filter("doc_id IN (1, 2, 12, 15)").collect()}
    assert got[1].text is None and got[1].pii == [] and got[2].text == "" and got[12].text == awkward()[12][1]
    assert got[15].pii == ["email", "card"] and got[15].hits == "h"
    assert pii.pseudonymize(nothing, KEY).count() == 0


def test_only_native_operations(odd):
    plan = pii.pii_report(odd, KEY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


FORMS = {
    "phone": """+1 (136) 555-7479|(036) 155-7479|+12125550100|+1 212 555 0100|212 555 0100|1-800-555-0100|(212)-555-0100|+491701234567|+35312345678|+44 20 7946 0958
        |+44 (0)20 7946 0958|+33 6 12 34 56 78|Tel.212-555-0100|/212-555-0100""",
    "ip": "233.254.104.120|0.0.0.0|255.255.255.255|host-10.0.0.1",
    "card": "3782 822463 10005|3782-822463-10005|card-4111111111111111|no.4111 1111 1111 1111|/378282246310005",
}


def test_every_written_form_is_replaced_and_restored(frame):
    values = [(kind, v.strip()) for kind, forms in FORMS.items() for v in forms.split("|")]
    df = frame([(k, f"see {v} here") for k, (_, v) in enumerate(values)], "doc_id bigint, text string")
    hidden = pii.pseudonymize(df, KEY, any_area=True)
    got = {r.doc_id: r for r in hidden.collect()}
    for k, (kind, value) in enumerate(values):
        plain = f"see {value} here"
        assert got[k].pii == [kind] and got[k].text != plain, value
        assert re.sub("[0-9]", "9", got[k].text) == re.sub("[0-9]", "9", plain), value
    assert texts_of(pii.pseudonymize(hidden, KEY, undo=True, any_area=True)) == texts_of(df)
    report = {r.doc_id: r for r in pii.pii_report(df, KEY).collect()}
    assert all(report[k][f"n_{kind}"] == 1 and report[k].text == got[k].text for k, (kind, _) in enumerate(values))
