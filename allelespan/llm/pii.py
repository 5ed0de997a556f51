"""Format-preserving pseudonyms for personal data, in Spark's own functions only.

Found are e-mail addresses, payment card numbers (Luhn), dates (1900 to 2099), US social security numbers, phone numbers and IPv4
addresses. What passes the check of its kind is written as a number pair (left, right) below (a, b), the sizes of the
values its format allows, and permuted by a keyed Feistel network on Z_a x Z_b. The result is a valid value of the same format and
length: a card keeps its first digit and passes Luhn, an address keeps the number of digits of each part, a date stays a date.
The local part of an e-mail address goes through the same network on the characters of its two halves, letters staying letters and digits digits.

A permutation has no collisions: equal values get equal pseudonyms in every document, different ones different pseudonyms, and
whoever has the key can undo it (``undo=True``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelespan.llm.arrow_columns import free_name

ROUNDS = 8
KINDS = ("email", "card", "phone", "ip", "ssn", "date")

# after a mark, too, unless the mark follows a digit: no number is entered in its middle
_BEFORE = r"(?<![0-9A-Za-z+@_])(?<![0-9][.\-/])"
_AFTER = r"(?![0-9A-Za-z_@]|[.\-/][0-9])"
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
_IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
_ABROAD = r"\+[2-9][0-9]{0,2}[ .-]?\(0\)(?:[ .-]?[0-9]){6,13}|\+[2-9](?:[ .-]?[0-9]){7,14}"
#: Country codes of one and of two digits; all others have three.
_SHORT_CODE = r"^\+(7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_CARD = r"(?:[0-9]{4}[ -]){4}[0-9]{3}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19}"
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+"


def _phone_form(any_area: bool) -> str:
    three = "[0-9]{3}" if any_area else "[2-9][0-9]{2}"
    return rf"\+1{three}{three}[0-9]{{4}}|(?:\+1[ .-]?|1[ .-])?(?:\({three}\)[ .-]?|{three}[ .-]){three}[ .-][0-9]{{4}}"


def _pattern(any_area: bool) -> str:
    """Every candidate; runs are entered at their start only, so long texts without spaces stay linear."""
    return f"{_BEFORE}(?=[0-9+(])(?:{_DATE}|{_SSN}|{_phone_form(any_area)}|{_ABROAD}|{_CARD}|{_IP}){_AFTER}|{_EMAIL}"


_LEAP_YEARS = 49  # 1904, 1908, ... 2096


def _hash(key: str, kind: str, turn: Column, value: Column, a: Column, b: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), a.cast("string"), b.cast("string"), turn.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint")


def _turns(undo: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))


def _permuted(key: str, kind: str, undo: bool, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(l, r): the pair (left, right) after the keyed rounds; left below a, right below b."""
    sign = -1 if undo else 1

    def turn(pair: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(pair["l"] + sign * (_hash(key, kind, i, pair["r"], a, b) % a), a)).otherwise(pair["l"]).alias("l"),
            F.when(odd, pair["r"]).otherwise(F.pmod(pair["r"] + sign * (_hash(key, kind, i, pair["l"], a, b) % b), b)).alias("r"),
        )

    return F.aggregate(_turns(undo), F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _number(text: Column, start, length) -> Column:
    return text.substr(F.lit(start) if isinstance(start, int) else start, F.lit(length) if isinstance(length, int) else length).cast("bigint")


def _padded(number: Column, width) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _in_place(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, one for one, by those of ``digits``."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))

    def put(state: Column, char: Column) -> Column:
        digit = char.between("0", "9")
        return F.struct(
            F.concat(state["text"], F.when(digit, digits.substr(state["at"], F.lit(1))).otherwise(char)).alias("text"),
            (state["at"] + digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(value, ""), start, put)["text"]


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a number whose last digit is its check digit."""

    def add(state: Column, char: Column) -> Column:
        digit = char.cast("int")
        twice = digit * 2
        return F.struct((state["total"] + F.when(state["odd"], F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)).alias("total"), (~state["odd"]).alias("odd"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("total"), F.lit(False).alias("odd")), add)["total"]


def _card(key: str, undo: bool, value: Column) -> Column:
    def use(digits: Column) -> Column:
        free = F.length(digits) - 2
        half = F.floor(free / 2).cast("int")
        a, b = F.pow(F.lit(10.0), half).cast("bigint"), F.pow(F.lit(10.0), free - half).cast("bigint")
        pair = _permuted(key, "card", undo, _number(digits, 2, half), _number(digits, half + 2, free - half), a, b)
        body = _with(pair, lambda p: F.concat(F.substring(digits, 1, 1), _padded(p["l"], half), _padded(p["r"], free - half)))
        checked = _with(body, lambda x: F.concat(x, F.pmod(-_luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))
        valid = (_luhn(digits) % 10 == 0) & ~digits.rlike("^(.)\\1*$")
        return F.when(valid, _in_place(value, checked))

    return _with(_digits(value), use)


def _ssn(key: str, undo: bool, value: Column) -> Column:
    area, group, serial = _number(value, 1, 3), _number(value, 5, 2), _number(value, 8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    left = area - 1 - (area > 666).cast("int")
    pair = _permuted(key, "ssn", undo, left, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    new = _with(pair, lambda p: F.concat_ws("-", _padded(p["l"] + 1 + (p["l"] >= 665).cast("int"), 3), _padded(F.floor(p["r"] / 9999) + 1, 2), _padded(p["r"] % 9999 + 1, 4)))
    return F.when(valid, new)


def _phone(key: str, undo: bool, value: Column) -> Column:
    def use(digits: Column) -> Column:
        size = F.length(digits)
        start = size - 9  # a leading 1 is kept
        area, exchange = _number(digits, start, 3), _number(digits, start + 3, 3)
        # numbers below 200 stay below 200, the others above, so that those of the numbering plan stay in it
        low_area, low_exchange = (F.when(x < 200, F.lit(0)).otherwise(F.lit(200)) for x in (area, exchange))
        areas, exchanges = (F.when(x < 200, F.lit(200)).otherwise(F.lit(800)) for x in (area, exchange))
        pair = _permuted(key, "phone", undo, (area - low_area) * exchanges + exchange - low_exchange, _number(digits, start + 6, 4), areas * exchanges, F.lit(10_000))
        new = _with(pair, lambda p: F.concat(digits.substr(F.lit(1), size - 10), _padded(F.floor(p["l"] / exchanges) + low_area, 3), _padded(p["l"] % exchanges + low_exchange, 3), _padded(p["r"], 4)))
        return _in_place(value, new)

    return _with(_digits(value), use)


def _abroad(key: str, undo: bool, value: Column) -> Column:
    def use(digits: Column) -> Column:
        first, short = F.length(F.regexp_extract(value, r"^\+([0-9]+)", 1)), F.length(F.regexp_extract(value, _SHORT_CODE, 1))
        code = F.when(first <= 3, first).when(short > 0, short).otherwise(3) + value.contains("(0)").cast("int")
        free = F.length(digits) - code
        half = F.floor(free / 2).cast("int")
        a, b = F.pow(F.lit(10.0), half).cast("bigint"), F.pow(F.lit(10.0), free - half).cast("bigint")
        pair = _permuted(key, "abroad", undo, _number(digits, code + 1, half), _number(digits, code + 1 + half, free - half), a, b)
        new = _with(pair, lambda p: F.concat(digits.substr(F.lit(1), code), _padded(p["l"], half), _padded(p["r"], free - half)))
        return _in_place(value, new)

    return _with(_digits(value), use)


def _ip(key: str, undo: bool, value: Column) -> Column:
    def low(size: Column) -> Column:
        return F.when(size == 1, F.lit(0)).when(size == 2, F.lit(10)).otherwise(F.lit(100))

    def count(size: Column) -> Column:
        return F.when(size == 1, F.lit(10)).when(size == 2, F.lit(90)).otherwise(F.lit(156))

    def use(parts: Column) -> Column:
        number = [F.element_at(parts, k).cast("int") for k in range(1, 5)]
        size = [F.length(F.element_at(parts, k)) for k in range(1, 5)]
        lows, counts = [low(x) for x in size], [count(x) for x in size]
        valid = F.lit(True)
        for k in range(4):
            valid = valid & (number[k] >= lows[k]) & (number[k] < lows[k] + counts[k])
        pair = _permuted(key, "ip", undo, (number[0] - lows[0]) * counts[1] + number[1] - lows[1], (number[2] - lows[2]) * counts[3] + number[3] - lows[3], counts[0] * counts[1], counts[2] * counts[3])
        new = _with(
            pair,
            lambda p: F.concat_ws(
                ".",
                (F.floor(p["l"] / counts[1]) + lows[0]).cast("string"),
                (p["l"] % counts[1] + lows[1]).cast("string"),
                (F.floor(p["r"] / counts[3]) + lows[2]).cast("string"),
                (p["r"] % counts[3] + lows[3]).cast("string"),
            ),
        )
        return F.when(valid, new)

    return _with(F.split(value, r"\."), use)


def _date(key: str, undo: bool, value: Column) -> Column:
    """Years 1900 to 2099 times the 365 days of a common year; 29 February goes to another leap year's."""
    iso = value.substr(5, 1) == "-"
    slashed = value.substr(3, 1) == "/"
    written = F.when(iso, value).when(slashed, F.concat_ws("-", value.substr(7, 4), value.substr(1, 2), value.substr(4, 2))).otherwise(F.concat_ws("-", value.substr(7, 4), value.substr(4, 2), value.substr(1, 2)))

    def shown(year: Column, month_day: Column) -> Column:
        y, m, d = year.cast("string"), month_day.substr(1, 2), month_day.substr(4, 2)
        return F.when(iso, F.concat_ws("-", y, m, d)).when(slashed, F.concat_ws("/", m, d, y)).otherwise(F.concat_ws(".", d, m, y))

    def use(text: Column) -> Column:
        year = _number(text, 1, 4)
        day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
        leap_day = text.substr(6, 5) == "02-29"
        # the day's number in a year without 29 February
        common = F.datediff(F.try_to_timestamp(F.concat(F.lit("2001-"), text.substr(6, 5)), F.lit("yyyy-MM-dd")).cast("date"), F.lit("2001-01-01").cast("date"))
        pair = _permuted(key, "date", undo, year - 1900, F.coalesce(common, F.lit(0)), F.lit(200), F.lit(365))
        new = _with(pair, lambda p: shown(p["l"] + 1900, F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), p["r"].cast("int")), "MM-dd")))
        leap = _with(_permuted(key, "leap", undo, F.floor((year - 1904) / 4), F.lit(0), F.lit(_LEAP_YEARS), F.lit(1)), lambda p: shown(p["l"] * 4 + 1904, F.lit("02-29")))
        return F.when(day.isNotNull() & year.between(1900, 2099), F.when(leap_day, leap).otherwise(new))

    return _with(written, use)


def _email(key: str, undo: bool, value: Column) -> Column:
    """The same network on two halves of characters: each is shifted within its alphabet by the hash of the other half."""
    sign = -1 if undo else 1

    def shifted(half: Column, other: Column, i: Column) -> Column:
        def one(char: Column, place: Column) -> Column:
            digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), i.cast("string"), place.cast("string"), other), 256)
            step = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")

            def move(first: str, size: int) -> Column:
                return F.chr((F.pmod(F.ascii(char) - ord(first) + sign * (step % size), F.lit(size)) + ord(first)).cast("bigint"))

            return F.when(char.between("a", "z"), move("a", 26)).when(char.between("A", "Z"), move("A", 26)).when(char.between("0", "9"), move("0", 10)).otherwise(char)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def turn(pair: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, shifted(pair["l"], pair["r"], i)).otherwise(pair["l"]).alias("l"), F.when(odd, pair["r"]).otherwise(shifted(pair["r"], pair["l"], i)).alias("r"))

    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    half = F.floor(F.length(local) / 2).cast("int")
    start = F.struct(local.substr(F.lit(1), half).alias("l"), local.substr(half + 1, F.length(local)).alias("r"))
    return _with(F.aggregate(_turns(undo), start, turn), lambda p: F.concat(p["l"], p["r"], F.lit("@"), domain))


def _replacement(key: str, undo: bool, any_area: bool, value: Column) -> Column:
    """struct(kind, value): the pseudonym of one candidate, or kind null and the candidate itself if it is not valid."""

    def exactly(pattern: str) -> Column:
        return value.rlike(f"^(?:{pattern})$")

    kinds = [
        ("email", value.contains("@"), _email),
        ("date", exactly(_DATE), _date),
        ("ssn", exactly(_SSN), _ssn),
        ("phone", exactly(_phone_form(any_area)), _phone),
        ("phone", exactly(_ABROAD), _abroad),
        ("ip", exactly(_IP), _ip),
    ]
    kind, new = F, F
    for name, test, make in kinds:
        kind, new = kind.when(test, F.lit(name)), new.when(test, make(key, undo, value))
    pair = F.struct(kind.otherwise(F.lit("card")).alias("kind"), new.otherwise(_card(key, undo, value)).alias("value"))
    return _with(pair, lambda p: F.struct(F.when(p["value"].isNotNull(), p["kind"]).alias("kind"), F.coalesce(p["value"], value).alias("value")))


def pseudonymize(documents: DataFrame, key: str, *, text: str = "text", into: str = "pii", undo: bool = False, any_area: bool = False) -> DataFrame:
    """``documents`` with personal data in ``text`` replaced, and the kinds replaced, in order, in ``into``.

    Null texts stay null with an empty list; empty texts and texts without personal data stay as they are. Candidates
    that fail the check of their kind stay. An existing column named ``into`` is replaced, all others stay, and so do repeated rows.
    Without ``any_area`` only phone numbers of the North American plan count (area and exchange begin with 2 to 9); with it any three digits
    do. ``undo`` needs the same setting.
    """
    names = [c for c in documents.columns if c.lower() != into.lower()]
    hit_name, found_name = free_name(documents, "hits"), free_name(documents, "found")
    whole, pattern = F.col(text), _pattern(any_area)
    hits = F.when(whole.rlike("[0-9@]"), F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = documents.select(*names, F.coalesce(hits, F.array().cast("array<string>")).alias(hit_name))
    found = found.select(*names, F.transform(hit_name, lambda h: _replacement(key, undo, any_area, h)).alias(found_name))
    joined = F.array_join(F.zip_with(F.split(whole, pattern, -1), found_name, lambda between, f: F.concat(between, F.coalesce(f["value"], F.lit("")))), "")
    replaced = F.when(F.size(found_name) > 0, joined).otherwise(whole).alias(text)
    kinds = F.filter(F.transform(found_name, lambda f: f["kind"]), lambda k: k.isNotNull()).alias(into)
    return found.select(*[replaced if c == text else F.col(c) for c in names], kinds)


def pii_report(documents: DataFrame, key: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its pseudonymised text and how many values of each kind were replaced; phone numbers of any area."""
    done = pseudonymize(documents.select(doc_id, text), key, text=text, any_area=True)

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")

    return done.select(doc_id, F.col(text).alias("text"), *map(count, KINDS))
