"""Format-preserving pseudonyms by a keyed Feistel permutation.

Validated values are replaced by others of their format, one to one: with one key
equal values get equal pseudonyms in every document, so they stay linked, and
whoever has the key can invert them. Values are validated first; digits that only
look alike (a number that fails its check digit, a date that does not exist) stay.

kind   valid if                                     permuted over
card   13-19 digits, Luhn                           all digits but the last; check digit made anew
iban   mod 97                                       letters and digits of the account, each in its class; check digits made anew
phone  +country and 7 to 14 digits, or aaa bbb cccc  the digits without the country's, among those of their number
ssn    aaa-bb-cccc, no forbidden group              898 x 99 x 9,999 numbers
ipv4   four numbers up to 255                       2 ** 32 addresses
date   y-m-d, d/m/y, d.m.y from 1900 to 2099        73,049 days
       m/d/y that is no d/m/y (day 13 to 31)        the days of 1900 to 2099 of that form: days 13-28 together, 29, 30, 31 each
email  local@domain                                 letters and digits of the local part, each in its class

A number is split as v = L * b + R and L, R are shifted in turn by a keyed hash of
the other (mod a, mod b): a generalised Feistel network, a permutation of a * b
values whatever the round function is. Separators and letter case stay.

A run of digit groups can hold more than a card (a year before it, an expiry date
after it). Where the whole run is no card, the first stretch of whole groups that is
one by Luhn and by a scheme's prefix and length is taken, then the next one behind it.

Left as they are: years and times alone, dates with one-digit parts or month names,
national numbers outside aaa bbb cccc, digits inside words.

Scale: native DataFrame functions only, one narrow pass, no shuffle. Texts without
a candidate leave after one regular expression. Every pattern is possessive or
bounded, so a text of any length is read in linear time without a deep stack.

Defined results: a null text stays null, an empty one empty; repeated rows stay;
ids are carried as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The session setting with the secret key; it must be set wherever pseudonyms leave the test data.
KEY_SETTING = "spark.paralogic.pii.key"
#: The key of the registered query where none is set: good for tests only.
TEST_KEY = "test-data-only"
ROUNDS = 8

_EDGE, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
#: Kinds looked for first; what stands between their matches is searched for cards.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,20}\.[A-Za-z]{2,63}(?![A-Za-z0-9])",
    "iban": _EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "phone": r"(?<![A-Za-z0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,8})){2,6}(?![A-Za-z0-9])|(?<![A-Za-z0-9+.-])(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|(?<![0-9] )[0-9]{3} [0-9]{3}[ -][0-9]{4}(?! [0-9]))(?![A-Za-z0-9])(?![.-][0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![A-Za-z0-9/-])(?!\.[0-9])",
    "ipv4": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9])(?!\.[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Digit groups with single separators, 13 digits at least; a group that runs into a letter ends it.
RUN = r"(?<![A-Za-z0-9])(?<![0-9]-)(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -][0-9]++(?![A-Za-z]))*+"
#: Prefixes and lengths of card schemes (fixed values, public).
SCHEME = (
    "^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}"
    "|3(?:0[0-5]|[689][0-9])[0-9]{11}|35[0-9]{14,17}|6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12,15}|62[0-9]{14,17}|(?:50|5[6-9]|6[0-9])[0-9]{11,17})$"
)
#: Texts without a match of this cannot hold a candidate.
HINT = r"@|[0-9][0-9 .()/-]{5}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"


def _hash(key: str, kind: str, step: Column, value: Column) -> Column:
    """Keyed round function: 52 bits of SHA-256."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permute(value: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """The keyed permutation of 0 .. a * b - 1 (all long)."""
    a, b = a.cast("long"), b.cast("long")
    return bound(value.cast("long"), lambda v: _permute(v, a, b, key, kind))


def _permute(value: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    start = F.struct(F.floor((value - value % b) / b).cast("long").alias("l"), (value % b).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 1, (s["l"] + _hash(key, kind, i, s["r"])) % a).otherwise(s["l"])
        right = F.when(i % 2 == 0, (s["r"] + _hash(key, kind, i, s["l"])) % b).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * b + s["r"])


def permute_digits(digits: Column, key: str, kind: str | Column) -> Column:
    """A digit string permuted among those of its length: the halves are numbers below powers of ten."""
    ten = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")

    def parts(d: Column) -> Column:
        left = F.ceil(F.length(d) / 2).cast("int")
        right = F.length(d) - left
        tag = F.concat(kind if isinstance(kind, Column) else F.lit(kind), F.length(d).cast("string"))
        return F.struct(left.alias("nl"), right.alias("nr"), ten(left).alias("a"), ten(right).alias("b"), tag.alias("tag"), d.substr(F.lit(1), left).cast("long").alias("l"), F.coalesce(d.substr(left + 1, right).cast("long"), F.lit(0)).alias("r"))

    def run(p: Column) -> Column:
        mix = lambda i, v: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), p["tag"], i.cast("string"), v.cast("string")), 256), 1, 13), 16, 10).cast("long")

        def turn(s: Column, i: Column) -> Column:
            return F.struct(F.when(i % 2 == 1, (s["l"] + mix(i, s["r"])) % p["a"]).otherwise(s["l"]).alias("l"), F.when(i % 2 == 0, (s["r"] + mix(i, s["l"])) % p["b"]).otherwise(s["r"]).alias("r"))

        end = lambda s: F.concat(F.lpad(s["l"].cast("string"), p["nl"], F.lit("0")), F.lpad(s["r"].cast("string"), p["nr"], F.lit("0")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(p["l"].alias("l"), p["r"].alias("r")), turn, end)

    return bound(bound(digits, parts), run)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""

    def run(x: Column) -> Column:
        """``x``: the digits as an array, so each is computed once."""
        n = F.size(x)
        each = F.transform(x, lambda c, i: F.when((n - i) % 2 == 1, c.cast("int")).otherwise(F.when(c > "4", c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
        return F.aggregate(each, F.lit(0), lambda t, v: t + v)

    return bound(F.filter(F.split(digits, ""), lambda c: c != ""), run)


def refill(shape: Column, digits: Column, places_of: str = "[0-9]") -> Column:
    """Put ``digits`` in the places of the digits (or other characters) of ``shape``."""

    def run(p: Column) -> Column:
        return F.aggregate(
            p["chars"],
            F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
            lambda s, c: F.when(c.rlike(places_of), F.struct(F.concat(s["out"], p["digits"].substr(s["k"] + 1, F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))),
            lambda s: s["out"],
        )

    return bound(F.struct(F.split(shape, "").alias("chars"), digits.alias("digits")), run)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def card_number(digits: Column, key: str) -> Column:
    """The pseudonym of a valid card number, digits alone."""

    def checked(body: Column) -> Column:
        return F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))

    return bound(permute_digits(digits.substr(F.lit(1), F.length(digits) - 1), key, "card"), checked)


def card_pieces(groups: Column) -> Column:
    """[(first, last)]: groups of a digit run that are cards, in order and apart; the whole run if it is one."""
    n = F.size(groups)
    digits = lambda i, j: F.array_join(F.slice(groups, i, j - i + 1), "")
    all_digits = F.when(n <= 19, F.array_join(groups, "")).otherwise("")
    whole = bound(all_digits, lambda d: F.length(d).between(13, 19) & (luhn_sum(F.when(F.length(d) <= 19, d).otherwise("0")) % 10 == 0))

    def last(i: Column) -> Column:
        """The last group of the longest card that begins with group i, or 0."""
        ends = F.sequence(i, F.least(i + 18, n))
        card = lambda d: F.when(F.length(d).between(13, 19) & d.rlike(SCHEME), luhn_sum(d) % 10 == 0).otherwise(False)
        valid = F.filter(ends, lambda j: bound(digits(i, j), card))
        return F.when(F.element_at(groups, i).rlike("^[23456]"), F.coalesce(F.array_max(valid), F.lit(0))).otherwise(0)

    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("first"), last(i).alias("last")))
    hits = F.filter(ends, lambda e: e["last"] > 0)
    none = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(none.alias("taken"), F.lit(0).alias("upto"))
    walk = F.aggregate(
        hits,
        start,
        lambda s, e: F.when(e["first"] > s["upto"], F.struct(F.concat(s["taken"], F.array(e)).alias("taken"), e["last"].alias("upto"))).otherwise(s),
        lambda s: s["taken"],
    )
    return F.when(whole, F.array(F.struct(F.lit(1).alias("first"), n.alias("last")))).otherwise(walk)


def _filled(groups: Column, separators: Column, pieces: Column, key: str) -> Column:
    """The run again: each card anew, and the groups outside cards, with the separators behind them."""

    def text(i: Column, j: Column) -> Column:
        return F.array_join(F.zip_with(F.slice(groups, i, j - i + 1), F.slice(separators, i, j - i + 1), lambda g, s: F.concat(g, s)), "")

    starts = F.concat(F.array(F.lit(0)), F.transform(pieces, lambda p: p["last"]))
    stops = F.concat(F.transform(pieces, lambda p: p["first"]), F.array(F.size(groups) + 1))
    between = F.zip_with(starts, stops, lambda after, before: F.when(before - after > 1, text(after + 1, before - 1)).otherwise(""))
    cards = F.transform(pieces, lambda p: bound(text(p["first"], p["last"]), lambda t: refill(t, card_number(only_digits(t), key))))
    return F.array_join(F.zip_with(between, F.concat(cards, F.array(F.lit(""))), lambda b, c: F.concat(b, c)), "")


def _run(run: Column, key: str) -> Column:
    """(value, cards): a digit run with its cards replaced."""
    separators = F.concat(F.regexp_extract_all(run, F.lit("[ -]"), F.lit(0)), F.array(F.lit("")))

    def made(pieces: Column, groups: Column) -> Column:
        value = F.when(F.size(pieces) > 0, bound(separators, lambda s: _filled(groups, s, pieces, key))).otherwise(run)
        return F.struct(value.alias("value"), F.size(pieces).alias("cards"))

    return bound(F.split(run, "[ -]"), lambda groups: bound(card_pieces(groups), lambda pieces: made(pieces, groups)))


def with_cards(piece: Column, key: str) -> Column:
    """(value, cards): a text without other candidates, with its cards replaced, and their number."""
    runs = F.transform(F.regexp_extract_all(piece, F.lit(RUN), F.lit(0)), lambda r: _run(r, key))
    ends = F.array(F.lit(""))
    text = lambda made: F.array_join(F.zip_with(F.split(piece, RUN, -1), F.concat(F.transform(made, lambda m: m["value"]), ends), lambda a, b: F.concat(a, b)), "")
    count = lambda made: F.aggregate(made, F.lit(0), lambda t, m: t + m["cards"])
    made = bound(runs, lambda m: F.struct(text(m).alias("value"), count(m).alias("cards")))
    return F.when(piece.rlike(RUN), made).otherwise(F.struct(piece.alias("value"), F.lit(0).alias("cards")))


def mod97(text: Column) -> Column:
    """Remainder by 97 of a string of digits and capitals (A is 10), of any length."""
    step = lambda r, code: F.when(code >= 65, (r * 100 + code - 55) % 97).otherwise((r * 10 + code - 48) % 97)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda r, c: step(r, F.ascii(c)))


def _iban(m: Column, key: str) -> Column:
    def made(plain: Column) -> Column:
        country, account = plain.substr(1, 2), plain.substr(F.lit(5), F.length(plain) - 4)

        def with_check(fresh: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(fresh, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(country, refill(m.substr(F.lit(3), F.length(m)), F.concat(check, fresh), "[A-Z0-9]"))

        valid = mod97(F.concat(account, country, plain.substr(3, 2))) == 1
        return F.when(valid, bound(bound(account, lambda x: permute_classes(x, key, "iban")), with_check))

    return bound(F.replace(m, F.lit(" "), F.lit("")), made)


def _phone(m: Column, key: str) -> Column:
    """+1 and the national form share one permutation, so a number stays linked across both."""

    def made(d: Column) -> Column:
        code = F.when(m.startswith("+"), F.when(d.startswith("1"), F.lit(1)).otherwise(F.length(F.regexp_extract(m, r"^\+([0-9]+)", 1)))).otherwise(0)

        def filled(code: Column) -> Column:
            kind = F.concat(F.lit("phone"), F.when(code == 0, F.lit("1")).otherwise(d.substr(F.lit(1), code)), F.lit("/"))
            fits = (code == 0) | F.length(d).between(8, 15) & (F.length(d) - code).between(6, 14)
            fresh = bound(d.substr(code + 1, F.length(d)), lambda own: permute_digits(own, key, kind))
            return F.when(fits, refill(m, F.concat(d.substr(F.lit(1), code), fresh)))

        return bound(code, filled)

    return bound(only_digits(m), made)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (m.substr(i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("long")
    v = permute((place * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")
    upper = F.floor(v / 9999)
    new = F.floor(upper / 99) + 1
    return F.when(valid, F.format_string("%03d-%02d-%04d", new + (new >= 666).cast("long"), upper % 99 + 1, v % 9999 + 1))


def _ipv4(m: Column, key: str) -> Column:
    octet = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    valid = (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256) & (octet(4) < 256)
    v = permute(((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4), F.lit(65536), F.lit(65536), key, "ipv4")
    return F.when(valid, F.format_string("%d.%d.%d.%d", *(F.floor(v / 256**k) % 256 for k in (3, 2, 1, 0))))


def _month_first(m: Column, key: str) -> Column:
    """mm/dd/yyyy with a day over 12, permuted among dates of that form."""
    month, d, year = (m.substr(i, n).cast("long") for i, n in ((1, 2), (4, 2), (7, 4)))
    real = F.try_to_date(m, "MM/dd/yyyy").isNotNull() & year.between(1900, 2099) & (d > 12)
    written = lambda mo, da, ye: F.format_string("%02d/%02d/%04d", mo, da, ye)
    common = permute(((year - 1900) * 12 + month - 1) * 16 + F.least(d, F.lit(28)) - 13, F.lit(160), F.lit(240), key, "m/d")
    by_common = bound(common, lambda v: written(F.floor(v / 16) % 12 + 1, v % 16 + 13, F.floor(v / 192) + 1900))
    months = F.when(d == 31, F.array(*map(F.lit, (1, 3, 5, 7, 8, 10, 12)))).otherwise(F.array(*map(F.lit, (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12))))

    def by_late(those: Column) -> Column:
        n = F.size(those).cast("long")
        late = permute((year - 1900) * n + F.array_position(those, month.cast("int")) - 1, F.lit(200), n, key, "m/29")
        return bound(late, lambda v: written(F.element_at(those, (v % n + 1).cast("int")), d, F.floor(v / n) + 1900))

    leap = permute(F.floor((year - 1904) / 4), F.lit(7), F.lit(7), key, "2/29")  # 49 leap years
    return F.when(real, F.when(d <= 28, by_common).when(month == 2, written(F.lit(2), F.lit(29), leap * 4 + 1904)).otherwise(bound(months, by_late)))


def _date(m: Column, key: str) -> Column:
    first = F.lit("1900-01-01").cast("date")
    forms = [("yyyy-MM-dd", m.substr(5, 1) == "-"), ("dd/MM/yyyy", m.substr(3, 1) == "/"), ("dd.MM.yyyy", F.lit(True))]
    pick = lambda make: F.when(forms[0][1], make(forms[0][0])).when(forms[1][1], make(forms[1][0])).otherwise(make(forms[2][0]))

    def made(day: Column) -> Column:
        new = F.date_add(first, permute(F.date_diff(day, first), F.lit(17), F.lit(4297), key, "date").cast("int"))
        valid = day.between(first, F.lit("2099-12-31").cast("date"))
        return F.when(valid, bound(new, lambda v: pick(lambda form: F.date_format(v, form)))).when(day.isNull() & forms[1][1], _month_first(m, key))

    return bound(pick(lambda form: F.try_to_date(m, form)), made)


def permute_classes(text: Column, key: str, kind: str) -> Column:
    """Both halves of a string shift each other's letters and digits, within their class; other characters stay."""

    def shift(half: Column, other: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other), 512)

        def turned(digest: Column) -> Column:
            def one(c: Column, p: Column) -> Column:
                by = F.conv(F.substring(F.sha2(F.concat(digest, (p + 1).cast("string")), 256), 1, 8), 16, 10).cast("long")
                to = lambda base, n: F.char(base + (F.ascii(c) - base + by) % n)
                return F.when(c.rlike("[0-9]"), to(48, 10)).when(c.rlike("[a-z]"), to(97, 26)).when(c.rlike("[A-Z]"), to(65, 26)).otherwise(c)

            return F.array_join(F.transform(F.split(half, ""), one), "")

        return F.when(F.length(half) == 0, half).otherwise(bound(digest, turned))

    return bound(text, lambda t: _halves(t, shift))


def _halves(text: Column, shift) -> Column:
    left = F.ceil(F.length(text) / 2).cast("int")
    start = F.struct(text.substr(F.lit(1), left).alias("l"), text.substr(left + 1, F.length(text)).alias("r"))
    turn = lambda s, i: F.struct(F.when(i % 2 == 1, shift(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(i % 2 == 0, shift(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_classes(m.substr(F.lit(1), at - 1), key, "email"), m.substr(at, F.length(m)))


_MAKERS = {"email": _email, "iban": _iban, "phone": _phone, "ssn": _ssn, "date": _date, "ipv4": _ipv4}


def pseudonym(m: Column, key: str) -> Column:
    """(kind, value): the pseudonym of a candidate, by the first kind it has the form of; nulls if it is not valid."""
    kind = None
    for name in _MAKERS:
        form = m.rlike(f"^(?:{PATTERNS[name]})$")
        kind = F.when(form, F.lit(name)) if kind is None else kind.when(form, F.lit(name))

    def made(kind: Column) -> Column:
        value = None
        for name, make in _MAKERS.items():
            value = F.when(kind == name, make(m, key)) if value is None else value.when(kind == name, make(m, key))
        return bound(value, lambda v: F.struct(F.when(v.isNotNull(), kind).alias("kind"), v.alias("value")))

    return bound(kind, made)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced, kinds): kinds are those of the replaced values in text order."""
    if not key:
        raise ValueError("a key is needed: without one anybody could invert the pseudonyms")
    some = F.col("text").rlike(HINT)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("found", F.when(some, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    made = F.concat(F.transform("found", lambda m: pseudonym(m, key)), F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("value"))))
    rows = rows.withColumn("made", F.when(F.col("found").isNotNull(), made))
    rows = rows.withColumn("pieces", F.when(F.col("found").isNotNull(), F.transform(F.split("text", ANY, -1), lambda p: with_cards(p, key))))
    named = F.transform(F.arrays_zip("made", F.concat("found", F.array(F.lit(""))).alias("found")), lambda z: F.struct(z["made"]["kind"].alias("kind"), F.coalesce(z["made"]["value"], z["found"]).alias("value")))
    parts = F.zip_with("pieces", named, lambda p, m: F.struct(F.concat(p["value"], m["value"]).alias("value"), F.concat(F.array_repeat(F.lit("card"), p["cards"]), F.when(m["kind"].isNotNull(), F.array(m["kind"])).otherwise(F.array().cast("array<string>"))).alias("kinds")))
    rows = rows.withColumn("parts", F.when(F.col("found").isNotNull(), parts))
    kinds = F.coalesce(F.flatten(F.transform("parts", lambda p: p["kinds"])), F.array().cast("array<string>"))
    text = F.coalesce(F.array_join(F.transform("parts", lambda p: p["value"]), ""), F.col("text"))
    return rows.select("doc_id", text.alias("text"), F.size(kinds).alias("n_replaced"), kinds.alias("kinds"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_replaced, kinds of every document; the key is the session's ``KEY_SETTING``."""
    return pseudonymised(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, TEST_KEY))
