"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

E-mail addresses, phone and card numbers, IBANs, social security numbers, IPv4
addresses and dates are found by one pattern, validated, and permuted within
their format: same length, same separators, valid check digits, valid dates.
Equal values get equal pseudonyms in every document, and different values of a
format different ones.  Built-in functions only; rows never move.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: What may be personal; each alternative is bounded by look-arounds so that no
#: longer number or word is cut.  Order matters where two could start together.
EMAIL = r"(?<![\p{L}0-9._%+-])[\p{L}0-9_%+-](?:[\p{L}0-9._%+-]{0,63})@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![\p{L}0-9-])"
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[./](?:0[1-9]|1[0-2])[./](?:19|20)[0-9]{2}|(?:0[1-9]|1[0-2])/(?:1[3-9]|2[0-9]|3[01])/(?:19|20)[0-9]{2})(?![0-9/-])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
IBAN = r"(?<![\p{L}0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
#: A whole run of numbers of 13 digits or more, up to where another value starts; cards are sought among its parts.
CARD = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{'|'.join((EMAIL, DATE, IP, IBAN, SSN, PHONE))})[0-9]++)*+"
ANY = "|".join((EMAIL, DATE, IP, IBAN, SSN, PHONE, CARD))
#: Cheap test that a text can hold any of them: each alternative implies it, an
#: address by a digit, a dot and a digit, a card also by digits one by one.
HINT = r"[0-9][ .-]?[0-9]|@"

ROUNDS = 10
#: Days from 1900-01-01 to 2099-12-31: 73,049 = 17 * 4,297, a grid that a Feistel network permutes.
FIRST_DAY, DAYS_A, DAYS_B = -25567, 17, 4297


def _round_hex(key: str, label: str, i: Column, half: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}\x1f{label}\x1f"), i.cast("string"), F.lit("\x1f"), half), 256)


def _byte(digest: Column, i: Column) -> Column:
    """Byte i of a 32-byte digest in hex; after 32 they repeat."""
    return F.conv(F.substring(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")


def _shift(half: Column, digest: Column, never_whole: bool = False) -> Column:
    """Each character moved within its class (digit, lower, upper, two ranges of accented letters), perhaps by a whole turn."""

    def one(c: Column, i: Column) -> Column:
        code, by = F.ascii(c), _byte(digest, i)
        moved = F.when(F.lit(False), c)
        for first, size in ((48, 10), (97, 26), (65, 26), (224, 23), (192, 23)):
            step = 1 + by % (size - 1) if never_whole else by
            moved = moved.when((code >= first) & (code < first + size), F.char(F.lit(first) + (code - first + step) % size))
        return moved.otherwise(c)

    return F.when(F.length(half) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.split(half, ""), one), ""))


def permute_text(s: Column, key: str, label: str) -> Column:
    """A keyed permutation of strings of one length and character classes.

    One character alone is moved by a keyed step that is never a whole turn.
    """
    cut = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), cut).alias("l"), F.substring(s, cut + 1, F.length(s)).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, _shift(acc["l"], _round_hex(key, label, i, acc["r"]))).otherwise(acc["l"])
        right = F.when(i % 2 == 1, _shift(acc["r"], _round_hex(key, label, i, acc["l"]))).otherwise(acc["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    mixed = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda a: F.concat(a["l"], a["r"]))
    alone = _shift(s, _round_hex(key, f"{label}/1", F.lit(0), F.lit("")), never_whole=True)
    return F.when(F.length(s) < 2, alone).otherwise(mixed)


def permute_grid(n: Column, a: int, b: int, key: str, label: str) -> Column:
    """A keyed permutation of 0 .. a*b-1, as a Feistel network over quotient and remainder."""

    def number(acc_half: Column, i: Column, size: int) -> Column:
        return F.pmod(F.conv(F.substring(_round_hex(key, label, i, acc_half.cast("string")), 1, 12), 16, 10).cast("long"), F.lit(size))

    start = F.struct(F.floor(n / b).cast("long").alias("l"), F.pmod(n, F.lit(b)).cast("long").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, (acc["l"] + number(acc["r"], i, a)) % a).otherwise(acc["l"])
        right = F.when(i % 2 == 1, (acc["r"] + number(acc["l"], i, b)) % b).otherwise(acc["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, step, lambda x: x["l"] * b + x["r"])


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def refill(shape: Column, chars: Column, pattern: str = "[0-9]") -> Column:
    """``shape`` with its characters of ``pattern`` replaced in turn by those of ``chars``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        hit = c.rlike(pattern)
        return F.struct(F.concat(acc["out"], F.when(hit, F.substring(chars, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + hit.cast("int")).alias("k"))

    return F.aggregate(F.split(shape, ""), start, step, lambda a: a["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum, the last digit counted once."""
    n = F.length(digits)

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when((n - 1 - i) % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, b: a + b)


def iban_rest(plain: Column) -> Column:
    """An IBAN without spaces modulo 97; 1 if its check digits are right."""

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), ""), F.lit(0), step)


def _email(m: Column, key: str) -> Column:
    """Names that differ in case alone keep doing so: the permutation is of the lower-case name."""
    name = F.substring_index(m, "@", 1)
    low, high = string.ascii_lowercase, string.ascii_uppercase
    moved = permute_text(F.translate(name, high, low), key, "email")
    new = F.zip_with(F.split(moved, ""), F.split(name, ""), lambda a, b: F.when(b.rlike("[A-Z]"), F.translate(a, low, high)).otherwise(a))
    return F.concat(F.array_join(new, ""), F.lit("@"), F.substring_index(m, "@", -1))


def _ip(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    n = F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a * 256 + b)
    out = permute_grid(n, 65536, 65536, key, "ip")
    return F.concat_ws(".", *[F.pmod(F.floor(out / 256**k).cast("long"), F.lit(256)).cast("string") for k in (3, 2, 1, 0)])


def _date(m: Column, key: str) -> Column:
    first = m.rlike("^[0-9]{4}")
    month_first = ~first & (F.substring(m, 4, 2).cast("int") > 12)
    dotted = F.regexp_replace(m, "/", ".")
    day = F.when(first, F.try_to_date(F.regexp_replace(m, "/", "-"), "yyyy-MM-dd")).when(month_first, F.try_to_date(dotted, "MM.dd.yyyy")).otherwise(F.try_to_date(dotted, "dd.MM.yyyy"))
    to = F.date_add(F.lit("1900-01-01").cast("date"), permute_grid((F.unix_date(day) - FIRST_DAY).cast("long"), DAYS_A, DAYS_B, key, "date").cast("int"))
    sign = F.when(first, F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))
    y, mo, d = (F.date_format(to, p) for p in ("yyyy", "MM", "dd"))
    return F.when(day.isNull(), m).otherwise(F.when(first, F.concat_ws("", y, sign, mo, sign, d)).when(month_first, F.concat_ws("", mo, sign, d, sign, y)).otherwise(F.concat_ws("", d, sign, mo, sign, y)))


def _card(m: Column, key: str) -> Column:
    d = digits_of(m)
    body = permute_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    last = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
    return refill(m, F.concat(body, last.cast("string")))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _cards(m: Column, key: str) -> Column:
    """(value, n): a run of numbers with the n cards among its separator-bounded parts replaced.

    Parts of 13 to 19 digits with a Luhn sum are cards, those in a usual
    grouping (4-4-4-4, 4-6-5, unbroken) before the whole run, that before
    others, then the leftmost and longest; no two overlap.
    """

    def spans(t: Column) -> Column:
        def ends(i: Column) -> Column:
            def span(j: Column) -> Column:
                part = F.slice(t, i + 1, j - i + 1)
                shape = F.array_join(F.transform(part, lambda x: F.length(x).cast("string")), "-")
                usual = (i == j) | shape.isin("4-4-4-4", "4-6-5")
                rank = F.when(usual, 0).when((i == 0) & (j == F.size(t) - 1), 1).otherwise(2)
                return F.struct(rank.alias("rank"), i.alias("i"), (-j).alias("to"), F.array_join(part, "").alias("d"))

            valid = lambda x: F.when(F.length(x["d"]).between(13, 19) & ~x["d"].rlike("^0+$"), luhn_sum(x["d"]) % 10 == 0).otherwise(False)
            return F.filter(F.transform(F.sequence(i, F.least(F.size(t) - 1, i + 18)), span), valid)

        return F.sort_array(F.flatten(F.transform(F.sequence(F.lit(0), F.size(t) - 1), ends)))

    def start(t: Column, i: Column) -> Column:
        return F.aggregate(F.slice(t, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x) + 1)

    def picked(found: Column) -> Column:
        none = F.slice(found, 1, 0)
        free = lambda acc, x: ~F.exists(acc, lambda y: (y["i"] <= -x["to"]) & (x["i"] <= -y["to"]))
        return F.aggregate(found, none, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))

    def replaced(t: Column) -> Column:
        first = F.struct(F.lit("").alias("value"), F.lit(0).alias("n"), F.lit(0).alias("at"))
        places = F.array_sort(F.transform(picked(spans(t)), lambda x: F.struct(start(t, x["i"]).alias("a"), (start(t, 1 - x["to"]) - 1).alias("b"))))

        def step(acc: Column, x: Column) -> Column:
            old = F.substring(m, x["a"] + 1, x["b"] - x["a"])
            gap = F.substring(m, acc["at"] + 1, x["a"] - acc["at"])
            return _let(_card(old, key), lambda new: F.struct(F.concat(acc["value"], gap, new).alias("value"), (acc["n"] + (new != old).cast("int")).alias("n"), x["b"].alias("at")))

        return F.aggregate(places, first, step, lambda acc: F.struct(F.concat(acc["value"], F.substring(m, acc["at"] + 1, F.length(m))).alias("value"), acc["n"].alias("n")))

    return _let(F.split(m, "[ -]"), replaced)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)  # the country stays
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, refill(rest, permute_text(digits_of(rest), key, "phone")))


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    body = permute_text(F.substring(plain, F.lit(5), F.length(plain)), key, "iban")
    country = F.substring(plain, 1, 2)
    check = F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
    return refill(m, F.concat(country, check, body), "[A-Z0-9]")


def _ssn(m: Column, key: str) -> Column:
    """Area 001-665 and 667-899, group and serial not 0: 898 * 99 * 9,999 numbers on a grid."""
    a, g, s = (F.substring(m, *x).cast("long") for x in ((1, 3), (5, 2), (8, 4)))
    area = F.when(a > 666, a - 2).otherwise(a - 1)
    out = permute_grid((area * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, key, "ssn")
    area = F.floor(out / (99 * 9999))
    back = F.when(area >= 665, area + 2).otherwise(area + 1)
    group, serial = F.floor(out / 9999) % 99 + 1, out % 9999 + 1
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.concat_ws("-", pad(back, 3), pad(group, 2), pad(serial, 4))


def pseudonym(m: Column, key: str) -> Column:
    """(value, n): the pseudonym of a found value, or the value itself where it isn't valid; n values were replaced."""
    d = digits_of(m)
    octets = reduce(lambda x, y: x & y, [F.split_part(m, F.lit("."), F.lit(k)).cast("int") < 256 for k in (1, 2, 3, 4)])
    one = (
        F.when(m.contains("@"), _email(m, key))
        .when(m.rlike(f"^(?:{DATE})$"), _date(m, key))
        .when(m.rlike(f"^(?:{IP})$"), F.when(octets, _ip(m, key)).otherwise(m))
        .when(m.rlike("^[A-Z]{2}"), F.when(iban_rest(F.replace(m, F.lit(" "), F.lit(""))) == 1, _iban(m, key)).otherwise(m))
        .when(m.rlike(f"^(?:{SSN})$"), F.when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), _ssn(m, key)).otherwise(m))
        .when(m.rlike(f"^(?:{PHONE})$"), F.when(F.length(d).between(8, 15), _phone(m, key)).otherwise(m))
    )
    return _let(one, lambda new: F.when(new.isNull(), _cards(m, key)).otherwise(F.struct(new.alias("value"), (new != m).cast("int").alias("n"))))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by pseudonyms; all columns stay.

    Numbers that fail validation (a Luhn sum, an octet over 255, a date that
    doesn't exist) stay as they are.  Of an address the domain stays, of a phone
    number the country.  A slashed date whose middle number is over 12 is read and
    written month first, others with points or slashes day first.  A null text
    stays null, texts without a find stay untouched, repeated rows come out alike;
    tables may be empty.  ``count_col``, if given, gets the number of values
    replaced; if ``docs`` has a column of that name, the new one's gets a ``_``.
    """
    text = F.col(f"`{text_col}`")
    names = [f"`{c}`" for c in docs.columns]
    df = docs.select(F.struct(*names).alias("d"), F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("found"))
    df = df.withColumn("new", F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(m, key))))
    own = F.col("d").getField(text_col)
    parts = F.split(own, ANY, -1)
    merged = F.array_join(F.zip_with(parts, "new", lambda p, n: F.concat(p, F.coalesce(n["value"], F.lit("")))), "")
    out = [F.when(F.col("new").isNull(), own).otherwise(merged).alias(c) if c == text_col else F.col("d").getField(c).alias(c) for c in docs.columns]
    if count_col:
        changed = F.aggregate("new", F.lit(0), lambda n, x: n + x["n"])
        out.append(F.when(F.col("new").isNull(), 0).otherwise(changed).cast("long").alias(free_name(docs, count_col)[0]))
    return df.select(*out)
