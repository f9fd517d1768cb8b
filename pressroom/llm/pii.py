"""Format-preserving pseudonyms for personal data, in DataFrame expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of the Gregorian cycle of 400 years, and the halves of the permutation of them.
_CYCLE, _A, _B = 146097, 27, 5411

# Patterns by kind, tried in this order at each place.  (?<!...) and (?!...) keep them whole.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|(?:password|passwd|secret|api_key|apikey|token)[ ]?[=:][ ]?[\"']?[A-Za-z0-9_/+-]{8,})",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9A-Za-z(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z-])",
}
ANY = "|".join(PATTERNS.values())
# Calling codes of countries, of one, two or three digits.
CALLING_CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Social security numbers: 898 areas (001 to 899 but 666), 99 groups and 9999 serials, none of them zero.
_AREAS, _SERIALS, _OF_AREA = 898, 9999, 99 * 9999
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _network(halves: Column, step, rounds: int) -> Column:
    """The halves after all rounds of step(halves, round)."""
    return reduce(lambda h, r: _let(h, lambda x: step(x, r)), range(rounds), halves)


def _digest(key: Column, label: str, half: Column) -> Column:
    return F.sha2(F.concat(key, F.lit(f"|{label}|"), half.cast("string")), 256)


def _shifted(part: Column, digest: Column) -> Column:
    """Each letter or digit moved within its class by two hex digits of the digest; all else stays."""

    def move(i: Column) -> Column:
        c = F.substring(part, i, F.lit(1))
        by = F.conv(F.substring(digest, F.pmod(i - 1, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        classes = [F.when(c.rlike(f"^[{x[0]}-{x[-1]}]$"), F.substring(F.lit(x), F.pmod(F.instr(F.lit(x), c) - 1 + by, F.lit(len(x))) + 1, F.lit(1))) for x in (DIGITS, LOWER, UPPER)]
        return F.coalesce(*classes, c)

    return F.when(F.length(part) == 0, part).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(part)), move), ""))


def permute_text(value: Column, key: Column, label: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the texts of one format: each letter and digit keeps its class and place.

    An alternating Feistel network over the halves of the text: each round moves one
    half, letter by letter, by a digest of key, round and the other half.
    """

    def step(halves: Column, r: int) -> Column:
        a, b = halves["a"], halves["b"]
        if r % 2:
            return F.struct(a.alias("a"), _let(_digest(key, f"{label}{r}", a), lambda d: _shifted(b, d)).alias("b"))
        return F.struct(_let(_digest(key, f"{label}{r}", b), lambda d: _shifted(a, d)).alias("a"), b.alias("b"))

    cut = F.floor(F.length(value) / 2).cast("int")
    halves = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, F.length(value)).alias("b"))
    return _let(_network(halves, step, rounds), lambda h: F.concat(h["a"], h["b"]))


def permute_number(value: Column, a: int, b: int, key: Column, label: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. a * b - 1 by a Feistel network over value div b and value mod b."""

    def amount(half: Column, r: int, size: int) -> Column:
        return F.pmod(F.conv(F.substring(_digest(key, f"{label}{r}", half), 1, 15), 16, 10).cast("long"), F.lit(size))

    def step(x: Column, r: int) -> Column:
        if r % 2:
            return F.struct(x["a"].alias("a"), F.pmod(x["b"] + amount(x["a"], r, b), F.lit(b)).alias("b"))
        return F.struct(F.pmod(x["a"] + amount(x["b"], r, a), F.lit(a)).alias("a"), x["b"].alias("b"))

    halves = F.struct(F.floor(value / b).cast("long").alias("a"), F.pmod(value, F.lit(b)).cast("long").alias("b"))
    return _let(_network(halves, step, rounds), lambda h: h["a"] * b + h["b"])


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits without a check digit, which would follow."""
    n = F.length(digits)

    def weigh(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(F.pmod(n - i, F.lit(2)) == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weigh), F.lit(0), lambda s, x: s + x)


def _check_digit(digits: Column) -> Column:
    return F.pmod(-_luhn_sum(digits), F.lit(10)).cast("string")


def _refill(shape: Column, digits: Column) -> Column:
    """The digits of shape replaced by these, in order; all else stays."""
    place = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), "[^0-9]", ""))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(F.substring(shape, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(F.substring(shape, i, F.lit(1)))), "")


def _card(m: Column, key: Column) -> Column:
    """Numbers of 13 to 19 digits with a right check digit: the digits before it are permuted, and it is worked out anew."""

    def of(digits: Column) -> Column:
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        new = _let(permute_text(body, key, "card"), lambda x: F.concat(x, _check_digit(x)))
        return F.when((F.length(digits) >= 13) & (F.length(digits) <= 19) & (_check_digit(body) == F.substring(digits, -1, 1)), _let(new, lambda x: _refill(m, x)))

    return _let(F.regexp_replace(m, "[^0-9]", ""), of)


def _date(m: Column, key: Column) -> Column:
    """Dates that the calendar has are permuted within their cycle of 400 years, and written in the form they had."""
    iso = m.rlike("^[0-9]{4}-")
    sep = F.substring(m, 3, 1)
    day = F.coalesce(
        F.when(iso, F.try_to_date(m, "yyyy-MM-dd")),
        F.try_to_date(F.replace(m, F.lit("."), F.lit("/")), "dd/MM/yyyy"),
        F.try_to_date(F.replace(m, F.lit("."), F.lit("/")), "MM/dd/yyyy"),
    )
    american = ~iso & F.try_to_date(F.replace(m, F.lit("."), F.lit("/")), "dd/MM/yyyy").isNull()
    # Day 0 of a cycle is 1 January of a year divisible by 400.
    days = F.datediff(day, F.lit("2000-01-01").cast("date"))
    cycle = F.floor(days / _CYCLE) * _CYCLE

    def write(new: Column) -> Column:
        text = lambda form: F.date_format(new, form)
        return F.when(iso, text("yyyy-MM-dd")).when(american, F.concat(text("MM"), sep, text("dd"), sep, text("yyyy"))).otherwise(F.concat(text("dd"), sep, text("MM"), sep, text("yyyy")))

    # Day and month that may be read both ways are read as day first; a day over 12 keeps that reading.
    new = F.date_add(F.lit("2000-01-01").cast("date"), (cycle + permute_number(F.pmod(days, F.lit(_CYCLE)), _A, _B, key, "date")).cast("int"))
    return F.when(day.isNotNull(), _let(new, write))


def _ip(m: Column, key: Column) -> Column:
    """Addresses of four numbers up to 255, as one number of 32 bits."""

    def of(parts: Column) -> Column:
        numbers = F.transform(parts, lambda p: p.cast("long"))
        value = F.aggregate(numbers, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
        new = permute_number(value, 65536, 65536, key, "ip")
        dotted = _let(new, lambda x: F.concat_ws(".", *[F.pmod(F.floor(x / 256**i), F.lit(256)).cast("long").cast("string") for i in (3, 2, 1, 0)]))
        return F.when(F.forall(numbers, lambda p: p < 256), dotted)

    return _let(F.split(m, r"\."), of)


def _ssn(m: Column, key: Column) -> Column:
    """Numbers whose area, group and serial can be given out, as one number of all of those."""
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    value = (area - F.when(area > 666, 2).otherwise(1)).cast("long") * _OF_AREA + (group - 1) * _SERIALS + serial - 1

    def write(new: Column) -> Column:
        place, rest = F.floor(new / _OF_AREA), F.pmod(new, F.lit(_OF_AREA))
        text = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
        return F.concat_ws("-", text(place + F.when(place >= 665, 2).otherwise(1), 3), text(F.floor(rest / _SERIALS) + 1, 2), text(F.pmod(rest, F.lit(_SERIALS)) + 1, 4))

    return F.when(valid, _let(permute_number(value, _AREAS, _OF_AREA, key, "ssn"), write))


def _phone(m: Column, key: Column) -> Column:
    """Numbers of 8 to 15 digits with a calling code, or of ten with an area and an exchange from 2 on; signs between digits don't matter, so a number has one pseudonym however it is written."""

    def of(digits: Column) -> Column:
        code = F.when(F.startswith(m, F.lit("+")), F.regexp_extract(digits, CALLING_CODE, 0)).otherwise("")
        valid = F.when(F.startswith(m, F.lit("+")), F.length(digits).between(8, 15) & (code != "")).otherwise(digits.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"))
        new = _let(code, lambda c: F.concat(c, permute_text(F.substring(digits, F.length(c) + 1, F.length(digits)), key, "phone")))
        return F.when(valid, _let(new, lambda x: _refill(m, x)))

    return _let(F.regexp_replace(m, "[^0-9]", ""), of)


def _rest(m: Column, head: str, key: Column, label: str) -> Column:
    """What follows head is permuted as text, head stays."""
    start = F.regexp_extract(m, head, 0)
    return _let(start, lambda s: F.concat(s, permute_text(F.substring(m, F.length(s) + 1, F.length(m)), key, label)))


def _email(m: Column, key: Column) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_text(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m)))


def _iban(m: Column, key: Column) -> Column:
    """IBANs whose check digits are right; country stays, the rest is permuted, check digits are worked out anew."""

    def modulo(rest: Column, head: Column) -> Column:
        number = F.transform(F.filter(F.split(F.concat(rest, head), ""), lambda c: c != ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c))
        return F.aggregate(F.filter(F.split(F.array_join(number, ""), ""), lambda c: c != ""), F.lit(0), lambda a, c: F.pmod(a * 10 + c.cast("int"), F.lit(97)))

    country, rest = F.substring(m, 1, 2), F.substring(m, F.lit(5), F.length(m))
    new = _let(permute_text(rest, key, "iban"), lambda r: F.concat(country, F.lpad((98 - modulo(r, F.concat(country, F.lit("00")))).cast("string"), 2, "0"), r))
    return F.when(modulo(rest, F.substring(m, 1, 4)) == 1, new)


def _kind(m: Column) -> Column:
    return reduce(lambda c, k: c.when(m.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)), list(PATTERNS)[1:], F.when(m.rlike(f"^(?:{PATTERNS['email']})$"), F.lit("email")))


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    """The pseudonym of a match; null where its check fails, so that it isn't of this kind."""
    return (
        F.when(kind == "email", _email(m, key))
        .when(kind == "secret", _rest(m, r"^(?:AKIA|[a-z_]+[ ]?[=:][ ]?[\"']?)", key, "secret"))
        .when(kind == "date", _date(m, key))
        .when(kind == "ip", _ip(m, key))
        .when(kind == "iban", _iban(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "card", _card(m, key))
    )


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text pseudonymised, n_pii and pii (kind, count) beside the other columns.

    Found are e-mail addresses, secrets, dates, IPv4 addresses, IBANs, social security numbers,
    phone numbers and payment cards.  Numbers and dates are validated: by the calendar, octets up
    to 255, areas, groups and serials in use, calling codes and numbers of digits, the Luhn or the IBAN check; what fails is left as it is.  A value is replaced
    by a permutation, keyed by key, of the values of its format (Feistel networks of ROUNDS
    rounds over SHA-256): letters stay letters, digits digits, check digits right, signs
    in place.  Equal values have equal pseudonyms in every document, different ones of a
    format different ones.  Country codes, e-mail domains and the names of secrets stay.

    All work is on one row at a time, in DataFrame expressions; text without a match passes
    unchanged, null stays null with n_pii 0.  Ids may be null or repeated; columns
    of docs named n_pii or pii are replaced.
    """
    secret = F.lit(key)
    text = F.col(text_col).cast("string")

    def found(matches: Column) -> Column:
        def one(m: Column) -> Column:
            return _let(_kind(m), lambda k: _let(pseudonym(m, k, secret), lambda p: F.struct(F.when(p.isNotNull(), k).alias("kind"), F.coalesce(p, m).alias("text"))))

        return F.transform(matches, one)

    may = text.rlike("[0-9@]|(?i:pass|secret|api_?key|token)")
    out = docs.withColumn("__pressroom_found", F.when(may, found(F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0)))))
    none = F.coalesce(F.size(F.filter("__pressroom_found", lambda x: x["kind"].isNotNull())) <= 0, F.lit(True))
    # Java's split keeps the pieces around each match, empty ones too, and the matches fall between.
    pieces = F.zip_with(F.split(text, ANY, -1), F.transform("__pressroom_found", lambda x: x["text"]), lambda s, m: F.concat(s, F.coalesce(m, F.lit(""))))
    kinds = F.transform(F.filter("__pressroom_found", lambda x: x["kind"].isNotNull()), lambda x: x["kind"])
    pii = F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("kind"), F.size(F.filter(kinds, lambda x: x == k)).alias("count")))
    return out.withColumns({text_col: F.when(none, text).otherwise(F.array_join(pieces, "")), "n_pii": F.when(none, 0).otherwise(F.size(kinds)).cast("long"), "pii": F.when(none, F.array().cast("array<struct<kind:string,count:int>>")).otherwise(pii)}).drop("__pressroom_found")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymize(docs, key="pressroom-demonstration-key")
