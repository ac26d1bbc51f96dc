"""Format-preserving pseudonyms with built-in column functions only.

Numbers and dates that pass validation are permuted inside their own format by
a keyed Feistel network, so equal values stay equal in every document and a
value keeps its length, separators and validity:

- payment cards (13 to 19 digits, Luhn): digits permuted, check digit renewed
- dates (ISO, d.m.y, m/d/y with real days, 1800 to 2199): the day number is
  permuted in a span of whole days, alike for the three forms
- dates d/m/y that no m/d/y can be (days from 13): permuted among themselves, so
  that no two slash dates share a pseudonym
- IPv4 addresses (octets to 255): permuted over all addresses
- telephone numbers and US social security numbers: digits permuted

E-mail addresses and hexadecimal secrets have no numeric format; their local
part or digits become a keyed digest of the same shape.
"""

from __future__ import annotations

from calendar import isleap, monthrange
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: dates are permuted inside [1800-01-01, 1800-01-01 + 365 * 400 days)
DAYS_FROM, DAYS_A, DAYS_B = "1800-01-01", 365, 400
#: day-first slash dates: (day from 13 of a common year) x (year from 1800), and 29 February
YEAR_FROM, YEARS = 1800, 400
_LATE = [monthrange(1801, m)[1] - 12 for m in range(1, 13)]
_LATE_FROM = [sum(_LATE[:m]) for m in range(12)]
_LEAP = [y for y in range(YEAR_FROM, YEAR_FROM + YEARS) if isleap(y)]

# fixed formats
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,6}?\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"\d{4}-\d{2}-\d{2}(?![\d-])|\d{2}/\d{2}/\d{4}(?![\d/])|\d{2}\.\d{2}\.\d{4}(?!\.?\d)",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "card": r"\d{13,19}(?!\d)|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?!\d)",
}
KINDS = tuple(PATTERNS)
_START = r"(?<![A-Za-z0-9._%+-])"
_SAFE = r"(?<![A-Za-z0-9])(?<!\d[.-])"
_BY_KIND = {"email": _START, "phone": r"(?<![0-9A-Za-z+(])"}
_ANY = "|".join(f"{_BY_KIND.get(k, _SAFE)}(?:{p})" for k, p in PATTERNS.items())


def _draw(key: str, tweak: Column, round_: Column, value: Column, size: Column) -> Column:
    """Keyed number in [0, size): 60 bits of SHA-256 of all inputs."""
    seed = F.concat_ws("|", F.lit(key), tweak, round_.cast("string"), value.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("long"), size)


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str,
            tweak: Column, rounds: int = ROUNDS) -> Column:
    """Keyed permutation of pairs (a, b) of Z_size_a x Z_size_b, as struct(a, b):
    each round adds a keyed function of one half to the other."""
    def step(s, r):
        even = r % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + _draw(key, tweak, r, s["b"], size_a), size_a))
            .otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(
                F.pmod(s["b"] + _draw(key, tweak, r, s["a"], size_b), size_b)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * (rounds // 2) - 1)),
                       F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _power(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def permuted_digits(digits: Column, key: str, tweak: Column) -> Column:
    """Keyed permutation of digit strings of one length (2 to 36 digits)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    s = feistel(F.substring(digits, F.lit(1), u).cast("long"),
                F.substring(digits, u + 1, v).cast("long"), _power(u), _power(v), key,
                F.concat(tweak, n.cast("string")))
    return F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), v, "0"))


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn sum of a digit string; ``odd`` says which places from the right count twice."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == odd, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]),
                                   c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, 1) % 10 == 0


def _in_format(value: Column, digits: Column) -> Column:
    """``digits`` put in the places of the digits of ``value``."""
    return F.aggregate(
        F.split(value, ""), F.struct(F.lit("").alias("o"), F.lit(1).alias("i")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(
            F.concat(s["o"], F.substring(digits, s["i"], F.lit(1))).alias("o"),
            (s["i"] + 1).alias("i"))).otherwise(
            F.struct(F.concat(s["o"], c).alias("o"), s["i"].alias("i"))), lambda s: s["o"])


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    d = _only_digits(m)
    body = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, F.lit("card"))
    check = F.pmod(F.lit(10) - _luhn_sum(body, 0) % 10, F.lit(10))
    return _in_format(m, F.concat(body, check.cast("string")))


def _ip(m: Column, key: str) -> Column:
    o = F.split(m, r"\.")
    s = feistel(o[0].cast("long") * 256 + o[1].cast("long"), o[2].cast("long") * 256
                + o[3].cast("long"), F.lit(65536), F.lit(65536), key, F.lit("ip"))
    half = [s["a"], s["b"]]
    return F.concat_ws(".", *[x.cast("string") for h in half
                              for x in (F.floor(h / 256), F.pmod(h, F.lit(256)))])


def _as_date(m: Column) -> Column:
    """The day a date string names, null if there is none."""
    us = F.try_to_timestamp(m, F.lit("MM/dd/yyyy"))
    eu = F.try_to_timestamp(m, F.lit("dd/MM/yyyy"))
    return F.to_date(F.when(m.contains("-"), F.try_to_timestamp(m, F.lit("yyyy-MM-dd")))
                     .when(m.contains("."), F.try_to_timestamp(m, F.lit("dd.MM.yyyy")))
                     .otherwise(F.coalesce(us, eu)))


def _day(m: Column) -> Column:
    return F.datediff(_as_date(m), F.lit(DAYS_FROM).cast("date"))


def _day_first(m: Column) -> Column:
    """Whether a slash date has a day from 13 in front, so that it is no m/d/y."""
    return m.contains("/") & (F.substring(m, 1, 2).cast("int") > 12)


def _late_day(m: Column, key: str) -> Column:
    """A d/m/y date with a day from 13, permuted among its like; 29 February stays
    one, its year is moved by a keyed step among the leap years."""
    day, month, year = (F.substring(m, at, n).cast("int") for at, n in ((1, 2), (4, 2), (7, 4)))
    starts, leap = F.array(*[F.lit(x) for x in _LATE_FROM]), F.array(*[F.lit(x) for x in _LEAP])
    s = feistel(F.element_at(starts, month) + day - 13, year - YEAR_FROM,
                F.lit(sum(_LATE)), F.lit(YEARS), key, F.lit("late"))
    new_month = F.size(F.filter(starts, lambda x: x <= s["a"]))
    common = F.concat_ws("/", (s["a"] - F.element_at(starts, new_month) + 13).cast("string"),
                         F.lpad(new_month.cast("string"), 2, "0"), (s["b"] + YEAR_FROM).cast("string"))
    place = feistel(F.array_position(leap, year) - 1, F.lit(0), F.lit(len(_LEAP)), F.lit(1), key,
                    F.lit("leap"))["a"]
    moved = F.concat(F.lit("29/02/"), F.element_at(leap, (place + 1).cast("int")).cast("string"))
    return F.when(m.startswith("29/02/"), moved).otherwise(common)


def _date(m: Column, key: str) -> Column:
    n = _day(m)
    s = feistel(F.floor(n / DAYS_B), F.pmod(n, F.lit(DAYS_B)), F.lit(DAYS_A), F.lit(DAYS_B), key,
                F.lit("date"))
    d = F.date_add(F.lit(DAYS_FROM).cast("date"), (s["a"] * DAYS_B + s["b"]).cast("int"))
    return (F.when(_day_first(m), _late_day(m, key))
            .when(m.contains("-"), F.date_format(d, "yyyy-MM-dd"))
            .when(m.contains("."), F.date_format(d, "dd.MM.yyyy"))
            .otherwise(F.date_format(d, "MM/dd/yyyy")))


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    token = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(token, 1, 12), F.substring(m, at, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    def part(i):
        return F.sha2(F.concat_ws("|", F.lit(key), F.concat(F.lit("s"), i.cast("string")), F.lower(m)), 256)
    # as many digests as the value is long, 64 digits each
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(m) - 1) / 64).cast("int")), part)
    new = F.substring(F.array_join(parts, ""), F.lit(1), F.length(m))
    return F.when(m.rlike("[A-F]"), F.upper(new)).otherwise(new)


def kind_of(m: Column) -> Column:
    """Kind of a matched value after validation; null if it is not valid."""
    octets = F.split(m, r"\.")
    valid = {
        "card": luhn_valid(_only_digits(m)),
        "ip": F.forall(octets, lambda x: x.cast("int") <= 255),
        "date": F.when(_day_first(m), F.year(_as_date(m)).between(YEAR_FROM, YEAR_FROM + YEARS - 1))
        .otherwise(_day(m).between(0, DAYS_A * DAYS_B - 1)),
    }
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        whole = m.rlike(f"^(?:{PATTERNS[k]})$")
        if k == "secret":
            whole = whole & m.rlike("[0-9]") & m.rlike("[A-Fa-f]")
        out = F.when(whole, F.when(valid.get(k, F.lit(True)), F.lit(k))).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """Replacement for a value of a known kind; any other value is unchanged."""
    d = _only_digits(m)
    made = {"email": _email(m, key), "secret": _secret(m, key), "date": _date(m, key),
            "phone": _in_format(m, F.concat(    # the country code stays
                F.substring(d, F.lit(1), F.length(d) - 10),
                permuted_digits(F.substring(d, F.length(d) - 9, F.lit(10)), key, F.lit("phone")))),
            "ssn": _in_format(m, permuted_digits(d, key, F.lit("ssn"))),
            "ip": _ip(m, key), "card": _card(m, key)}
    return F.coalesce(reduce(lambda acc, k: acc.when(kind == k, made[k]), KINDS[1:],
                             F.when(kind == KINDS[0], made[KINDS[0]])), m)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text",
                 counts: bool = True) -> DataFrame:
    """``docs`` with personal values of ``text_col`` replaced, and (``counts``)
    pii_<kind> counts (long) added; all other columns and rows pass through.

    A null text stays null with zero counts; an empty one stays empty. Values
    that fail validation (a wrong check digit, an impossible day, an octet over
    255) are not touched. Equal values get equal pseudonyms under one key, in
    any document, partition or run; different keys give unrelated ones. Count
    columns replace columns of the same name.
    """
    found = F.transform(F.regexp_extract_all(text_col, F.lit(_ANY), F.lit(0)),
                        lambda m: F.struct(m.alias("m"), kind_of(m).alias("k")))
    some = F.col(text_col).rlike("[0-9@]")
    rows = docs.withColumn("_found", F.when(some, found)).withColumn(
        "_gaps", F.when(some, F.split(F.col(text_col), _ANY, -1)))
    rebuilt = F.array_join(F.flatten(F.zip_with(
        "_gaps", F.transform("_found", lambda x: pseudonym(x["m"], x["k"], key)),
        lambda g, v: F.array(g, F.coalesce(v, F.lit(""))))), "")
    changed = F.coalesce(F.exists("_found", lambda x: x["k"].isNotNull()), F.lit(False))
    rows = rows.withColumn(text_col, F.when(changed, rebuilt).otherwise(F.col(text_col)))
    for k in KINDS if counts else ():
        rows = rows.withColumn(f"pii_{k}", F.coalesce(F.size(F.filter(
            "_found", _is(k))), F.lit(0)).cast("long"))
    return rows.drop("_found", "_gaps")


def _is(kind: str):
    return lambda x: x["k"] == kind
